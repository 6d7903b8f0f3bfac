"""Helpers shared by the operators: table reads, lineage cuts, Arrow text buffers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prefline.session import scratch_path
from prefline.sources.tables import read_table

ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
KEPT: list = []  # what operators keep in a worker from one task to the next; each can be cleared
_turn = ""


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch to a Python worker may hold, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") if name == "embeddings" else read_table(spark, sf_dir, name)


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back: the
    lineage ends at files that every executor sees, so a lost one costs no recompute."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fan_out(spark: SparkSession) -> int:
    """Partitions for a shuffle whose number must be stated."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _heap_trim():
    """The C library's call that returns free memory to the system; None without one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return None


def give_back() -> None:
    """Return the memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = _heap_trim()
    if trim:
        trim(0)


def in_turn(operator: str, run):
    """``run`` as a task of that operator.  Python workers are reused: one that goes on to
    another operator first drops what the one before kept in it, and whenever a task
    ends, free memory is returned, so idle workers hold little."""
    def work(batches):
        take_turn(operator)
        try:
            yield from run(batches)
        finally:
            give_back()
    return work


def take_turn(operator: str) -> None:
    """Clear what another operator kept in this process."""
    global _turn
    if operator != _turn:
        _turn = operator
        for kept in KEPT:
            kept.clear()
        give_back()


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column without nulls, starting at 0."""
    wide = str(column.type).startswith("large")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0]:offs[-1]]


def slices(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Row ranges (i, j) holding at most ``limit`` bytes each, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift rounds), in wrapping arithmetic."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes of ranges over a sequence of 64-bit values: prefix sums of
    value * base**i modulo 2**64, made position-free by the inverse of the base."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.clear()
        KEPT.append(self)

    def clear(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 1 << 16)
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self._up, self._down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * down[starts])


WORDS = Rolling(0x9E3779B97F4A7C15)
SECOND = Rolling(0xD6E8FEB86659FD93)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of words ``[^\\x20\\x09-\\x0D]+`` in the rows' bytes.

    White space is ASCII, so no byte of a longer UTF-8 character is mistaken for it.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    prefix = WORDS.prefix(_BYTE[data])
    return mix(WORDS.ranges(prefix, starts, ends) + (ends - starts).astype(np.uint64))


def sorted_runs(batches, keys: list[str]):
    """Tables of the consecutive rows that agree in ``keys``, from sorted batches.  Only
    the run at hand is held."""
    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
