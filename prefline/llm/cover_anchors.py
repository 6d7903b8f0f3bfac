"""Operator 6, substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  ``COVER`` is a difference cover modulo
``PERIOD``: for any two places there is a shift below the period that brings both to
places in the cover.  So if a window starts at two places, the two share an anchor, a
run of ``WINDOW - PERIOD + 1`` words at a cover place, at the same distance from both
starts.  Only runs at cover places are hashed (5 of 21 words).  Where an anchor's hash
occurs more than once, it is extended to every window around it; those windows are
hashed whole, and a window whose hash occurs once is struck off again.  The words of
the rest are removed.

Every step is a count by hash: no pairs.  Within a task's piece of text a repeated hash
is known at once; one of its rows goes to the hash's partition to tell the others, the
rest are spread, so a passage that is everywhere fills no partition.

Hashes have 64 bits: for n candidate windows two different ones meet with probability
n * n / 2**65.  Documents are told apart by a 64-bit hash of id and text.

Defined results: null text: no words; fewer words than a window: nothing removed;
repeated rows are copies of each other (also with one id or null ids); a window also
repeats within a document, overlapping or not; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import WORDS, byte_hashes, fan_out, in_turn, load, mix, slices, spans, utf8, word_spans

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # a perfect difference set modulo 21
SLICE_BYTES = 2 << 20
ANCHOR_SCHEMA = "h bigint, key bigint, kind tinyint"
HASH_SCHEMA = "h bigint, key bigint, kind tinyint, start int, ranges binary"
HASH_ARROW = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("kind", pa.int8()), ("start", pa.int32()), ("ranges", pa.binary())])
ASK, TELL, KNOWN, RANGES = 0, 1, 2, 3


class Words:
    """The words of some rows and hashes of runs of them."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.starts, self.ends, self.counts = word_spans(offsets, data)
        self.prefix = WORDS.prefix(byte_hashes(data, self.starts, self.ends))
        self.first = np.cumsum(self.counts) - self.counts

    def places(self, length: int, cover: tuple[int, ...] | None = None, period: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, word number in all rows) where a run of ``length`` words starts."""
        room = np.maximum(self.counts - length + 1, 0)
        row = np.repeat(np.arange(len(room)), room)
        at = spans(self.first, room)
        if cover is not None:
            take = np.isin((at - self.first[row]) % period, cover)
            row, at = row[take], at[take]
        return row, at

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return WORDS.ranges(self.prefix, at, at + length)


def _kinds(h: np.ndarray) -> np.ndarray:
    """Which hashes are repeated here: the first place of one tells of it."""
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    kind = np.empty(len(h), np.int8)
    kind[order] = np.where(same[:-1], KNOWN, np.where(same[1:], TELL, ASK))
    return kind


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    length = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(1))
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, SLICE_BYTES):
                words = Words(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
                row, at = words.places(length, cover, period)
                h = words.hashes(at, length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[i:j][row]), pa.array(_kinds(h))], ["h", "key", "kind"])
    return run


def _by_count(repeated: bool):
    """Rows sorted by hash -> those whose hash occurs more
    than once (``repeated``), or else of those whose hash occurs once, and all ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row, not judged yet; the hash before it

        def judged(t: pa.RecordBatch, before, after) -> pa.RecordBatch:
            h, kind = t.column(0).to_numpy(), t.column(2).to_numpy()
            around = np.concatenate([[h[0] if before == h[0] else ~h[0]], h, [h[-1] if after == h[-1] else ~h[-1]]])
            many = (around[1:-1] == around[:-2]) | (around[1:-1] == around[2:]) | (kind == TELL) | (kind == KNOWN)
            take = many & (kind != RANGES) if repeated else ~many & (kind == ASK) | (kind == RANGES)
            return t.filter(pa.array(take)).select([c for c in t.schema.names if c != "kind"])

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if b.num_rows > 1:
                h = b.column(0).to_numpy()
                yield judged(b.slice(0, b.num_rows - 1), before, h[-1])
                before = h[-2]
            held = b.slice(b.num_rows - 1)
        if held is not None:
            yield judged(held, before, None)
    return run


def _counted(rows: DataFrame, repeated: bool) -> DataFrame:
    """Judge hashes by how often they occur.  The rows of a hash that a task knew to be
    repeated are spread, but for the one that tells the hash's partition."""
    n = fan_out(rows.sparkSession)
    to = F.when(F.col("kind") <= TELL, F.col("h")).otherwise(F.xxhash64("h", "key"))
    return rows.repartition(n, to).sortWithinPartitions("h").mapInArrow(in_turn(__name__, _by_count(repeated)), rows.drop("kind").schema)


def _around(at: np.ndarray, first: int, last: int, reach: int) -> np.ndarray:
    """Places [a - reach, a] for every a, within [first, last], ascending and once."""
    if not len(at):
        return at
    low, high = np.maximum(at - reach, first), np.minimum(at, last)
    low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)
    return spans(low, np.maximum(high - low + 1, 0))


def _windows(window: int, period: int, cover: tuple[int, ...]):
    """(..., key, text, repeated anchors) -> hashes of the windows around those anchors, and
    for each document the ranges of places where these windows start."""
    length = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column("__text"))
            keys = b.column("key").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, SLICE_BYTES):
                words = Words(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
                row, at = words.places(length, cover, period)
                h = words.hashes(at, length).view(np.int64)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                found_row, found_at = [], []
                for r in range(j - i):
                    a, z = bounds[r], bounds[r + 1]
                    known = b.column("known")[i + r].values.to_numpy()
                    mine = at[a:z][np.isin(h[a:z], known)]
                    places = _around(mine, words.first[r], words.first[r] + words.counts[r] - window, window - length)
                    found_at.append(places)
                    found_row.append(np.full(len(places), r))
                where, which = np.concatenate(found_at), np.concatenate(found_row)
                h = words.hashes(where, window)
                kind = _kinds(h)
                new = kind != KNOWN  # those known to be repeated need not be counted
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new].view(np.int64)), pa.array(keys[i:j][which][new]), pa.array(kind[new]),
                     pa.array((where - words.first[which])[new].astype(np.int32)), pa.nulls(int(new.sum()), pa.binary())], schema=HASH_ARROW)
                told = []
                for r, places in enumerate(found_at):
                    if len(places):
                        cut = np.flatnonzero(np.diff(places) > 1)
                        ends = np.stack([places[np.r_[0, cut + 1]], places[np.r_[cut, len(places) - 1]]], axis=1) - words.first[r]
                        told.append({"h": int(mix(keys[i + r:i + r + 1].view(np.uint64)).view(np.int64)[0]), "key": int(keys[i + r]), "kind": RANGES, "start": 0, "ranges": ends.astype("<i4").tobytes()})
                if told:
                    yield pa.RecordBatch.from_pylist(told, HASH_ARROW)
    return run


def _remove(window: int, kept_columns: int):
    """Pass-through columns, text, windows' ranges, places struck off -> the rest of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranges, single = (b.column(c) for c in ("__text", "ranges", "single"))
            offsets, data = utf8(texts)
            n_words, n_removed, kept = [], [], []
            for i, j in slices(offsets, SLICE_BYTES):
                own = data[offsets[i]:offsets[j]]
                starts, ends, counts = word_spans(offsets[i:j + 1] - offsets[i], own)
                first = np.cumsum(counts) - counts
                covered = np.zeros(len(starts) + 1, np.int64)
                for r in range(j - i):
                    if ranges[i + r].is_valid:
                        told = np.concatenate([np.frombuffer(x.as_py(), "<i4").reshape(-1, 2) for x in ranges[i + r].values])
                        places = np.unique(spans(told[:, 0].astype(np.int64), (told[:, 1] - told[:, 0] + 1).astype(np.int64)))
                        if single[i + r].is_valid:
                            places = np.setdiff1d(places, single[i + r].values.to_numpy())
                        places = places[places <= counts[r] - window] + first[r]
                        covered[places] += 1
                        np.subtract.at(covered, places + window, 1)
                gone = np.cumsum(covered[:-1]) > 0
                size = (ends - starts)[~gone]
                to = np.cumsum(size + 1) - (size + 1)
                out = np.full(int((size + 1).sum()), 0x20, np.uint8)
                out[spans(to, size)] = own[spans(starts[~gone], size)]
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed = lost[first + counts] - lost[first]
                upto = np.concatenate([to, [len(out)]])
                a, z = first - lost[first], first + counts - lost[first + counts]
                n_words.append(counts)
                n_removed.append(removed)
                kept += [out[upto[x]:max(upto[x], upto[y] - 1)].tobytes().decode() for x, y in zip(a, z)]
            yield pa.RecordBatch.from_arrays(
                b.columns[:kept_columns] + [pa.array(np.concatenate([np.zeros(0, np.int64), *n_words])), pa.array(np.concatenate([np.zeros(0, np.int64), *n_removed])), pa.array(kept, pa.string())],
                b.schema.names[:kept_columns] + ["n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """All columns of ``docs``, and n_words, n_removed, kept (the words that stay, joined
    by one space).  The texts are shuffled once, by document; both joins use that."""
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), text)
    columns = docs.columns
    anchors = docs.select(key.alias("key"), text.alias("text")).mapInArrow(in_turn(__name__, _anchors(window, period, cover)), ANCHOR_SCHEMA)
    repeated = _counted(anchors, repeated=True).groupBy("key").agg(F.collect_set("h").alias("known"))
    # own names for the columns passed through, so that none can clash
    own = [f"__{i}" for i in range(len(columns))]
    rows = docs.select(*[(text.alias("__text") if c == "text" else F.col(f"`{c}`").alias(o)) for c, o in zip(columns, own)],
                       F.col("text").isNull().alias("__null"), key.alias("key"))
    # both joins take all columns, so that one exchange of the texts serves both
    found = rows.join(repeated.hint("shuffle_merge"), "key")
    windows = _counted(found.mapInArrow(in_turn(__name__, _windows(window, period, cover)), HASH_SCHEMA), repeated=False)
    told = windows.groupBy("key").agg(
        F.collect_set("ranges").alias("ranges"), F.collect_set(F.when(F.col("ranges").isNull(), F.col("start"))).alias("single"))
    joined = rows.join(told.hint("shuffle_merge"), "key", "left")
    own = ["__text" if c == "text" else o for c, o in zip(columns, own)]
    joined = joined.select(*own, "__null", "key", "ranges", "single")
    fields = [StructField(o, docs.schema[c].dataType) for c, o in zip(columns, own)] + [StructField("__null", BooleanType())]
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    out = joined.mapInArrow(in_turn(__name__, _remove(window, len(own) + 1)), schema)
    back = [F.when(~F.col("__null"), F.col(o)) if o == "__text" else F.col(o) for o in own]
    return out.select(*[x.alias(c) for x, c in zip(back, columns)], "n_words", "n_removed", "kept")


def op6_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
