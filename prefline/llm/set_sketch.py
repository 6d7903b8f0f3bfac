"""Operator 9, near-duplicate documents by SetSketch registers.

A document's set are its distinct five-word shingles.  A register is the least of
exponential variates of the set's members, on an exponentially spaced, truncated scale:
``floor(OFFSET - log_b(min))`` in a byte.  Registers of a union are the larger ones, so
sketches can be merged, and equal registers get likelier the more two sets share.

1. Documents of equal sets form a class, which goes on as its least doc_id.
2. Bands of registers are hashed to buckets.  A bucket is cut into blocks of at most
   ``BLOCK`` members; for each pair of blocks one task estimates all likenesses from
   the registers by their joint likelihood and reports a spanning forest of those that
   may reach the threshold.  So no pairs are emitted, however large a bucket.
3. The components of those reports are clusters.  Their full sets are gathered, again
   in pairs of blocks bounded in members and in shingles, every two sets are intersected
   exactly, and a spanning forest of the true links is reported.
4. The components of the true links are the result.

There are as many bands of 5 as it takes to miss a link of equally large sets at the
threshold with odds of at most 5e-6 (20 at 0.85, 29 at 0.8), and the likelihood test drops
one of a million; step 3 finds such links again where the two are in one cluster by others.
A group of g costs g * g / BLOCK rows, since each member meets every block of its group.  Shingles are told apart by 64-bit hashes.

Defined results: null or blank text: empty set, linked with nothing; fewer than five
words: the whole sequence is the one shingle; equal sets are linked; rows with null
doc_id take no part (component null, kept); rows of one doc_id are one document for
links; other columns pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import FOLD, WORDS, byte_hashes, fan_out, in_turn, load, mix, slices, sorted_runs, spans, utf8, word_spans, written
from .components import components, forest

SHINGLE = 5
ROWS = 5  # registers in a band
MISSED = 5e-6  # odds that all bands miss a link at the threshold
BASE, OFFSET = 1.1, 40
THRESHOLD = 0.85
SLICE_BYTES = 1 << 18
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
SLACK = 12.0  # log-likelihood by which likeness THRESHOLD may fall behind the best


def unequal(share):
    """Odds that a register of one set exceeds the other's, of whose union ``share`` is
    held by the first set only."""
    return -np.log1p(-np.clip(share, 1e-6, 1) * ((BASE - 1) / BASE)) / np.log(BASE)


def bands_for(threshold: float) -> int:
    """The least number of bands of ``ROWS`` registers that miss two sets of one size and
    that likeness with odds of at most ``MISSED``."""
    # sets of one size and likeness j: either holds (1 - j) / 2 of the union alone
    equal = 1 - 2 * float(unequal(0.5 * (1 - threshold)))
    return int(np.ceil(np.log(MISSED) / np.log1p(-equal ** ROWS)))


def seeds(bands: int) -> np.ndarray:
    """Multipliers and summands of the registers' hashes."""
    out = mix(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
    out[0] |= np.uint64(1)
    return out


def shingles(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows' shingles with repeats, shingles per row)."""
    data = FOLD[data]
    starts, ends, counts = word_spans(offsets, data)
    prefix = WORDS.prefix(byte_hashes(data, starts, ends))
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = spans(first, sizes)
    length = np.repeat(np.minimum(counts, SHINGLE), sizes)
    return mix(WORDS.ranges(prefix, at, at + length) + length.astype(np.uint64)), sizes


def registers(hashes: np.ndarray, sizes: np.ndarray, seeded: np.ndarray) -> np.ndarray:
    """(rows, registers) of rows that all have shingles."""
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), seeded.shape[1]), np.uint8)
    for k in range(out.shape[1]):
        low = np.minimum.reduceat(hashes * seeded[0, k] + seeded[1, k], first)
        variate = -np.log1p(-(low.astype(np.float64) + 1) / 2.0 ** 64)
        out[:, k] = np.clip(np.floor(OFFSET - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, 255)
    return out


SKETCH_SCHEMA = "doc_id bigint, n bigint, d1 bigint, d2 bigint, sketch binary"


def _sketch(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeded = seeds(bands)
        for b in batches:
            offsets, data = utf8(b.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                hashes, sizes = shingles(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
                some = sizes > 0
                made = registers(hashes, sizes[some], seeded) if some.any() else np.zeros((0, bands * ROWS), np.uint8)
                cells = iter(made)
                n, d1, d2, sketches = [], [], [], []
                for x in np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []:
                    x = np.unique(x)
                    n.append(len(x))
                    d1.append(int(x.sum().view(np.int64)) if len(x) else 0)
                    d2.append(int(mix(x).sum().view(np.int64)) if len(x) else 0)
                    sketches.append(next(cells).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketches, pa.binary())],
                                                 [c.split()[0] for c in SKETCH_SCHEMA.split(", ")])
    return run


def sketches(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, set size, set digest (two sums of hashes) and registers of every row."""
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(in_turn(__name__, _sketch(bands)), SKETCH_SCHEMA)


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix: may the sets of sketches ``a`` and ``b`` have likeness ``threshold`` or more?

    The registers of one set exceed, fall below or equal the other's with probabilities
    that follow from the set sizes and the likeness; the test compares the likelihood
    at the threshold with the best one at or below it.
    """
    more = np.zeros((len(a), len(b)), np.int16)
    less = np.zeros_like(more)
    for k in range(a.shape[1]):
        more += a[:, k, None] > b[None, :, k]
        less += a[:, k, None] < b[None, :, k]
    u = (n_a[:, None] / (n_a[:, None] + n_b[None, :])).astype(np.float32)
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(u, v)  # no likeness is above the sizes' ratio

    def likelihood(j):
        up, down = unequal(u - v * j), unequal(v - u * j)
        # larger sets have larger registers
        return more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-9))

    at = np.minimum(threshold, most)
    best = np.max([likelihood(at * s) for s in (0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)], axis=0)
    return (most >= threshold * (1 - 1e-6)) & (likelihood(at) >= best - SLACK)


def block_pairs(rows: DataFrame, group: str, blocks) -> DataFrame:
    """A row for every pair of blocks that a member of a group belongs to; a group with
    one block stays whole.  Adds ``low``, ``high`` (the pair) and ``own`` (the block)."""
    rows = rows.withColumn("n_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), "n_blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))).alias("other")
    rows = rows.select("*", other)
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "n_blocks").repartition(
        fan_out(rows.sparkSession), group, "low", "high").sortWithinPartitions(group, "low", "high", "doc_id")


EDGES = "a bigint, b bigint"


def _edges(doc_ids: np.ndarray, x, y) -> pa.RecordBatch:
    links = forest(len(doc_ids), x, y)
    return pa.RecordBatch.from_arrays([pa.array([int(doc_ids[r]) for r, _ in links], pa.int64()), pa.array([int(doc_ids[m]) for _, m in links], pa.int64())], ["a", "b"])


def _estimate(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["bucket", "low", "high"]):
            if t.num_rows < 2:
                continue
            doc_ids, n = t.column("doc_id").to_numpy(), t.column("n").to_numpy().astype(np.float64)
            made = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(doc_ids), -1)
            # a group that the hash filled far over its block is worked off in strips
            for i in range(0, len(doc_ids), 2 * BLOCK):
                part = slice(i, i + 2 * BLOCK)
                x, y = np.nonzero(may_link(made[part], made, n[part], n, threshold))
                yield _edges(doc_ids, (x + i)[x + i < y], y[x + i < y])
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, data = utf8(b.column(1))
        for i, j in slices(offsets, SLICE_BYTES):
            hashes, sizes = shingles(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
            cells = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(cells, pa.binary()), b.column(2).slice(i, j - i), b.column(3).slice(i, j - i)], ["doc_id", "members", "cluster", "n_blocks"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the sets' intersections."""
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
    values = values[order]
    del order
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    del values
    counts = np.diff(np.append(np.flatnonzero(new), len(new)))
    shared = counts > 1
    owner = owner[np.repeat(shared, counts)]
    column = np.repeat(np.arange(int(shared.sum()), dtype=np.int32), counts[shared])
    out = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, z = np.searchsorted(column, [c, c + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[a:z], column[a:z] - c] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["cluster", "low", "high"]):
            if t.num_rows < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
            both = intersections(sets)
            size = np.array([len(s) for s in sets])
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            x, y = np.nonzero(np.triu(linked, 1))
            yield _edges(t.column("doc_id").to_numpy(), x, y)
    return run


def link(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row: the document's set size,
    the least doc_id reachable over links, and whether it is that document."""
    n_bands = bands_for(percent / 100)
    own = written(sketches(docs, n_bands), "sketches")
    digest = ["n", "d1", "d2"]
    some = own.where("n > 0 and doc_id is not null")
    classes = written(some.groupBy(*digest).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "classes")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * ROWS + 1, ROWS)) for k in range(n_bands)])
    banded = classes.select("doc_id", "n", "sketch", F.explode(bands).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    in_buckets = classes.select("doc_id", F.explode(bands).alias("bucket")).join(sizes, "bucket")
    in_buckets = in_buckets.join(classes.select("doc_id", "n", "sketch"), "doc_id")
    dealt = block_pairs(in_buckets, "bucket", F.ceil(F.col("members") / BLOCK))
    reports = dealt.select("bucket", "low", "high", "doc_id", "n", "sketch").mapInArrow(in_turn(__name__, _estimate(percent / 100)), EDGES)
    clusters = written(components(reports), "clusters")
    per_cluster = clusters.join(classes.select(F.col("doc_id").alias("node"), "n"), "node").groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("n_blocks"))
    members = clusters.join(per_cluster, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "n_blocks")
    # rows of one id and several texts each stand for it
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").join(members, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "cluster", "n_blocks")
    full = texts.mapInArrow(in_turn(__name__, _sets), "doc_id bigint, members binary, cluster bigint, n_blocks bigint").where(F.length("members") > 0)
    paired = block_pairs(full, "cluster", F.col("n_blocks")).select("cluster", "low", "high", "doc_id", "members")
    found = written(components(paired.mapInArrow(in_turn(__name__, _verify(percent)), EDGES)), "components")
    to = classes.select(*[F.col(c).alias(f"c_{c}") for c in digest], F.col("doc_id").alias("node")).join(found, "node", "left").select(
        "c_n", "c_d1", "c_d2", F.coalesce("component", "node").alias("component"))
    out = own.drop("sketch").join(to, (F.col("n") == F.col("c_n")) & (F.col("d1") == F.col("c_d1")) & (F.col("d2") == F.col("c_d2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(load(spark, sf_dir, "documents"))
