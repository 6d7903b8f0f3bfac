"""Operator 2, document fingerprints: quartile bucket digests.

The byte triplets of a text are hashed into 256 buckets and counted.  A bucket's two
bits say between which quartiles of all bucket counts its count lies; a head byte holds
the length on a logarithmic scale.  The difference of two digests is the sum of the
bucket codes' distances and the lengths' distance, each bounded, so likeness lies in
[0, 1] and is 1 for equal digests.

Defined results: null text: empty; texts of less than three bytes have empty buckets;
the next document is that with the next larger doc_id (null first; among equal ids by
text), after the last the first, of a single one itself; repeated rows stay; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import PIECE_BYTES, fan_out, load, slices, utf8
from .ordered import range_buckets, with_guests

BUCKETS = 256
LENGTH_STEP = 1.2  # base of the length scale
LENGTH_BOUND = 12  # a length distance counts this many steps at most
LENGTH_WEIGHT = 8
# distance of two bucket codes by their difference: opposite quartiles count double
CODE_DISTANCE = np.array([0, 1, 2, 6])
# the score is bounded where unrelated texts of one language lie: likeness 0 there and beyond
SCORE_BOUND = 0.4 * (BUCKETS * 6 + LENGTH_BOUND * LENGTH_WEIGHT)


def digests(texts: list[str]) -> np.ndarray:
    """(texts, 1 + BUCKETS) codes: length step, then bucket quartiles."""
    if not texts:
        return np.zeros((0, 1 + BUCKETS), np.uint8)
    offsets, data = utf8(pa.array(texts, pa.large_string()))
    out = np.zeros((len(texts), 1 + BUCKETS), np.uint8)
    size = np.diff(offsets)
    out[:, 0] = np.minimum(255, np.log1p(size) / np.log(LENGTH_STEP)).astype(np.uint8)
    for i, j in slices(offsets):
        part = data[offsets[i]:offsets[j]].astype(np.uint32)
        if len(part) < 3:
            continue
        triplet = ((part[:-2] | part[1:-1] << 8 | part[2:] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        row = np.repeat(np.arange(j - i, dtype=np.int64) * BUCKETS, size[i:j])[:-2]
        inside = np.ones(len(part) - 2, bool)  # no triplet spans two texts
        for back in (1, 2):
            at = offsets[i + 1:j] - offsets[i] - back
            inside[at[(at >= 0) & (at < len(inside))]] = False
        counts = np.bincount((row + triplet)[inside], minlength=(j - i) * BUCKETS).reshape(-1, BUCKETS)
        ranked = np.sort(counts, axis=1)
        for q in (63, 127, 191):
            out[i:j, 1:] += counts > ranked[:, q:q + 1]
    return out


def encode(codes: np.ndarray) -> list[str]:
    """Hexadecimal digests: two digits of length, then two bits a bucket."""
    quads = codes[:, 1:].reshape(len(codes), -1, 4)
    packed = quads[..., 0] | quads[..., 1] << 2 | quads[..., 2] << 4 | quads[..., 3] << 6
    return [row.tobytes().hex() for row in np.concatenate([codes[:, :1], packed], axis=1)]


def decode(fingerprints: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    quads = np.stack([raw[:, 1:] >> s & 3 for s in (0, 2, 4, 6)], axis=-1).reshape(len(raw), -1)
    return np.concatenate([raw[:, :1], quads], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of digests row by row: 1 less the bounded difference score's share."""
    apart = np.abs(a.astype(np.int16) - b)
    score = CODE_DISTANCE[apart[:, 1:]].sum(axis=1) + LENGTH_WEIGHT * np.minimum(apart[:, 0], LENGTH_BOUND)
    return 1.0 - np.minimum(score, SCORE_BOUND) / SCORE_BOUND


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode(digests(b.column(1).to_pylist())), pa.string())], ["doc_id", "fingerprint"])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


EDIT_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(held: list[tuple]) -> pa.RecordBatch:
    """Results of all held rows but the last, which is the others' end."""
    own = digests([t for *_, t in held])
    pairs = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
    texts = [edited(held[i][3], held[i + 1][3]) for i in pairs]
    changed, mine, after = digests(texts), own[pairs], own[[i + 1 for i in pairs]]
    return pa.RecordBatch.from_arrays([
        pa.array([held[i][2] for i in pairs], pa.int64()), pa.array([len(held[i][3]) for i in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        pa.array(encode(mine), pa.string()), pa.array(encode(changed), pa.string()),
        pa.array(likeness(mine, changed), pa.float64()), pa.array(likeness(mine, after), pa.float64())],
        [c.split()[0] for c in EDIT_SCHEMA.split(", ")])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.append(row)
            size += len(row[3])
            if size >= PIECE_BYTES and len(held) > 1:
                yield _rows(held)
                held, size = held[-1:], 0
    if len(held) > 1:
        yield _rows(held)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how near the edited and the
    next document's are.  The table is shuffled once, into ranges of doc_id."""
    n = fan_out(docs.sparkSession)
    rows = with_guests(range_buckets(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")), n))
    rows = rows.select("bucket", "guest", "doc_id", "text").repartitionById(n, F.col("bucket"))
    return rows.sortWithinPartitions("bucket", "guest", "doc_id", "text").mapInArrow(_compare, EDIT_SCHEMA)


def op2_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(load(spark, sf_dir, "documents"))
