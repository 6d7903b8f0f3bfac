"""Operator 4, toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words sums, over all three-letter subsequences that span at most
``SPAN`` letters, the product of their weights ``DECAY ** gaps``, normalised by the
words' own sums.  Inserted letters lengthen spans and cost weight, but leave the
subsequences; marks inside a word are skipped, digits read as the letters they
imitate, and single letters in a row are read as one word.

Landmarks are words whose presence tells toxic from other sentences in the training
rows, none too near another.  A text is represented by its nearest word to each
landmark (kernel values below ``FLOOR`` count as none), passed through the inverse root
of the landmarks' own kernel matrix (the Nystroem map).  As a text's value is the largest over
its words, this map is exact for single words and a heuristic for texts.  A linear SVM with squared
hinge loss is fitted on these vectors, and a logistic curve turns its margin into a
score.  Only landmarks, the matrix and the weights reach the tasks.

A word's kernel values are computed once for each piece of text, and only for words
whose bound on them reaches ``FLOOR``.

Training takes at most ``TRAIN_ROWS`` labelled rows of either class, the first by a hash
of doc_id; landmarks are counted over the sentences of these.

Limits: landmarks have 4 to 24 letters, so an insult of three letters is not learnt; the
bytes of letters outside ASCII fold to five symbols, so words of other scripts are told
apart by their lengths and patterns only.

Defined results: null or empty text: the score of a text without any landmark; a
doc_id with several labels is toxic if one says so; null labels are none; repeated
rows are scored each for itself; null doc_id: scored, not held out; without labels of
both classes all scores are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import FOLD, Rolling, fan_out, in_turn, load, mix, slices, utf8, word_spans

TRAIN_ROWS = 10_000
LANDMARKS = 96
SPAN, DECAY = 5, 0.6
FLOOR = 0.35
SLICE_BYTES = 1 << 19
LONGEST, STEP = 24, 12  # longer words are read in overlapping parts
PATTERNS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
WEIGHTS = [DECAY ** (k - 2) for _, k in PATTERNS]
_HASH = Rolling(0xC2B2AE3D27D4EB4F)
# Letters are 1 to 26, the bytes of other letters 27 to 31; marks are 0.  Digits and
# signs read as letters are fixed values.
_LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[0x80:0xC0] = 27 + np.arange(64) % 5
for _sign, _letter in _LOOKS.items():
    SYMBOL[ord(_sign)] = SYMBOL[ord(_letter)]


def units(offsets: np.ndarray, data: np.ndarray):
    """(row, start, end, symbols): the rows' words as ranges of symbols."""
    data = FOLD[data]
    starts, ends, counts = word_spans(offsets, data)
    symbol = SYMBOL[data]
    # a trailing mark is punctuation, not a letter in disguise
    last = ends - 1
    for _ in range(2):
        tail = last[(last >= starts) & (data[last] == 0x21)]
        symbol[tail] = 0
        last = np.where((last > starts) & (symbol[last] == 0), last - 1, last)
    before = np.concatenate([[0], np.cumsum(symbol > 0)])
    a, z, row = before[starts], before[ends], np.repeat(np.arange(len(counts)), counts)
    some = z > a
    a, z, row = a[some], z[some], row[some]
    if not len(a):
        return row, a, z, symbol[symbol > 0]
    single = z - a == 1
    new = np.ones(len(a), bool)
    new[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    first = np.flatnonzero(new)
    a, row, z = a[first], row[first], z[np.append(first[1:], len(z)) - 1]
    size = z - a
    parts = np.maximum(1, -(-(size - LONGEST) // STEP) + 1)
    at = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    row, a, z = np.repeat(row, parts), np.repeat(a, parts) + STEP * at, np.repeat(z, parts)
    z = np.minimum(z, a + LONGEST)
    long = z - a >= 3
    return row[long], a[long], z[long], symbol[symbol > 0]


def matrix(starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(LONGEST + SPAN)
    return np.where(at < ends[:, None], np.append(symbols, 0)[np.minimum(at, len(symbols))], 0)


def subsequences(words: np.ndarray):
    """(codes, weight) per pattern of gaps; code 0 where a word has no such place."""
    n = LONGEST
    for (j, k), weight in zip(PATTERNS, WEIGHTS):
        x, y, z = words[:, :n], words[:, j:n + j], words[:, k:n + k]
        yield np.where(z > 0, x << 10 | y << 5 | z, 0), weight


def features(words: np.ndarray) -> np.ndarray:
    """Dense, normalised subsequence weights (words, 32768); for a few words only."""
    out = np.zeros((len(words), 1 << 15), np.float32)
    for codes, weight in subsequences(words):
        np.add.at(out, (np.arange(len(words))[:, None], codes), weight)
    out[:, 0] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def spell(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), np.uint8)
    _, a, z, symbols = units(np.array([0, len(raw)]), raw)
    return matrix(a[:1], z[:1], symbols)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the kernel values: Nystroem map and SVM in one
    bias: float
    slope: float
    shift: float


class Nearest:
    """Kernel values of each text's nearest word to each landmark."""

    def __init__(self, landmarks: list[str]):
        dense = features(np.concatenate([spell(w) for w in landmarks]))
        used = np.flatnonzero(dense.any(axis=0))
        self.column = np.full(1 << 15, len(used), np.int64)
        self.column[used] = np.arange(len(used))
        self.table = np.concatenate([dense[:, used], np.zeros((len(dense), 1), np.float32)], axis=1)
        self.bound = np.append(self.table.max(axis=0)[:-1], 0)[self.column].astype(np.float32)
        self.bound[0] = 0

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.table)), np.float32)
        row, a, z, symbols = units(offsets, data)
        if not len(a):
            return out
        prefix = _HASH.prefix(mix(symbols.astype(np.uint64)))
        keys, index, inverse = np.unique(mix(_HASH.ranges(prefix, a, z) + (z - a).astype(np.uint64)), return_index=True, return_inverse=True)
        words = matrix(a[index], z[index], symbols)
        most, own = np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
        for codes, weight in subsequences(words):
            most += weight * self.bound[codes].sum(axis=1)
            own += weight * weight * (codes > 0).sum(axis=1)
        own = np.sqrt(np.maximum(own, 1e-9))
        near = np.flatnonzero(most >= FLOOR * own)
        value = np.zeros((len(near), len(self.table)), np.float32)
        for i in range(0, len(near), 1024):
            part = near[i:i + 1024]
            found = np.zeros((len(part), self.table.shape[1]), np.float32)
            for codes, weight in subsequences(words[part]):
                np.add.at(found, (np.arange(len(part))[:, None], self.column[codes]), weight)
            value[i:i + 1024] = found @ self.table.T / own[part, None]
        value = np.where(value >= FLOOR, np.minimum(value, 1), 0)
        place = np.full(len(words), -1)
        place[near] = np.arange(len(near))
        hit = np.flatnonzero(place[inverse] >= 0)
        np.maximum.at(out, row[hit], value[place[inverse[hit]]])
        return out


def _vectors(landmarks: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(landmarks)
        for b in batches:
            offsets, data = utf8(b.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                made = nearest(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in made], pa.binary())], ["toxic", "vector"])
    return run


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighted alike: accelerated gradients."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    pace = 1 / (2 * np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2 + penalty)
    w = old = np.zeros(x.shape[1])
    for k in range(rounds):
        at = w + k / (k + 3) * (w - old)
        lack = np.maximum(0, 1 - sign * (x @ at))
        old, w = w, at - pace * (-2 * x.T @ (share * sign * lack) + penalty * at)
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the margin by Newton steps."""
    x, w = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + 1e-4 * w), -5, 5)
    return float(w[0]), float(w[1])


def train(texts: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on texts (doc_id, text) with a label.  To the driver go candidate words and
    the vectors of at most ``2 * train_rows`` rows."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(order).limit(train_rows).unionByName(marked.where("toxic = 0").orderBy(order).limit(train_rows))
    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.repartition(fan_out(texts.sparkSession), "doc_id").persist()
    try:
        total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not total.get(1) or not total.get(0):
            return None
        words = F.split(F.lower("text"), r"[\s\p{Punct}]+")
        # words and their first five letters: a stem is seen more often than its forms
        words = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.left(w, F.lit(5)))))
        words = rows.select("toxic", F.explode(words).alias("word")).where("length(word) between 4 and 24")
        p = F.sum("toxic") / total[1]
        q = F.sum(1 - F.col("toxic")) / total[0]
        ranked = words.groupBy("word").agg((p - q).alias("gain"), ((p - q) / F.sqrt(p + q + 1e-9)).alias("tell"), F.sum("toxic").alias("n"))
        best = ranked.where("n >= 3 and gain > 0").orderBy(F.desc("tell"), "word").limit(8 * landmarks).collect()
        picked: list[str] = []
        known = np.zeros((0, 1 << 15), np.float32)
        for r in best:
            if len(picked) < landmarks and len(spell(r["word"])):
                f = features(spell(r["word"]))
                if not len(known) or float((known @ f[0]).max()) < 0.75:
                    picked.append(r["word"])
                    known = np.concatenate([known, f])
        if not picked:
            return None
        got = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(in_turn(__name__, _vectors(picked)), "toxic int, vector binary").toPandas()
    finally:
        rows.unpersist()
    values = np.stack([np.frombuffer(v, np.float32) for v in got["vector"]]).astype(np.float64)
    y = got["toxic"].to_numpy()
    kernel = (known @ known.T).astype(np.float64)
    size, axes = np.linalg.eigh(kernel)
    root = axes @ np.diag(1 / np.sqrt(np.maximum(size, 1e-3))) @ axes.T
    w, bias = fit_svm(values @ root, y)
    weights = root @ w
    slope, shift = fit_curve(values @ weights + bias, y)
    return Model(picked, weights, bias, slope, shift)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` and ``score``; one pass, no shuffle."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    own = [f"__{i}" for i in range(len(docs.columns))]
    renamed, text = docs.toDF(*own), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(model.landmarks)
        for b in batches:
            offsets, data = utf8(b.column(text).fill_null(""))
            parts = [nearest(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]) @ model.weights for i, j in slices(offsets, SLICE_BYTES)]
            margin = np.concatenate([np.zeros(0), *parts]) + model.bias
            out = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -60, 60)))
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(out, pa.float64())], b.schema.names + ["score"])

    schema = StructType([StructField(o, f.dataType) for o, f in zip(own, docs.schema.fields)] + [StructField("score", DoubleType())])
    return renamed.mapInArrow(in_turn(__name__, run), schema).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)], "score")


def held_out(doc_id: Column) -> Column:
    """Whether no label of that document may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
