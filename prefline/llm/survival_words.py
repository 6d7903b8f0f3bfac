"""Operator 12, filter interaction audit by truth-table survival words.

Each document becomes one 32-bit word: bit S is set if the document survives the subset S
of the five filters (bit i of S: filter i is applied), that is, if it fails none of them.
Positional popcounts of these words by carry-save adders count the survivors of all 32
subsets at once, for each part and label.  Every figure of every order of the filters is
a difference of two such counts, so the documents are read once, whatever is asked.

Whether a text repeats that of a smaller doc_id is settled by classes of equal texts (by
SHA-256).  Classes that hold more than one in ``HOT`` of the rows, fewer than ``HOT``
in all, are broadcast; all others are joined by a shuffle of digests, and the labels by a
shuffle of ids, however small Spark takes them to be: no table that grows with the input
goes through the driver.

Defined results: null text: empty; null lang: the part with the empty name, together with
an empty lang; a null doc_id is smaller than none and none is smaller than it, and it has
no labels; rows that share an id and a text are not smaller than each other; of several
labels of one id, any that is 1 counts; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import load, written

FILTERS = "ABCDE"
# Fixed values of the filters.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
WORD, UPPER, SYMBOL = r"[^\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"
HOT = 2000
SALTS = 16
HELD_WORDS, HELD_PARTS = 1 << 17, 1 << 12
# bit S of SURVIVES[f]: a document that fails the filters f survives the subset S
SURVIVES = np.array([sum(1 << s for s in range(32) if not f & s) for f in range(32)], np.uint32)


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words).cast("bigint"), F.size(F.array_distinct(words)).cast("bigint")
    fails = [n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n,
             100 * F.regexp_count(text, F.lit(UPPER)).cast("bigint") > UPPER_PERCENT * F.length(text).cast("bigint"), text.rlike(SYMBOL)]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails): the filters that each document fails, as bits A to E."""
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select("doc_id", part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("own"))
    rows = written(rows, "filter-failures")
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = classes.where("first < last")
    total = rows.count()
    hot = F.broadcast(shared.where(F.col("n") * HOT > total).select("digest", "first"))  # fewer than HOT rows
    rare = shared.where(F.col("n") * HOT <= total).select("digest", "first")
    known = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(rare.hint("merge"), "digest", "left")
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return known.unionByName(rest).select("doc_id", "part", (F.col("own") + F.when(repeats, F.lit(16)).otherwise(F.lit(0))).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the class of the labels: bit 0 quality, bit 1 toxic.  Rows are salted by their
    partition, so that one id (or none) on very many rows is spread.  The join is by merge:
    Spark estimates the labels by their files, without the copies under each salt, and
    would broadcast them at some 300 times that size."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg((is_one("quality") + 2 * is_one("toxic")).alias("label")).where("label > 0")
    marks = marks.select("of", "label", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("of_salt"))
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    joined = rows.join(marks.hint("merge"), (F.col("of") == F.col("doc_id")) & (F.col("of_salt") == F.col("salt")), "left")
    return joined.select("part", F.coalesce("label", F.lit(0)).alias("label"), "fails")


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set.  A carry-save adder turns three
    words of one weight into a sum of that weight and a carry of twice the weight; what
    is left at each weight, at most two words, is counted bit by bit."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third:2 * third], words[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third:]])
        for w in words.tolist():
            counts += weight * ((w >> np.arange(32)) & 1)
        words = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight *= 2
    return counts


COUNTS = "part string, label int, survivors array<bigint>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subset survivors of a task's words for each part and label."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    totals: dict[tuple[str, int], np.ndarray] = {}
    size = 0

    def reduce():
        for key, arrays in held.items():
            totals[key] = totals.get(key, 0) + positional_popcount(np.concatenate(arrays))
        held.clear()

    def rows():
        keys = list(totals)
        out = pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.int32()), pa.array([totals[k] for k in keys], pa.list_(pa.int64()))],
            [c.split()[0] for c in COUNTS.split(", ")])
        totals.clear()
        return out

    for b in batches:
        coded = b.column("part").dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        code = codes * 4 + b.column("label").to_numpy()
        words = SURVIVES[b.column("fails").to_numpy()]
        order = np.argsort(code, kind="stable")
        met, first = np.unique(code[order], return_index=True)
        for c, own in zip(met.tolist(), np.split(words[order], first[1:])):
            held.setdefault((names[c // 4], c % 4), []).append(own)
        size += len(words)
        if size >= HELD_WORDS:
            reduce()
            size = 0
        if len(held) + len(totals) > HELD_PARTS:  # very many parts: hand on what is there
            reduce()
            yield rows()
            size = 0
    reduce()
    if totals:
        yield rows()


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: arrays ``every``, ``good`` and ``toxic`` with the survivors of
    each of the 32 subsets (index: the subset's bits)."""
    words = with_labels(failures(docs), labels)
    counts = words.mapInArrow(_count, COUNTS)

    def total(kept: Column) -> Column:
        return F.array(*[F.sum(F.when(kept, F.col("survivors")[s]).otherwise(F.lit(0))) for s in range(32)])

    return counts.groupBy("part").agg(
        total(F.lit(True)).alias("every"), total(F.col("label").bitwiseAND(1) == 1).alias("good"), total(F.col("label").bitwiseAND(2) == 2).alias("toxic"))


def with_steps(counts: DataFrame) -> DataFrame:
    """Each row with each step of each of the 120 orders: filter_order, step, the bit of
    the step's filter, the bits of those ``before`` it and ``after`` it."""
    orders = ["".join(o) for o in permutations(FILTERS)]
    rows = counts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: F.expr(f"shiftleft(1, ascii(substring(filter_order, {at}, 1)) - {ord(FILTERS[0])})")
    earlier = [F.when(F.col("step") > i, bit(i)).otherwise(F.lit(0)) for i in range(1, len(FILTERS))]
    rows = rows.withColumn("bit", bit("step")).withColumn("before", sum(earlier[1:], earlier[0]))
    return rows.withColumn("after", F.col("before") + F.col("bit"))


def audit(counts: DataFrame) -> DataFrame:
    """All figures of all steps of all orders, for each part of ``survivors``."""
    rows = with_steps(counts)
    at = lambda array, subset: F.get(F.col(array), subset)
    lost = lambda array: at(array, F.col("before")) - at(array, F.col("after"))
    fails = at("every", F.lit(0)) - at("every", F.col("bit"))
    # over all orders: a set of s filters stands before a filter in s! * (4 - s)! of them
    shares = []
    for s in range(16):
        # the s-th set of the four other filters, with the filter's own place left out
        low = F.expr(f"({s} & (bit - 1)) + (({s} & ~(bit - 1)) << 1)")
        size = bin(s).count("1")
        times = [24, 6, 4, 6, 24][size]
        shares.append(times * (at("every", low) - at("every", low + F.col("bit"))))
    return rows.select(
        "part", "filter_order", "step", at("every", F.col("after")).alias("kept"), lost("every").alias("removed"),
        (fails - lost("every")).alias("redundant"),
        (at("every", F.lit(31) - F.col("bit")) - at("every", F.lit(31))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), sum(shares[1:], shares[0]).alias("shapley"))


def op12_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(survivors(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
i AS (SELECT unnest(range(5)) AS i),
o AS (
  SELECT row_number() OVER () AS nr, [a.i, b.i, c.i, d.i, e.i] AS o,
    array_to_string([chr((65 + x)::INT) FOR x IN [a.i, b.i, c.i, d.i, e.i]], '') AS filter_order
  FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
masks AS (
  SELECT part, good, bad, [coalesce(x, false) FOR x IN fails] AS fails, count(*) AS n FROM f GROUP BY ALL),
s AS (
  SELECT part, filter_order, step, o[step] AS filter, good, bad, n,
    fails[o[step] + 1] AS own, list_bool_or([fails[x + 1] FOR x IN o[1:step - 1]]) IS TRUE AS earlier,
    len([x FOR x IN fails IF x]) = 1 AND fails[o[step] + 1] AS alone
  FROM masks, o, range(1, 6) t(step)),
g AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN own AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN own AND NOT earlier AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN own AND NOT earlier AND bad = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM g
"""
