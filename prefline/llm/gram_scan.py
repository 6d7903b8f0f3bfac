"""Operator 11, benchmark decontamination (native).

The benchmark's windows of ``WINDOW`` normalised words (a shorter item is one window) are
hashed.  Every window of every document is hashed in the same way and probed against them,
a hit is verified on the words, and the words that any hit covers can be taken out, or the
documents that hold one.  A document is read once; all that leaves the scan is its word
count and its hits.

The set of windows is broadcast if it has at most ``BROADCAST_GRAMS`` rows and
``BROADCAST_BYTES`` of words; a larger one is joined by a shuffle of hashes, both sides
salted, so that a passage which stands in very many documents is spread.

Defined results: null text has no words, and neither has a text of separators only; such
items have no windows and such documents no hits; repeated rows of one id and text give
one result each; an item counts once, whatever number of rows and hits it has; an item
without an id marks words but is not listed; columns of other names pass through where
rows are returned; empty tables give no rows or no hits.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import load, written

WINDOW = 10
# What stands between words, in a lower-cased text and in any text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_GRAMS, BROADCAST_BYTES = 500_000, 32 << 20
SALTS = 32


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, size, item_id): each distinct window of each item, as its words."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    at = own.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    return at.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("gram")).distinct()


class GramSet:
    """A benchmark's windows, written, with what is known of their number and sizes."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_GRAMS):
        self.spark = benchmark.sparkSession
        found = grams(benchmark, window).select("item_id", "size", "gram", F.xxhash64("gram").alias("hash"), F.xxhash64(F.lit(1), "gram").alias("more"))
        self.items = written(found.select("item_id", "hash", "more"), "gram-items")
        sets = found.groupBy("hash", "gram").agg(F.any_value("size").alias("size"), F.any_value("more").alias("more"))
        self.sets = written(sets, "gram-sets")
        bytes_of = F.aggregate("gram", F.lit(0), lambda n, w: n + F.octet_length(w))
        # at most ``window`` rows
        facts = self.sets.groupBy("size").agg(F.count("*").alias("n"), F.sum(bytes_of).alias("bytes")).collect()
        self.sizes = sorted(f["size"] for f in facts)
        self.small = sum(f["n"] for f in facts) <= limit and sum(f["bytes"] for f in facts) <= BROADCAST_BYTES
        rows = self.items.count()
        self.few_items = self.small and rows <= limit

    def probe(self, windows: DataFrame) -> DataFrame:
        """``windows`` (w, at, size, hash) that are in the set or are a document's first
        row (at = 0).  Hashes are verified on the words."""
        first = self.spark.range(1).select(F.lit(0).cast("bigint").alias("hash_"), F.array().cast("array<string>").alias("gram"), F.lit(0).alias("size_"), F.lit(0).cast("bigint").alias("more"))
        known = self.sets.select(F.col("hash").alias("hash_"), "gram", F.col("size").alias("size_"), "more").unionByName(first)
        same = (F.col("hash") == F.col("hash_")) & (F.col("size") == F.col("size_"))
        verified = (F.col("at") == 0) | (F.slice("w", F.greatest("at", F.lit(1)), F.col("size")) == F.col("gram"))
        if self.small:
            return windows.join(F.broadcast(known), same & verified)
        known = known.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # the words of a window travel with it, not those of the whole document
        thin = windows.withColumn("own", F.slice("w", F.greatest("at", F.lit(1)), F.col("size"))).drop("w")
        thin = thin.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        joined = thin.hint("merge").join(known, same & (F.col("salt") == F.col("salt_")))
        return joined.where((F.col("at") == 0) | (F.col("own") == F.col("gram")))


def row_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text; with the id they name equal rows."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


KEY = ["doc_id", "k1", "k2"]


def scan(docs: DataFrame, known: GramSet) -> DataFrame:
    """One row per distinct row of ``docs``: doc_id, k1, k2, copies, n_words, spans (start
    from 1, size and two hashes of each window found, in order of place)."""
    w = docs.select("doc_id", *row_key(F.col("text")), words(F.col("text")).alias("w"))
    n = F.size("w")
    at = w.select(*KEY, "w", n.alias("n_words"), F.explode(F.sequence(F.lit(0), n)).alias("at"))
    sizes = known.sizes or [WINDOW]
    if len(sizes) == 1:
        at = at.withColumn("size", F.when(F.col("at") > 0, F.lit(sizes[0])).otherwise(F.lit(0)))
    else:
        at = at.withColumn("size", F.explode(F.when(F.col("at") > 0, F.array(*map(F.lit, sizes))).otherwise(F.array(F.lit(0)))))
    at = at.where("at + size - 1 <= n_words")
    hashed = F.when(F.col("at") > 0, F.xxhash64(F.slice("w", F.greatest("at", F.lit(1)), F.col("size")))).otherwise(F.lit(0).cast("bigint"))
    found = known.probe(at.withColumn("hash", hashed)).select(*KEY, "n_words", "at", "size", "hash", "more")
    span = F.when(F.col("at") > 0, F.struct(F.col("at").alias("start"), "size", "hash", "more"))
    return found.groupBy(*KEY).agg(
        F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(span)).alias("spans"))


def covered(spans: Column) -> Column:
    """Number of words that the sorted spans cover together."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(acc, s):
        end = s["start"] + s["size"] - 1
        fresh = F.greatest(end - F.greatest(acc["upto"], s["start"] - 1), F.lit(0))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def items_found(found: DataFrame, known: GramSet) -> DataFrame:
    """(doc_id, k1, k2, items): the sorted ids of the items whose windows occur."""
    hits = found.where("size(spans) > 0").select(*KEY, F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["hash"].alias("hash"), s["more"].alias("more"))))).alias("gram"))
    owners = known.items.where("item_id is not null").select(F.struct("hash", "more").alias("of"), "item_id").distinct()
    if known.few_items:
        pairs = hits.join(F.broadcast(owners), F.col("gram") == F.col("of"))
    else:
        owners = owners.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hits.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)))
        pairs = hits.join(owners, (F.col("gram") == F.col("of")) & (F.col("salt") == F.col("salt_")))
    return pairs.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def same_key(names: list[str]) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.col("k1") == F.col(names[1])) & (F.col("k2") == F.col(names[2]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs``; ``remove="spans"``: the words of windows found are cut out
    of the text, each with what stands before it; ``"documents"``: documents that hold one go."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove!r}")
    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col("doc_id").alias("doc_id"), *row_key(F.col("text")))
    hit = scan(docs.select("doc_id", "text"), GramSet(benchmark, window)).where("size(spans) > 0")
    hit = hit.select(F.col("doc_id").alias("of"), F.col("k1").alias("of1"), F.col("k2").alias("of2"), "spans")
    back = lambda df: df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    if remove == "documents":
        return back(rows.join(hit, same_key(["of", "of1", "of2"]), "left_anti"))
    text = names[docs.columns.index("text")]
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + WORD_ANY_CASE), F.lit(0))
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    stays = F.array_except(F.sequence(F.lit(1), F.size("pieces")), inside)
    tail = F.regexp_extract(text, r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    kept = F.concat(F.array_join(F.transform(stays, lambda i: F.col("pieces")[i - 1]), ""), tail)
    joined = rows.join(hit, same_key(["of", "of1", "of2"]), "left")
    joined = joined.withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces))
    return back(joined.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(kept)))


def op11_gram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = GramSet(load(spark, sf_dir, "benchmark"))
    found = written(scan(load(spark, sf_dir, "documents").select("doc_id", "text"), known), "gram-hits")
    items = items_found(found, known).select(F.col("doc_id").alias("of"), F.col("k1").alias("of1"), F.col("k2").alias("of2"), "items")
    rows = found.join(items, same_key(["of", "of1", "of2"]), "left")
    n_hit = covered(F.col("spans"))
    rows = rows.select(
        "doc_id", F.col("n_words").cast("bigint"), n_hit.cast("bigint").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copy", "copies")


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS nr, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
g AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM g),
p AS (
  SELECT nr, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS gram
  FROM (SELECT nr, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, s WHERE len(w) >= size)),
h AS MATERIALIZED (SELECT DISTINCT nr, size, pos, item_id FROM p JOIN g USING (size, gram)),
c AS (SELECT nr, count(DISTINCT word) AS n FROM (SELECT nr, unnest(range(pos, pos + size)) AS word FROM h) GROUP BY nr),
i AS (SELECT nr, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT nr, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY nr)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (nr) LEFT JOIN i USING (nr)
"""
