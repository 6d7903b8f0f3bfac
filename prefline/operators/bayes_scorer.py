"""A trained text scorer that SQL can repeat: multinomial naive Bayes on word counts.

Training is one grouped count of words by label.  A word's weight is the logarithm of the
ratio of its smoothed shares under label 1 and label 0, kept as a whole number of
``UNIT``ths, so that a text's score, a sum, does not depend on the order of its words.

Scoring looks every word up.  The most frequent words of the training texts, at most
``HEAD`` of at most ``HEAD_BYTES`` bytes, are broadcast; where to cut is read from a count
of words by level of frequency.  If other words are left, a text's words that are not
among the broadcast ones are counted where the text is read, and only those counts are
shuffled to the rest of the weights, which are repeated under ``SALTS`` salts, so that a
word which training hardly saw but which stands in very many texts is spread.  If none is
left, as the counts by level show, nothing but one row for each text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefline.functions.text import h8, words
from prefline.session import reliable_checkpoint
from prefline.sources.tables import spread

UNIT = 1_000_000
HEAD, HEAD_BYTES = 1 << 20, 32  # so at most 32 MB of words
LEVELS = 8  # steps of frequency for each doubling
SALTS = 16
KEY = ["_id", "_h1", "_h2"]


@dataclass(frozen=True)
class BayesModel:
    """``weights`` (tok, weight, head: whether it is broadcast), the score of a text
    without known words, and the number of words that are not broadcast."""

    weights: DataFrame
    prior: int
    tail_words: int


def _head_level(levels: list) -> int:
    """The lowest level whose short words, with those of all higher levels, are at most ``HEAD``."""
    least, held = 1 << 30, 0
    for level, short in sorted(((r["level"], r["short"]) for r in levels), reverse=True):
        held += short
        if held > HEAD:
            break
        least = level
    return least


def train(labelled: DataFrame, text: str = "text", label: str = "label") -> BayesModel:
    """Fit on rows with label 0 or 1; others, and null texts, are ignored."""
    rows = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull()).select(F.col(label).alias("_y"), F.col(text).alias("_t"))
    one = lambda y: F.sum(F.when(F.col("_y") == y, 1).otherwise(0))
    # the row count of each label travels with the words, as a word that no text holds
    marked = spread(rows).select("_y", F.explode(F.concat(F.array(F.lit(None).cast("string")), words("_t"))).alias("tok"))
    counts = reliable_checkpoint(marked.groupBy("tok").agg(one(1).alias("n1"), one(0).alias("n0")))
    seen = counts.where("tok is not null")
    total = seen.agg(F.count("*").alias("v"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"), F.coalesce(F.sum("n0"), F.lit(0)).alias("n0")).first()
    docs = counts.where("tok is null").first()
    yes, no = (docs["n1"], docs["n0"]) if docs else (0, 0)
    number = lambda c: c.cast("double")
    ratio = (number(F.col("n1") + 1) * F.lit(float(total["n0"] + total["v"]))) / (number(F.col("n0") + 1) * F.lit(float(total["n1"] + total["v"])))
    # at most LEVELS rows for each doubling of the highest count reach the driver
    level, fits = F.floor(F.log2(number(F.col("n1") + F.col("n0"))) * LEVELS), F.octet_length("tok") <= HEAD_BYTES
    levels = seen.groupBy(level.alias("level")).agg(F.count("*").alias("all"), F.sum(fits.cast("int")).alias("short")).collect()
    least = _head_level(levels)
    tail = sum(r["all"] - (r["short"] if r["level"] >= least else 0) for r in levels)
    weights = seen.select("tok", F.round(F.ln(ratio) * UNIT).cast("bigint").alias("weight"), ((level >= least) & fits).alias("head"))
    prior = weights.sparkSession.range(1).select(F.round(F.ln(F.lit((yes + 1.0) / (no + 1.0))) * UNIT).cast("bigint").alias("p")).first()["p"]
    return BayesModel(weights, prior, tail)


def score(docs: DataFrame, model: BayesModel, key: str, text: str = "text", out: str = "score") -> DataFrame:
    """(key, out): the log odds of label 1 in ``UNIT``ths, a row for every row of ``docs``.
    Words that training did not see count nothing; null texts have no words; rows that
    share a key are told apart by their texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    items = spread(docs.select(key, text)).select(
        F.col(key).alias("_id"), F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(1), t).alias("_h2"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), words(t))).alias("_tok"))
    found = items.join(F.broadcast(model.weights.where("head").select("tok", "weight")), F.col("_tok") == F.col("tok"), "left")
    copies = F.sum(F.when(F.col("_tok").isNull(), 1).otherwise(0)).alias("_copies")
    if not model.tail_words:
        scored = found.groupBy(*KEY).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("_sum"), copies)
    else:
        scored = _with_tail(found, copies, model.weights.where("not head"))
    value = (F.lit(model.prior) + F.expr("_sum div _copies")).cast("bigint")  # copies share a text, hence a sum
    return scored.select(F.col("_id").alias(key), value.alias(out), F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("col")


def _with_tail(found: DataFrame, copies: Column, rest: DataFrame) -> DataFrame:
    """Sums of known weights for each text, those of ``rest`` looked up for the words not found."""
    # per text: one row for what is known so far (null), and one for each other word
    missed = F.when(F.col("weight").isNull(), F.col("_tok"))
    per_text = found.groupBy(*KEY, missed.alias("_missed")).agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("_sum"), F.count("*").alias("_n"), copies)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    tail = rest.select(F.col("tok").alias("_of"), F.col("weight").alias("_w"), salts.alias("_of_salt"))
    # rows without a missed word are spread by their hash; no word begins with a zero byte
    looked = F.coalesce("_missed", F.concat(F.lit("\0"), F.col("_h1").cast("string")))
    per_text = per_text.withColumn("_look", looked).withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)))
    joined = per_text.join(tail, (F.col("_look") == F.col("_of")) & (F.col("_salt") == F.col("_of_salt")), "left")
    known = F.col("_sum") + F.col("_n") * F.coalesce("_w", F.lit(0))
    return joined.groupBy(*KEY).agg(F.sum(known).alias("_sum"), F.sum("_copies").alias("_copies"))


def held_out(key: str) -> Column:
    """One row in five, by a hash of its key, is not trained on."""
    return h8("bayes", key) % 5 == 0
