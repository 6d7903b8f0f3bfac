"""Route rows the reference would crash on to a quarantine table with a reason.

The checks that need the text run before any join, on a narrow projection, so
the label lookup is a left join of ``(doc_id, reason)`` with the distinct label
keys: one pass over the text (the regex runs once), no text moved by the join,
and Spark picks a broadcast or a shuffle join from the label side's size.  The
reason filter sits above the join, so it is not pushed under it and cannot
duplicate the regex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefline.functions.text import word_count
from prefline.sources.tables import spread


def text_reason(text: str = "text", min_words: int = 2):
    t = F.col(text)
    return F.when(t.isNull(), F.lit("null_text")) \
        .when(word_count(t) < min_words, F.lit("too_short"))


def quarantine(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
               min_words: int = 2) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good = rows passing the text checks that have a label (with the
    label columns); bad = ``(key, reason)`` with the first failing check:
    null_text, too_short, missing_label."""
    checks = spread(docs.select(key, text)).select(key, text_reason(text, min_words).alias("_r"))
    label_keys = labels.select(key).distinct().withColumn("_labelled", F.lit(True))
    reason = F.coalesce(F.col("_r"), F.when(F.col("_labelled").isNull(), F.lit("missing_label")))
    bad = checks.join(label_keys, key, "left").select(key, reason.alias("reason")) \
        .where(F.col("reason").isNotNull())
    good = docs.where(text_reason(text, min_words).isNull()).join(labels, key, "inner")
    return good, bad
