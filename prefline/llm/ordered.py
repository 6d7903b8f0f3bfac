"""Rows dealt out in ranges of ascending doc_id, without sorting the whole table twice."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

INF = float("inf")


def range_buckets(docs: DataFrame, n: int) -> DataFrame:
    """Add ``bucket``: ranges of doc_id in ascending order, null first, of about equal
    row counts.  Bounds are approximate quantiles of the id column; n - 1 numbers go to
    the driver.  Equal ids share a bucket."""
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(-INF))
    probs = [i / n for i in range(1, n)]
    bounds = docs.select(F.percentile_approx(key, probs or [0.5], max(10_000, 20 * n)).alias("q")).first()["q"] or []
    inner = sorted({b for b in bounds if b > -INF}) if probs else []
    return Bucketizer(splits=[-INF, *(inner or [0.0]), INF], inputCol="_key", outputCol="_bucket").transform(
        docs.withColumn("_key", key)).withColumn("bucket", F.col("_bucket").cast("int")).drop("_key", "_bucket")


def with_guests(bucketed: DataFrame) -> DataFrame:
    """Each row in its bucket, and the rows with a bucket's smallest id a second time as
    ``guest`` at the end of the bucket before it (of the last bucket, for the first)."""
    firsts = bucketed.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none")).orderBy("bucket").collect()
    if not firsts:
        return bucketed.withColumn("guest", F.lit(False))
    before = [firsts[i - 1]["bucket"] for i in range(len(firsts))]
    # at most one row for each bucket
    table = bucketed.sparkSession.createDataFrame(
        [(f["bucket"], None if f["none"] else f["first"], b) for f, b in zip(firsts, before)], "bucket int, first bigint, before int")
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(
        F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))
    ).otherwise(F.array(F.struct("bucket", F.lit(False).alias("guest"))))
    joined = bucketed.join(F.broadcast(table), "bucket")
    keep = [c for c in bucketed.columns if c != "bucket"]
    return joined.select(*keep, F.explode(places).alias("place")).select(*keep, "place.bucket", "place.guest")
