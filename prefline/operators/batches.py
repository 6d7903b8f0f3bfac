"""T8 with padding to the longest of a batch (and P9's ``padding`` option).

Rows of like length are dealt into batches of ``batch_size``, and each batch is padded to
its own longest row, so little is padding.  The rows are numbered in order of length by a
range sort and one count for each partition (``dense_order_ids``); there is no global
window, and no group holds more than one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefline.config import TokenConfig
from prefline.functions.text import h8
from prefline.operators.tokens import attention_mask, dense_order_ids, pad


def length_batches(df: DataFrame, key: str, ids: str, batch_size: int, seed: str = "batch") -> DataFrame:
    """Add ``batch`` (from 0, by ascending length; rows of one length in a hashed order,
    the last batch may be smaller), ``batch_length`` (its longest) and ``n_tokens``.
    A null id list is an empty one."""
    if batch_size < 1:
        raise ValueError("a batch holds at least one row")
    lists = F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType))
    df = df.withColumn(ids, lists).withColumn("n_tokens", F.size(ids).cast("bigint")).withColumn("_order", h8(seed, key))
    numbered = dense_order_ids(df, ["n_tokens", "_order", key, ids], out="_row")
    numbered = numbered.withColumn("batch", F.expr(f"_row div {batch_size}"))
    longest = numbered.groupBy("batch").agg(F.max("n_tokens").alias("batch_length"))
    return numbered.join(longest, "batch").select(*df.columns, "batch", "batch_length").drop("_order")


def pad_batches(batched: DataFrame, ids: str, cfg: TokenConfig = TokenConfig(), side: str = "left",
                multiple: int = 1) -> DataFrame:
    """``ids`` padded to the batch's longest row, raised to a ``multiple``, and ``attention_mask``."""
    if multiple > 1:
        batched = batched.withColumn("batch_length", F.ceil(F.col("batch_length") / multiple) * multiple)
    length = F.col("batch_length").cast("int")
    mask = attention_mask(ids, length, side)
    return batched.withColumn("attention_mask", mask).withColumn(ids, pad(ids, length, side, cfg.effective_pad_id))


def padding_share(batched: DataFrame) -> DataFrame:
    """One row: tokens, slots (padded places in all) and the share that is padding."""
    total = batched.agg(F.sum("n_tokens").alias("tokens"), F.sum("batch_length").alias("slots"))
    share = F.when(F.col("slots") > 0, (F.col("slots") - F.col("tokens")) / F.col("slots"))
    return total.select("tokens", "slots", share.alias("padding_share"))
