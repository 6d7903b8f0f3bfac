"""Preference rows from a flat turn table, keyed by conversation id.

``conversations(conv_id, turn, role, text)`` -> ``(conv_id, query, chosen, rejected)``:
the first user turn is the query, the first assistant turn the chosen answer,
and the first assistant turn of the *next answered* conversation the rejected
one.  Ids may be any integers: the next one is the next that exists, in
ascending order, and the first follows the last.

Plan: the ids of answered conversations are range-sorted and checkpointed
(keys only); a lead inside each sorted partition, and one row per partition for
the step to the next partition, give the successor of every id.  The texts are
aggregated once by conversation (partial map-side, so a conversation with very
many turns is one row per map task); then only the answers move, to the
conversation they are rejected in.

Rows without a query, an answer or an id make no pair; ``incomplete`` lists
them with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefline.session import reliable_checkpoint


def _first(value, role: str):
    return F.min_by(value, F.when(F.col("role") == role, F.col("turn")))


def _has_parts(conversations: DataFrame) -> DataFrame:
    """(conv_id, has_query, has_answer); reads no more of a text than whether it is there."""
    there = F.col("text").isNotNull()
    return conversations.groupBy("conv_id").agg(
        F.coalesce(_first(there, "user"), F.lit(False)).alias("has_query"),
        F.coalesce(_first(there, "assistant"), F.lit(False)).alias("has_answer"))


def successors(ids: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, next_id) for distinct, non-null ids: the next larger one, after the last the first.

    One row per partition reaches the driver.
    """
    ordered = reliable_checkpoint(ids.select(key).orderBy(key))
    placed = ordered.select(key, F.spark_partition_id().alias("_pid"))
    starts = placed.groupBy("_pid").agg(F.min(key).alias("low")).orderBy("_pid").collect()
    after = [(s["_pid"], starts[(i + 1) % len(starts)]["low"]) for i, s in enumerate(starts)]
    kind = ids.schema[key].dataType.simpleString()
    table = ids.sparkSession.createDataFrame(after, f"_pid int, _after {kind}")
    lead = F.lead(key).over(Window.partitionBy("_pid").orderBy(key))
    led = placed.select(key, "_pid", lead.alias("_lead"))
    return led.join(F.broadcast(table), "_pid").select(key, F.coalesce("_lead", "_after").alias("next_id"))


def pair_keys(conversations: DataFrame) -> DataFrame:
    """The conv_id of every preference pair, without its texts: a pair needs a query
    and an answer, and there is always a next answered conversation."""
    return _has_parts(conversations).where("conv_id is not null and has_query and has_answer").select("conv_id")


def incomplete(conversations: DataFrame) -> DataFrame:
    """(conv_id, reason) of the conversations that make no pair."""
    reason = F.when(F.col("conv_id").isNull(), "null_id").when(~F.col("has_query"), "no_query").when(~F.col("has_answer"), "no_answer")
    return _has_parts(conversations).select("conv_id", reason.alias("reason")).where("reason is not null")


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, query, chosen, rejected)."""
    answered = _has_parts(conversations).where("conv_id is not null and has_answer")
    follows = successors(answered.select("conv_id"))
    firsts = conversations.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(
        _first(F.col("text"), "user").alias("query"), _first(F.col("text"), "assistant").alias("chosen"))
    rejected = firsts.where("chosen is not null").select(F.col("conv_id").alias("next_id"), F.col("chosen").alias("rejected"))
    rejected = follows.join(rejected, "next_id").select("conv_id", "rejected")
    own = firsts.where("query is not null and chosen is not null")
    return own.join(rejected, "conv_id").select("conv_id", "query", "chosen", "rejected")


def rollout(pairs: DataFrame) -> DataFrame:
    """Rollout frame: response = chosen, ref_response = rejected (keyed, one row per sample)."""
    return pairs.select("conv_id", "query", F.col("chosen").alias("response"),
                        F.col("rejected").alias("ref_response"))


def first_queries(conversations: DataFrame) -> DataFrame:
    """P4 on flat turns: the first user turn per conversation.

    The role filter is applied before the aggregate so it reaches the Parquet scan.
    """
    return (conversations.where(F.col("role") == "user")
            .groupBy("conv_id").agg(F.min_by("text", "turn").alias("query")))
