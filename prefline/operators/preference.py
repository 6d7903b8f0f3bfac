"""Preference rendering (P7, T1-T5, F5, S3) and message-form rows.

``render_flat``: rows ``(query, chosen, rejected)`` -> ``(prompt, chosen, rejected)``
strings, answer format by model family; all three outputs are computed in one
``select`` from the input columns, so no output can read an overwritten input.
``render_messages``: rows whose ``chosen``/``rejected`` are message arrays ->
prompt from ``chosen[:-1]``, answers from the last message of each (T5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefline.config import DEFAULT_EOS, PREFERENCE_SYSTEM_PROMPT
from prefline.functions import templates as TM
from prefline.operators.pairs import successors
from prefline.sources.adapters import preference_form


def render_flat(df: DataFrame, model_name: str, sys_prompt: bool = False, eos: str = DEFAULT_EOS,
                system_text: str = PREFERENCE_SYSTEM_PROMPT) -> DataFrame:
    family = TM.model_family(model_name)
    prompt = TM.user_prompt(F.col("query"), system_text if sys_prompt else None, eos)
    keep = [c for c in df.columns if c not in ("query", "chosen", "rejected", "prompt")]
    return df.select(*keep, prompt.alias("prompt"),
                     TM.answer(F.col("chosen"), family, eos).alias("chosen"),
                     TM.answer(F.col("rejected"), family, eos).alias("rejected"))


def render_messages(df: DataFrame, eos: str = DEFAULT_EOS) -> DataFrame:
    """T5; a ``chosen`` of one message has an empty prompt (the end marker only).
    Rows where either list is null or empty have no answer to render and go."""
    c, r = F.col("chosen"), F.col("rejected")
    keep = [x for x in df.columns if x not in ("chosen", "rejected", "prompt")]
    return (df.where((F.size(c) >= 1) & (F.size(r) >= 1))
            .select(*keep,
                    TM.render(F.slice(c, 1, F.size(c) - 1), eos).alias("prompt"),
                    TM.render(F.array(F.element_at(c, -1)), eos).alias("chosen"),
                    TM.render(F.array(F.element_at(r, -1)), eos).alias("rejected")))


def process(df: DataFrame, model_name: str, dataset_name: str | None = None,
            sys_prompt: bool = False, eos: str = DEFAULT_EOS, flat_name_marker: str | None = None) -> DataFrame:
    """P7 with S3 dispatch on the schema (or a dataset-name rule, see ``preference_form``)."""
    if preference_form(df, dataset_name, flat_name_marker) == "flat":
        return render_flat(df, model_name, sys_prompt, eos)
    return render_messages(df, eos)


def message_preference_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) as message arrays: a conversation's turns in
    order, and the last message of the next existing conversation (T5 reads no
    other one of the rejected messages), which alone moves to its neighbour.
    Rows without an id make no pair.
    """
    rows = conversations.where("conv_id is not null")
    follows = successors(rows.select("conv_id").distinct())
    last = rows.groupBy(F.col("conv_id").alias("next_id")).agg(
        F.max_by(F.struct("role", F.col("text").alias("content")), "turn").alias("last"))
    rejected = follows.join(last, "next_id").select("conv_id", F.array("last").alias("rejected"))
    return conversation_messages(rows).withColumnRenamed("messages", "chosen").join(rejected, "conv_id")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, messages) with messages ordered by turn."""
    item = F.struct("turn", "role", F.col("text").alias("content"))
    return conversations.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(item)),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
