"""Source adapters chosen by schema (with the reference's name rule kept as an option).

Query sources come in two shapes:

* nested: ``source, conversation: array<struct<input:string, ...>>`` -> query =
  ``conversation[0].input`` (P4), then ``source``/``conversation`` dropped (P2)
  and ``query`` attached on the same row (P3);
* flat turns: ``conv_id, turn, role, text`` -> the first user turn per conversation.

Preference sources: ``chosen`` as a string (flat form, T3/T4) or as an array of
messages (message form, T5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefline.config import NESTED_SOURCE_MARKER
from prefline.operators.pairs import first_queries


def drop_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns; a missing one is an error (Spark's ``drop`` would ignore it)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*cols)


def nested_reason() -> Column:
    """Why a nested row has no query: its list is null or empty, or its first element has
    no ``input``; null for a row that has one."""
    first = F.get(F.col("conversation"), 0)
    return (F.when(F.col("conversation").isNull(), "null_list").when(F.size("conversation") == 0, "empty_list")
            .when(first["input"].isNull(), "no_input"))


def nested_queries(df: DataFrame) -> DataFrame:
    """First element's ``input``; a row without one keeps a null query, and
    ``nested_reason`` says why."""
    first_input = F.get(F.col("conversation"), 0)["input"]
    return drop_existing(df.withColumn("query", first_input), ["source", "conversation"])


def adapt_queries(df: DataFrame, dataset_name: str | None = None) -> DataFrame:
    """Dispatch on the schema; a ``dataset_name`` containing ``NESTED_SOURCE_MARKER`` forces the nested adapter."""
    if (dataset_name and NESTED_SOURCE_MARKER in dataset_name) or "conversation" in df.columns:
        return nested_queries(df)
    if {"conv_id", "turn", "role", "text"} <= set(df.columns):
        return first_queries(df)
    if "query" in df.columns:
        return df
    raise ValueError(f"no query adapter for columns {df.columns}")


def preference_form(df: DataFrame, dataset_name: str | None = None,
                    flat_name_marker: str | None = None) -> str:
    """S3: 'flat' when ``chosen`` is a string, 'messages' when it is an array.

    The reference chose the form by a substring of the dataset name; that rule
    is available as ``flat_name_marker`` (a dataset name containing it is read
    as flat), but the schema is the default and the safer test.
    """
    if flat_name_marker and dataset_name is not None and flat_name_marker in dataset_name:
        return "flat"
    field = df.schema["chosen"].dataType
    if isinstance(field, T.StringType):
        return "flat"
    if isinstance(field, T.ArrayType):
        return "messages"
    raise ValueError(f"unsupported chosen type {field}")
