"""Evaluate-once columns.

Catalyst pushes a filter on a computed column below the projection that
computes it (and below a round-robin repartition), substituting the
expression: an expensive expression (regex tokenisation, a scoring chain) is
then evaluated twice per row, once in the filter and once in the projection,
and possibly before the repartition that was meant to parallelise it.

Producing the columns through a one-element ``inline`` (a generator) makes
them generator output: filters on them stay above it, so each expression runs
exactly once per row, after any preceding exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` plus the named columns, each computed once per row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
