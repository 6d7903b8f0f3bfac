"""Batch generation for the policy and the reference model.

``generate`` runs a pluggable generator inside ``mapInPandas``: each Arrow
batch arrives as a pandas frame, is turned into the collator's dict of column
lists (P8), and the generator returns two answer lists.  The generator is
built once per Python worker (a model load) and reused for every batch; the
batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.  The work is
spread by Spark's partitions, one batch stream per task.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from prefline.operators.workers import worker_slot

_WORD = regex.compile(r"[\p{L}\p{N}_]+")
_GENERATORS: dict = {}

Generator = Callable[[dict], tuple[list, list]]


def collate(pdf: pd.DataFrame) -> dict:
    """A batch of rows as a dict of column lists."""
    return {c: pdf[c].tolist() for c in pdf.columns}


class EchoGenerator:
    """Deterministic stand-in: the policy answers with the query's words reversed,
    the reference model with the words in order; both at most ``max_new_tokens`` if set.
    Checkable against SQL; it models nothing."""

    def __init__(self, max_new_tokens: int | None = None):
        self.max_new_tokens = max_new_tokens

    def __call__(self, batch: dict) -> tuple[list, list]:
        resp, ref = [], []
        for q in batch["query"]:
            if q is None:
                resp.append(None)
                ref.append(None)
                continue
            toks = _WORD.findall(q.lower())
            resp.append(" ".join(toks[::-1][: self.max_new_tokens]))
            ref.append(" ".join(toks[: self.max_new_tokens]))
        return resp, ref


def generate(df: DataFrame, factory: Callable[[], Generator] = EchoGenerator, key: str = "conv_id",
             query: str = "query") -> DataFrame:
    """(key, query, response, ref_response) for every row of ``df``."""
    slot = worker_slot(factory)  # one generator per Python worker and factory object

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = _GENERATORS.get(slot)
        if gen is None:
            gen = _GENERATORS[slot] = factory()
        for pdf in batches:
            resp, ref = gen(collate(pdf))
            yield pd.DataFrame({key: pdf[key], query: pdf[query], "response": resp, "ref_response": ref})

    schema = f"{key} bigint, {query} string, response string, ref_response string"
    return df.select(key, query).mapInPandas(run, schema)
