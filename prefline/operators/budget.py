"""Batch scorers whose batches are bounded by tokens.

A model's time and memory for a batch go with its rows times its longest text, so a batch
here takes as many rows as keep that product within ``budget`` (a longer text is a batch of
its own).  Rows are dealt round robin, so that no key and no file decides a task's load, and
sorted by length inside each task, where Spark's sort may spill; so batches hold texts of
like length and little of them is padding.  A task holds one batch at a time.

Truncation (``max_tokens``) cuts each text to its first words on the JVM side.  A null text
goes to the model as an empty one.  The outputs stand in the row of their text, with all its
other columns, so neither repeated keys nor the order of batches matter; a model that does
not return one output list for each text is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefline.functions.text import token_count
from prefline.operators.scorers import OUTPUT_TYPE, register_scorer, truncate_words, word_stat_batch
from prefline.operators.workers import worker_slot

BUDGET = 16_384
_TEXT, _PAIR, _TOKENS = "__budget_text", "__budget_pair", "__budget_tokens"
_MODELS: dict[str, Callable[[list], list]] = {}


def budgeted(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in their order, as tables of at most ``budget`` places (rows
    times the largest ``_TOKENS``, which counts as 1 at least), or of one larger row."""
    held, rows, longest = [], 0, 0
    for batch in batches:
        start = 0
        for i, n in enumerate(batch.column(_TOKENS).to_pylist()):
            widest = max(longest, n, 1)
            if rows and (rows + 1) * widest > budget:
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, rows, start, widest = [], 0, i, max(n, 1)
            rows, longest = rows + 1, widest
        held.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


class BudgetScorer:
    """``factory() -> fn(items) -> [[{label, score}, ...], ...]``, the model built once for
    each Python worker.  An item is a text, or for ``score_pairs`` a dict with ``text`` and
    ``text_pair``.  ``partitions`` is the number of tasks (default: the shuffle partitions)."""

    def __init__(self, name: str, factory: Callable[[], Callable[[list], list]], budget: int = BUDGET,
                 max_tokens: int | None = None, partitions: int | None = None):
        if budget < 1:
            raise ValueError("a batch has room for at least one token")
        self.name, self.factory, self.budget = name, factory, budget
        self.max_tokens, self.partitions = max_tokens, partitions

    def score_frame(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return self._scored(df, [(_TEXT, text)], out)

    def score_pairs(self, df: DataFrame, text: str, text_pair: str, out: str) -> DataFrame:
        return self._scored(df, [(_TEXT, text), (_PAIR, text_pair)], out)

    def _scored(self, df: DataFrame, inputs: list[tuple[str, str]], out: str) -> DataFrame:
        cut = lambda c: truncate_words(c, self.max_tokens) if self.max_tokens else F.col(c)
        staged = df
        for name, column in inputs:
            staged = staged.withColumn(name, F.coalesce(cut(column), F.lit("")))
        partitions = self.partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = staged.repartition(partitions)
        tokens = sum((token_count(name) for name, _ in inputs[1:]), token_count(inputs[0][0]))
        ordered = dealt.withColumn(_TOKENS, tokens).sortWithinPartitions(_TOKENS)
        helpers = [name for name, _ in inputs]
        keep = [c for c in df.columns if c != out]
        schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, OUTPUT_TYPE)])
        return ordered.mapInArrow(_runner(self.factory, worker_slot(self.factory), self.budget, helpers, keep, out), schema)


def _runner(factory, slot: str, budget: int, helpers: list[str], keep: list[str], out: str):
    kind = pa.list_(pa.struct([pa.field("label", pa.string()), pa.field("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if slot not in _MODELS:
            _MODELS[slot] = factory()
        for table in budgeted(batches, budget):
            columns = [table.column(h).to_pylist() for h in helpers]
            items = columns[0] if len(columns) == 1 else [{"text": a, "text_pair": b} for a, b in zip(*columns)]
            outputs = _MODELS[slot](items)
            if len(outputs) != len(items):
                raise ValueError(f"the model gave {len(outputs)} outputs for {len(items)} texts")
            scored = pa.array([[{"label": o["label"], "score": float(o["score"])} for o in row] for row in outputs], kind)
            yield from table.select(keep).append_column(out, scored).combine_chunks().to_batches()
    return run


register_scorer("text-classification:wordstat-batch", lambda: BudgetScorer("wordstat-batch", word_stat_batch))
