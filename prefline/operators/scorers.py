"""Scorers (U4, U5, R9, R10): text -> ``array<struct<label:string, score:double>>``.

A scorer adds its output array to a frame with ``score_frame(df, text, out)``
(pair scorers: ``score_frame(df, text, text_pair, out)``); most also offer the
bare column form ``outputs(text[, text_pair]) -> Column``.  Three kinds exist:

* native scorers: column expressions, fused into the surrounding stage;
* ``PandasTextScorer`` / ``PandasPairScorer``: wrap a Python batch callable
  (a model pipeline) as an Arrow-batched ``pandas_udf``; the model is built once
  per Python worker and reused across batches;
* the trainable scorer of ``prefline.operators.ml_scorer`` (E6).

The native stand-ins below are deterministic functions of word statistics,
chosen so that every branch of the reward code is exercised.  They say
nothing about human authorship.
"""

from __future__ import annotations

from typing import Callable, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefline.config import RAW_DETECTOR_MARKER, SCORER_MAX_TOKENS, WORD_PATTERN
from prefline.functions.text import distinct_count, words
from prefline.operators.workers import worker_slot

OUTPUT_TYPE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                        T.StructField("score", T.DoubleType())]))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


class TextScorer(Protocol):
    name: str

    def score_frame(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class PairScorer(Protocol):
    name: str

    def score_frame(self, df: DataFrame, text: str, text_pair: str, out: str) -> DataFrame: ...


def output_entry(label: str, score) -> Column:
    return F.struct(F.lit(label).alias("label"), score.cast("double").alias("score"))


def ensure_words(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """Tokenise ``text`` once into a helper column shared by all native scorers.

    The helper is referenced several times downstream; Catalyst does not inline
    an expensive projection into several references, so the regex runs once.
    """
    name = f"__w_{text}"
    if name not in df.columns:
        df = df.withColumn(name, words(text))
    return df, name


def human_logit(text=None, w=None) -> Column:
    """Stand-in detector logit: 8 * distinct_words / words - 6 (null for no words)."""
    w = _c(w) if w is not None else words(text)
    n = F.size(w)
    return F.when(n > 0, F.lit(8.0) * distinct_count(w) / n - F.lit(6.0))


def capped_raw(text, w=None) -> Column:
    """Stand-in raw detector score: characters per word / 6 (null for no words)."""
    n = F.size(_c(w) if w is not None else words(text))
    return F.when(n > 0, F.char_length(_c(text)) / (F.lit(6) * n))


def helpfulness(query=None, text=None, qw=None, tw=None) -> Column:
    """Stand-in pair score: share of the query's distinct words found in the answer."""
    q = F.array_distinct(_c(qw) if qw is not None else words(query))
    t = F.array_distinct(_c(tw) if tw is not None else words(text))
    nq = F.size(q)
    return F.when(nq > 0, F.size(F.array_intersect(q, t)).cast("double") / nq)


class ExpressionScorer:
    """Base: ``score_frame`` adds the output array column; subclasses stage helpers."""

    name = "expression"

    def score_frame(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.outputs(F.col(text)))


class WordStatDetector(ExpressionScorer):
    """Label-array stand-in: ``[{ChatGPT, -logit}, {Human, logit}]`` (human not first)."""

    name = "wordstat-detector"

    @staticmethod
    def _array(logit) -> Column:
        return F.array(output_entry("ChatGPT", -logit), output_entry("Human", logit))

    def outputs(self, text) -> Column:
        return self._array(human_logit(text))

    def score_frame(self, df, text, out):
        df, w = ensure_words(df, text)
        df = df.withColumn(f"__l_{out}", human_logit(w=w))
        return df.withColumn(out, self._array(F.col(f"__l_{out}")))


def word_stat_batch() -> Callable[[list], list]:
    """``WordStatDetector`` as a batch callable: what a model pipeline looks like to a batch scorer."""
    import regex

    find = regex.compile(WORD_PATTERN).findall

    def run(texts: list) -> list:
        out = []
        for t in texts:
            w = find(t.lower())
            logit = 8.0 * len(set(w)) / len(w) - 6.0 if w else float("nan")
            out.append([{"label": "ChatGPT", "score": -logit}, {"label": "Human", "score": logit}])
        return out
    return run


class RawScoreDetector(ExpressionScorer):
    """Single raw-score stand-in for the 'binoculars' branch (R2)."""

    name = RAW_DETECTOR_MARKER

    def raw(self, text, w=None) -> Column:
        return capped_raw(text, w)

    def outputs(self, text) -> Column:
        return F.array(output_entry("raw", capped_raw(text)))

    def raw_frame(self, df, text, out):
        df, w = ensure_words(df, text)
        return df.withColumn(out, capped_raw(F.col(text), F.col(w)))


class OverlapPairScorer:
    """Pair stand-in: best label listed second so the top-1 pick is exercised."""

    name = "overlap-reward"

    @staticmethod
    def _array(s) -> Column:
        return F.array(output_entry("LABEL_1", s - F.lit(1.0)), output_entry("LABEL_0", s))

    def outputs(self, text, text_pair) -> Column:
        return self._array(helpfulness(text, text_pair))

    def score_frame(self, df, text, text_pair, out):
        df, qw = ensure_words(df, text)
        df, tw = ensure_words(df, text_pair)
        df = df.withColumn(f"__s_{out}", helpfulness(qw=F.col(qw), tw=F.col(tw)))
        return df.withColumn(out, self._array(F.col(f"__s_{out}")))


def truncate_words(text, max_tokens: int = SCORER_MAX_TOKENS) -> Column:
    """R9 ``truncation=True, max_length``: the text up to the end of its
    ``max_tokens``-th word, original characters kept (word-level stand-in for
    the model tokenizer's cut).  A text of at most so many words stays as it is.
    Possessive quantifiers: no backtracking."""
    t = _c(text)
    short = t.rlike(rf"^[^\p{{L}}\p{{N}}_]*+(?:[\p{{L}}\p{{N}}_]++[^\p{{L}}\p{{N}}_]*+){{0,{int(max_tokens)}}}+\z")
    cut = F.regexp_extract(t, rf"^(?:[^\p{{L}}\p{{N}}_]*+[\p{{L}}\p{{N}}_]++){{0,{int(max_tokens)}}}+", 0)
    return F.when(t.isNull() | short, t).otherwise(cut)


class PandasTextScorer:
    """Wrap ``factory() -> fn(list[str]) -> list[list[{label, score}]]`` as a pandas UDF.

    ``factory`` runs once per Python worker (cached), like loading a model once
    per device; batches arrive through Arrow with
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows (R9 ``batch_size``).
    ``max_tokens`` (R9 ``truncation=True, max_length``) cuts each input to its
    first words on the JVM side before it is shipped to Python; ``None``, the
    default, ships whole texts, as the native scorers read them.
    """

    _cache: dict = {}

    def __init__(self, name: str, factory: Callable[[], Callable[[list], list]],
                 max_tokens: int | None = None):
        self.name = name
        self.factory = factory
        self.max_tokens = max_tokens
        key = (name, worker_slot(factory))

        @F.pandas_udf(OUTPUT_TYPE)
        def _score(texts: pd.Series) -> pd.Series:
            fn = PandasTextScorer._cache.get(key)
            if fn is None:
                fn = PandasTextScorer._cache[key] = factory()
            out = fn(texts.tolist())
            return pd.Series([[{"label": o["label"], "score": float(o["score"])} for o in row]
                              for row in out])

        self._udf = _score

    def _prep(self, text) -> Column:
        return truncate_words(text, self.max_tokens) if self.max_tokens else _c(text)

    def outputs(self, text) -> Column:
        return self._udf(self._prep(text))

    def score_frame(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.outputs(F.col(text)))


class PandasPairScorer:
    """Pair variant: ``fn(list[{'text': q, 'text_pair': a}]) -> list[list[{label, score}]]``."""

    _cache: dict = {}

    def __init__(self, name: str, factory: Callable[[], Callable[[list], list]],
                 max_tokens: int | None = None):
        self.name = name
        self.max_tokens = max_tokens
        key = (name, worker_slot(factory))

        @F.pandas_udf(OUTPUT_TYPE)
        def _score(texts: pd.Series, pairs: pd.Series) -> pd.Series:
            fn = PandasPairScorer._cache.get(key)
            if fn is None:
                fn = PandasPairScorer._cache[key] = factory()
            batch = [{"text": t, "text_pair": p} for t, p in zip(texts.tolist(), pairs.tolist())]
            out = fn(batch)
            return pd.Series([[{"label": o["label"], "score": float(o["score"])} for o in row]
                              for row in out])

        self._udf = _score

    def outputs(self, text, text_pair) -> Column:
        if self.max_tokens:
            return self._udf(truncate_words(text, self.max_tokens), truncate_words(text_pair, self.max_tokens))
        return self._udf(_c(text), _c(text_pair))

    def score_frame(self, df: DataFrame, text: str, text_pair: str, out: str) -> DataFrame:
        return df.withColumn(out, self.outputs(F.col(text), F.col(text_pair)))


# Registry of scorer builders, keyed "task:model".
_REGISTRY: dict[str, Callable[[], object]] = {
    "text-classification:wordstat-detector": WordStatDetector,
    "text-classification:overlap-reward": OverlapPairScorer,
    RAW_DETECTOR_MARKER: RawScoreDetector,
}


def register_scorer(spec: str, builder: Callable[[], object]) -> None:
    _REGISTRY[spec] = builder


def parse_spec(spec: str) -> tuple[str, str]:
    """``task:model`` must have exactly two parts, as the reference's unpacking requires."""
    parts = spec.split(":")
    if len(parts) != 2:
        raise ValueError(f"scorer spec must be 'task:model', got {spec!r}")
    return parts[0], parts[1]


def is_raw_detector(name: str) -> bool:
    """the raw-score detector branch, by case-insensitive containment."""
    return RAW_DETECTOR_MARKER in name.lower()


def build_scorer(spec: str):
    if is_raw_detector(spec):
        return _REGISTRY[RAW_DETECTOR_MARKER]()
    parse_spec(spec)
    if spec not in _REGISTRY:
        raise KeyError(f"no scorer registered for {spec!r}")
    return _REGISTRY[spec]()
