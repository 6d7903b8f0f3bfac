"""Reward arithmetic as column expressions.

The order of floating-point operations follows the Python it replaces, so
results are bit-identical.  Nulls and NaNs are handled explicitly: Spark's
``least`` skips nulls and ranks NaN highest, which would silently differ from
Python's ``min``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefline.config import CAP_MAX, CAP_RANGE, HUMAN_LABEL, HUMAN_SCORE_DIVISOR


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scale(x, left_min: float, left_max: float, right_min: float, right_max: float) -> Column:
    """Map [left_min, left_max] linearly onto [right_min, right_max]; no clamp.

    Equal left bounds would divide by zero; that is rejected on the driver.
    """
    left_span = float(left_max) - float(left_min)
    right_span = float(right_max) - float(right_min)
    if left_span == 0.0:
        raise ValueError("scale: left_min and left_max must differ")
    scaled = (_c(x).cast("double") - F.lit(float(left_min))) / F.lit(left_span)
    return F.lit(float(right_min)) + scaled * F.lit(right_span)


def cap(x, upper: float = CAP_MAX) -> Column:
    """min(x, upper) with Python semantics: null stays null, NaN stays NaN."""
    x = _c(x).cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .when(F.isnan(x), x) \
        .otherwise(F.least(x, F.lit(float(upper))))


def capped_scaled(x) -> Column:
    """R2: cap the detector score at 1.0, then scale [0, 1] -> [-4, 4]."""
    return scale(cap(x), *CAP_RANGE)


def guarded_min(a, b) -> Column:
    """Min of two scores; null if either is null, NaN if either is NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")) \
        .when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))) \
        .otherwise(F.least(a, b))


def weighted(helpful, human, weight: float = 0.5, divisor: float = HUMAN_SCORE_DIVISOR) -> Column:
    """W * helpful + (1 - w) * ((1 / divisor) * human)."""
    normalized = F.lit(1.0 / divisor) * _c(human).cast("double")
    return F.lit(float(weight)) * _c(helpful).cast("double") + F.lit(1.0 - float(weight)) * normalized


def label_score(outputs, label: str = HUMAN_LABEL) -> Column:
    """Score of the first entry whose label equals ``label`` ignoring case.

    Null when no entry matches (such rows are quarantined by the caller).
    """
    hits = F.filter(_c(outputs), lambda o: F.lower(o["label"]) == F.lit(label.lower()))
    return F.get(hits, 0)["score"]


def top_score(outputs) -> Column:
    """Score of the best label (the classifier lists labels best first).

    ``array_max`` over the extracted score array: no lambda, stays in codegen.
    """
    return F.array_max(_c(outputs)["score"])


def top_label(outputs) -> Column:
    best = F.array_max(F.transform(_c(outputs), lambda o: F.struct(o["score"].alias("score"),
                                                                   o["label"].alias("label"))))
    return best["label"]
