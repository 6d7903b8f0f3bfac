"""Preference losses as column expressions.

Formulas from the published DPO / conservative DPO / IPO / SLiC-hinge / robust
DPO papers.  ``x`` is the preference log-ratio difference; here the caller
passes a score difference since no log-probabilities exist in the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOSS_TYPES = ("sigmoid", "hinge", "ipo", "robust")


def _c(col) -> Column:
    if isinstance(col, str):
        return F.col(col)
    if isinstance(col, (int, float)):
        return F.lit(float(col))
    return col


def softplus(z) -> Column:
    """ln(1 + e^z) in the overflow-free form max(z, 0) + log1p(exp(-|z|))."""
    z = _c(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def preference_loss(x, beta, smoothing, loss_type) -> Column:
    """Per-pair loss for ``loss_type`` (a string or a string column).

    Robust loss is undefined at smoothing = 0.5 and gives null there.
    """
    x, b, e = _c(x), _c(beta), _c(smoothing)
    bx = b * x
    sigmoid = (F.lit(1.0) - e) * softplus(-bx) + e * softplus(bx)
    hinge = F.greatest(F.lit(0.0), F.lit(1.0) - bx)
    gap = x - F.lit(1.0) / (F.lit(2.0) * b)
    ipo = gap * gap
    robust = F.when(e != F.lit(0.5),
                    ((F.lit(1.0) - e) * softplus(-bx) - e * softplus(bx)) / (F.lit(1.0) - F.lit(2.0) * e))
    by_name = {"sigmoid": sigmoid, "hinge": hinge, "ipo": ipo, "robust": robust}
    if isinstance(loss_type, str):
        if loss_type not in by_name:
            raise ValueError(f"unknown loss type {loss_type!r}")
        return by_name[loss_type]
    t = _c(loss_type)
    return F.when(t == "sigmoid", sigmoid).when(t == "hinge", hinge) \
        .when(t == "ipo", ipo).when(t == "robust", robust)


def reward_margin(x, beta) -> Column:
    return _c(beta) * _c(x)
