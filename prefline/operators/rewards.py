"""Scoring and reward combination on a keyed rollout frame.

Input: one row per sample with ``query``, ``response``, ``ref_response``.
Every result is a same-row column, so no positional alignment and no join
is needed; with native scorers the whole chain stays in the JVM, in the stage
after whatever produced the rollout rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefline.config import RewardConfig
from prefline.functions import scores as S
from prefline.operators.evaluate import evaluate_once
from prefline.operators.scorers import is_raw_detector


def human_scores(df: DataFrame, detector, name: str | None = None,
                 text: str = "response", ref_text: str = "ref_response") -> DataFrame:
    """Add ``human`` and ``ref_human``.

    Raw-score detectors (name contains 'binoculars') are capped at 1.0 and
    rescaled to [-4, 4], each answer from its own score (defect D1 fixed).
    Label-array detectors keep the first entry labelled 'human' (any case);
    a row without one gets null there and is routed to quarantine by
    ``split_valid``.
    """
    name = name or detector.name
    if is_raw_detector(name):
        df = detector.raw_frame(df, text, "__raw_h")
        df = detector.raw_frame(df, ref_text, "__raw_rh")
        return df.withColumn("human", S.capped_scaled("__raw_h")) \
                 .withColumn("ref_human", S.capped_scaled("__raw_rh"))
    df = detector.score_frame(df, text, "__out_h")
    df = detector.score_frame(df, ref_text, "__out_rh")
    return df.withColumn("human", S.label_score("__out_h")) \
             .withColumn("ref_human", S.label_score("__out_rh"))


def pair_scores(df: DataFrame, scorer, query: str = "query", text: str = "response",
                ref_text: str = "ref_response", out: str = "helpful") -> DataFrame:
    """Score (query, answer) pairs for both answers; keep the best label's score."""
    df = scorer.score_frame(df, query, text, f"__out_{out}")
    df = scorer.score_frame(df, query, ref_text, f"__out_ref_{out}")
    return df.withColumn(out, S.top_score(f"__out_{out}")) \
             .withColumn(f"ref_{out}", S.top_score(f"__out_ref_{out}"))


def combine(df: DataFrame, cfg: RewardConfig) -> DataFrame:
    """``reward`` and ``ref_reward`` from the score columns present.

    normal_training -> pair scores only (R8); no helpfulness -> human only (R7);
    use_min -> guarded min (R5); else weighted (R6).
    """
    if cfg.normal_training:
        return df.withColumn("reward", F.col("helpful")).withColumn("ref_reward", F.col("ref_helpful"))
    if not cfg.use_helpfulness:
        return df.withColumn("reward", F.col("human")).withColumn("ref_reward", F.col("ref_human"))
    if cfg.use_min:
        return df.withColumn("reward", S.guarded_min("human", "helpful")) \
                 .withColumn("ref_reward", S.guarded_min("ref_human", "ref_helpful"))
    w = cfg.hf_model_weight
    return df.withColumn("reward", S.weighted("helpful", "human", w)) \
             .withColumn("ref_reward", S.weighted("ref_helpful", "ref_human", w))


def compute_reward(df: DataFrame, detector, pair_scorer=None, cfg: RewardConfig = RewardConfig(),
                   detector_name: str | None = None) -> DataFrame:
    """The reference's compute_reward as one projection chain."""
    if cfg.normal_training:
        # The main scorer scores the pairs, whether or not a pair scorer is given too;
        # human scores are not computed.
        return combine(pair_scores(df, detector), cfg)
    out = human_scores(df, detector, detector_name)
    if pair_scorer is not None and cfg.use_helpfulness:
        out = pair_scores(out, pair_scorer)
    else:
        cfg = RewardConfig(hf_model_weight=cfg.hf_model_weight, use_min=cfg.use_min,
                           normal_training=False, use_helpfulness=False)
    return combine(out, cfg)


def split_valid(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all ``cols`` non-null and non-NaN, and the rest with a reason."""
    reason = F.lit(None).cast("string")
    for c in reversed(cols):
        reason = F.when(F.col(c).isNull(), F.lit(f"null_{c}")) \
                  .when(F.isnan(F.col(c)), F.lit(f"nan_{c}")).otherwise(reason)
    tagged = evaluate_once(df, reason=reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())
