"""Random hyper-parameter trials (L7) and their evaluation on logged scores.

``trial_table``: ``spark.range(count)`` with every parameter drawn from a hash
of (parameter salt, trial id): reproducible, no driver-side sampling.

``trial_losses``: the mean preference loss and reward margin of every trial
over all pairs in **one pass** over the pairs: the trial parameters (a table
of ``count`` rows, at most ``MAX_TRIALS``) become a literal array evaluated per
pair in the same pipeline, so there is no join between trials and pairs, and
the aggregate on ``trial`` is partial map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefline.config import LOG_EVERY, SWEEP_COUNT, SWEEP_SPACE
from prefline.functions.losses import preference_loss, reward_margin
from prefline.functions.text import h8, uniform

# Output column and hash salt per swept parameter.
COLUMNS = {
    "learning_rate": ("lr", "lr"),
    "beta": ("beta", "beta"),
    "label_smoothing": ("smoothing", "smooth"),
    "warmup_steps": ("warmup", "warmup"),
    "mini_batch_size": ("mini_batch", "mb"),
    "gradient_accumulation_steps": ("accum", "ga"),
    "loss_type": ("loss_type", "loss"),
}
MAX_TRIALS = 10_000


def draw(kind: str, salt: str, key: Column, *args) -> Column:
    """One parameter value per row from its distribution."""
    if kind == "uniform":
        lo, hi = float(args[0]), float(args[1])
        return F.lit(lo) + uniform(salt, key) * (F.lit(hi) - F.lit(lo))
    if kind == "int_uniform":
        lo, hi = int(args[0]), int(args[1])
        return (F.lit(lo) + F.pmod(h8(salt, key), F.lit(hi - lo + 1))).cast("int")
    if kind == "categorical":
        values = list(args[0])
        idx = F.pmod(h8(salt, key), F.lit(len(values))).cast("int") + F.lit(1)
        return F.element_at(F.array(*[F.lit(v) for v in values]), idx)
    raise ValueError(f"unknown distribution {kind!r}")


def trial_table(spark: SparkSession, count: int = SWEEP_COUNT, space: dict = SWEEP_SPACE) -> DataFrame:
    if not 0 < count <= MAX_TRIALS:
        raise ValueError(f"count must be in 1..{MAX_TRIALS}")
    key = F.col("id")
    cols = [key.alias("trial")]
    for param, (kind, *args) in space.items():
        name, salt = COLUMNS.get(param, (param, param))
        cols.append(draw(kind, salt, key, *args).alias(name))
    return spark.range(count).select(*cols)


def with_schedule(trials: DataFrame, n_train, log_every: int = LOG_EVERY) -> DataFrame:
    """Per trial: optimizer steps per epoch ``ceil(n_train / (mini_batch * accum))``
    and how many of them are logged under the cadence "first step, then every
    ``log_every``-th" (S6).  ``n_train`` is a Column (e.g. a scalar subquery
    counting the training rows), so the schedule follows the data."""
    per_step = F.col("mini_batch") * F.col("accum")
    steps = F.floor((n_train + per_step - F.lit(1)) / per_step).cast("long")
    logged = F.when(steps >= 1, F.lit(1) + F.floor(steps / F.lit(log_every)).cast("long")
                    - F.when(F.lit(log_every) == 1, F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))
    return trials.withColumn("steps", steps).withColumn("log_steps", logged.cast("long"))


def trial_losses(pairs_x: DataFrame, trials: DataFrame, x: str = "x", digits: int | None = 9) -> DataFrame:
    """(trial, loss, margin): mean loss and mean ``beta * x`` per trial over all rows of ``pairs_x``.

    The trial parameters (at most ``MAX_TRIALS`` rows, checked) become one
    literal array; every pair is evaluated under each trial inside the same
    codegen pipeline (``inline`` of that array, no join) and the hash
    aggregate on ``trial`` is partial map-side, so each task ships at most one
    row per trial.  Trials whose loss is undefined (robust with smoothing 0.5)
    get a null loss.
    """
    params = trials.select("trial", "beta", "smoothing", "loss_type").limit(MAX_TRIALS + 1).collect()
    if len(params) > MAX_TRIALS:
        raise ValueError(f"at most {MAX_TRIALS} trials per evaluation")
    grid = F.array(*[F.struct(F.lit(int(p["trial"])).cast("long").alias("trial"),
                              F.lit(float(p["beta"])).alias("beta"),
                              F.lit(float(p["smoothing"])).alias("smoothing"),
                              F.lit(p["loss_type"]).alias("loss_type")) for p in params])
    xc = F.col(x)
    per_pair = pairs_x.where(xc.isNotNull()).select(x, F.inline(grid))
    loss = preference_loss(xc, F.col("beta"), F.col("smoothing"), F.col("loss_type"))
    out = per_pair.groupBy("trial").agg(F.avg(loss).alias("loss"),
                                        F.avg(reward_margin(xc, F.col("beta"))).alias("margin"))
    if digits is not None:
        out = out.select("trial", F.round("loss", digits).alias("loss"), F.round("margin", digits).alias("margin"))
    return out


def best_trials(losses: DataFrame, k: int = 3) -> DataFrame:
    """The k trials with the lowest loss (ties by trial id); a bounded top-k."""
    return losses.where(F.col("loss").isNotNull()).orderBy("loss", "trial").limit(k)
