"""Sinks: tensor-ready parquet (S4), rollout log (S5) and log cadence."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prefline.config import LOG_EVERY
from prefline.operators.tokens import dense_order_ids

SHARD_ROWS = 65_536
LOG_COLUMNS = ["query", "response", "ref_response", "ref_rewards"]


def write_tensor_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``array<int>`` id/mask columns stored as parquet lists, ready for a loader."""
    df.write.mode(mode).parquet(path)


def write_row_tensors(df: DataFrame, path: str, order: list, arrays: list[str], length: int,
                      shard_rows: int = SHARD_ROWS, mode: str = "overwrite") -> None:
    """S4 with an index of rows: rows are numbered from 0 in ``order`` (column ``row``) and
    stored in shards of ``shard_rows`` rows, sorted.  A shard's folder names the rows it may
    hold (from ``first_row`` up to, not including, ``after_row``), so a reader of some rows
    opens their shards only.  Each of ``arrays`` must have ``length`` elements in every row,
    none null; anything else is an error.  ``df`` has no column of these three names."""
    for name in arrays:
        fixed = F.coalesce((F.size(name) == length) & ~F.exists(name, lambda x: x.isNull()), F.lit(False))
        wrong = F.raise_error(F.lit(f"{name!r} must have {length} elements, none null")).cast(df.schema[name].dataType)
        df = df.withColumn(name, F.when(fixed, F.col(name)).otherwise(wrong))
    first = F.expr(f"row - row % {int(shard_rows)}")
    rows = dense_order_ids(df, order, 0, "row").withColumn("first_row", first)
    rows = rows.withColumn("after_row", F.col("first_row") + int(shard_rows)).repartition("first_row")
    rows.sortWithinPartitions("first_row", "row").write.mode(mode).partitionBy("first_row", "after_row").parquet(path)


def read_row_tensors(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, schema=None) -> DataFrame:
    """The rows from ``start`` up to, not including, ``stop`` (None: to the end), with their
    number; only shards that may hold them are read.  A table stored without rows has no
    files; with the ``schema`` of the stored frame it reads as an empty one."""
    if schema is not None:
        schema = StructType([*schema.fields, *(StructField(c, LongType()) for c in ("row", "first_row", "after_row"))])
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    wanted = (F.col("after_row") > start) & (F.col("row") >= start)
    if stop is not None:
        wanted &= (F.col("first_row") < stop) & (F.col("row") < stop)
    return df.where(wanted).drop("first_row", "after_row")


def new_run_id() -> str:
    """A unique run id; the prefix keeps partition discovery from reading it as a number."""
    return f"run-{uuid.uuid4().hex}"


def append_log(df: DataFrame, path: str, run_id: str, key: str = "conv_id",
               columns: list[str] | None = None, step: str | None = None) -> None:
    """Append one record per sample, partitioned by run id.

    Appends are per-task atomic commits, so a lost executor re-runs its task
    without duplicating committed files.
    """
    cols = [key] + (columns or LOG_COLUMNS) + ([step] if step else [])
    (df.select(*cols).withColumn("run_id", F.lit(run_id))
       .write.mode("append").partitionBy("run_id").parquet(path))


def read_log(spark: SparkSession, path: str, run_id: str, schema=None) -> DataFrame:
    """The records of one run.  Only that run's folder is listed and read
    (``basePath`` keeps ``run_id`` a partition column), so the cost does not
    grow with the number of runs in the log.  A run that logged no rows has no
    folder; with ``schema`` given it reads as an empty frame."""
    folder = f"{path.rstrip('/')}/run_id={run_id}"
    try:
        df = spark.read.option("basePath", path).parquet(folder)
    except AnalysisException as exc:
        if schema is None or "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    return df.where(F.col("run_id") == run_id).drop("run_id")


def cadence(df: DataFrame, step: str = "step", every: int = LOG_EVERY, first: bool = True) -> DataFrame:
    """Keep step 1 (``first``) and every ``every``-th step."""
    cond = (F.col(step) % every == 0)
    if first:
        cond = cond | (F.col(step) == 1)
    return df.where(cond)
