"""The step-numbered log of a run, kept up as a stream.

Rows that arrive are numbered on from those of the earlier micro-batches, ``batch_size``
rows make a step, and the log keeps step 1 and every ``every``-th step.  The state between
micro-batches is one number: how many rows there were.  It is written after the log, both
into folders named by the micro-batch's number and both by overwriting, so a micro-batch
that is repeated after a failure writes the same rows to the same place, and each row is
logged exactly once.  Inside a micro-batch rows are numbered by a range sort over the
cluster (``dense_order_ids``); they never meet in one task.

Rows are numbered in the order of the micro-batches, and inside one by ``order``.  The log
thus equals that of one batch job whenever the files arrive in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefline.config import LOG_EVERY
from prefline.operators.tokens import dense_order_ids
from prefline.session import scratch_path
from prefline.sources.sinks import cadence
from prefline.sources.tables import SCHEMAS
from prefline.streaming.score_stream import MAX_FILES_PER_TRIGGER, as_stream_glob, score_turns

STATE = "rows bigint"


def numbered_steps(rows: DataFrame, order: list[str], batch_size: int, before: int = 0) -> DataFrame:
    """Add ``step`` (from 1): the batch of ``batch_size`` rows that a row stands in, after
    ``before`` earlier rows."""
    return dense_order_ids(rows, order, before, "_row").withColumn("step", F.expr(f"_row div {batch_size} + 1")).drop("_row")


def _rows_before(spark: SparkSession, path: str, epoch: int) -> int:
    if epoch == 0:
        return 0
    return spark.read.schema(STATE).parquet(f"{path}/state/epoch={epoch - 1}").first()["rows"]


def step_writer(path: str, order: list[str], batch_size: int, every: int = LOG_EVERY,
                fail_before_state: Callable[[int], None] = lambda epoch: None) -> Callable[[DataFrame, int], None]:
    """The function that logs one micro-batch below ``path``; ``fail_before_state`` is
    called between its two writes, so that tests can end a run there."""
    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        before = _rows_before(spark, path, epoch)
        steps = numbered_steps(rows, order, batch_size, before)
        cadence(steps, every=every).write.mode("overwrite").parquet(f"{path}/log/epoch={epoch}")
        fail_before_state(epoch)
        total = steps.agg((F.count("*") + before).alias("rows"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")
    return write


def start_step_log(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    start = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    return (start.trigger(availableNow=True) if available_now else start.trigger(processingTime="10 seconds")).start()


def read_step_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all micro-batches whose state is written; none yet: an empty frame."""
    try:
        done = spark.read.option("basePath", f"{path}/state").parquet(f"{path}/state").agg(F.max("epoch")).scalar()
        rows = spark.read.schema(f"{schema}, epoch int").option("basePath", f"{path}/log").parquet(f"{path}/log")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col("epoch") <= done).drop("epoch")


def log_scored_turns(spark: SparkSession, source_path: str, batch_size: int, path: str | None = None, checkpoint: str | None = None,
                     max_files_per_trigger: int = MAX_FILES_PER_TRIGGER, **options) -> DataFrame:
    """Score the assistant turns below ``source_path`` as a stream, log their steps, and
    return the log (conv_id, turn, score, step) once all that is there is worked off."""
    path, checkpoint = path or scratch_path(spark, "step_log"), checkpoint or scratch_path(spark, "step_ckpt")
    reader = spark.readStream.schema(SCHEMAS["conversations"]).option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_turns(reader.parquet(as_stream_glob(source_path)))
    writer = step_writer(path, ["conv_id", "turn", "score"], batch_size, **options)
    start_step_log(scored, writer, checkpoint).awaitTermination()
    return read_step_log(spark, path, "conv_id bigint, turn bigint, score double, step bigint")
