"""E5: score newly arrived assistant turns incrementally.

File-source stream over the turn table -> stateless filter + native scorer ->
append-only parquet sink.  The checkpoint (offsets and the sink's commit log)
lives under the shared checkpoint folder, so a restarted or re-run query
continues where it stopped and never writes a batch twice.  No state store is
needed: the operator is stateless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefline.operators.scorers import human_logit
from prefline.session import scratch_path
from prefline.sources.tables import SCHEMAS


def score_turns(turns: DataFrame) -> DataFrame:
    """The per-row transformation, shared by the stream and its batch twin."""
    return turns.where(F.col("role") == "assistant") \
        .select("conv_id", "turn", human_logit("text").alias("score"))


def as_stream_glob(path: str) -> str:
    """The file source watches a directory or a glob; a single-file table
    ``.../name.parquet`` becomes the glob ``.../{name.parquet}`` (matches a file
    or a dataset folder of that name)."""
    path = path.rstrip("/")
    head, _, last = path.rpartition("/")
    if any(ch in last for ch in "*?[{"):
        return path
    return f"{head}/{{{last}}}"


# Files per micro-batch: a large backlog is worked off in bounded batches, each
# committed to the checkpoint before the next starts (availableNow honours it).
MAX_FILES_PER_TRIGGER = 1000


def start_scoring(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str,
                  max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER, available_now: bool = True):
    reader = spark.readStream.schema(SCHEMAS["conversations"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = score_turns(reader.parquet(as_stream_glob(source_path)))
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_new_turns(spark: SparkSession, source_path: str, sink_path: str | None = None,
                    checkpoint: str | None = None) -> DataFrame:
    """Process everything available now, then return the sink as a batch frame."""
    sink_path = sink_path or scratch_path(spark, "stream_sink")
    checkpoint = checkpoint or scratch_path(spark, "stream_ckpt")
    q = start_scoring(spark, source_path, sink_path, checkpoint)
    q.awaitTermination()  # however long the backlog; raises what ended the query
    return spark.read.schema("conv_id BIGINT, turn BIGINT, score DOUBLE").parquet(sink_path)
