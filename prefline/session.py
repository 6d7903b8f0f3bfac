"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on.  ANSI mode is Spark 4's default and is kept:
# a division by zero raises, like the Python code it replaces.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches to Python workers are bounded in bytes as well as rows, so
    # very long documents cannot make one batch unbounded
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints written by the split and the vocabulary numbering are removed
    # once their DataFrames are garbage-collected (a context setting: set at submit)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Starting points for a large cluster (100 TB input).  Shuffle partitions are
# sized so a reduce partition holds about 128-256 MB after AQE coalescing;
# scans split at 128 MB; Arrow batches stay small enough for model scorers.
CLUSTER_CONF = {
    **{k: v for k, v in DEFAULT_CONF.items() if k != "spark.ui.enabled"},
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def configure_cluster(spark: SparkSession, conf: dict | None = None) -> SparkSession:
    """Apply ``CLUSTER_CONF`` (runtime SQL settings only) to an existing session.

    Context settings in it (checkpoint cleaning) take effect only when given at
    submit time; they are listed there for that purpose.

    Shuffle partitions are at least three per core so every core stays busy
    after AQE coalesces small partitions.
    """
    conf = dict(conf or CLUSTER_CONF)
    cores = spark.sparkContext.defaultParallelism
    conf["spark.sql.shuffle.partitions"] = str(max(int(conf.get("spark.sql.shuffle.partitions", 0)), 3 * cores))
    for key, value in conf.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "prefline", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    parts = shuffle_partitions or (8 if cores == "*" else int(cores))
    conf["spark.sql.shuffle.partitions"] = str(parts)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Only when it is unset (local tests) a private
    folder is created and registered, so lineage cuts and sinks have a home.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="prefline-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the shared checkpoint folder (never a
    local checkpoint): cuts lineage so a lost executor does not re-run the
    upstream stages, and fixes partition contents for multi-pass algorithms."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions started without it on
    their path (no installed package, no ``--py-files``).  Call it once, before the
    first job that uses Python workers."""
    package = os.path.dirname(os.path.abspath(__file__))
    # the driver serves the archive to executors that start later, so it stays until the end
    folder = tempfile.mkdtemp(prefix="prefline-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, "prefline"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{kind}/{uuid.uuid4().hex}"
