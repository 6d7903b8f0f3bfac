"""Named datasets -> DataFrames with declared schemas (no inference at scale)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table; the schema is declared so no footer sampling or inference runs."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(root, name))


class Catalog:
    """``load_dataset(name, split="train")``: a name -> path lookup on the driver.

    Names may be registered to any path/format; unknown names resolve to
    ``<root>/<name>.parquet``.  Only the ``train`` split exists, as in the
    reference, and asking for another is an error rather than a silent fallback.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._entries: dict[str, tuple[str, str, str | None]] = {}

    def register(self, name: str, path: str, fmt: str = "parquet", schema: str | None = None):
        self._entries[name] = (path, fmt, schema)
        return self

    def register_table(self, name: str, table: str):
        """Serve ``name`` from a catalog table (e.g. a bucketed layout from ``sources.layout``)."""
        self._entries[name] = (table, "table", None)
        return self

    def load(self, name: str, split: str = "train") -> DataFrame:
        if split != "train":
            raise ValueError(f"dataset {name!r} has only a 'train' split")
        if name in self._entries:
            path, fmt, schema = self._entries[name]
            if fmt == "table":
                return self.spark.table(path)
            reader = self.spark.read.format(fmt)
            if schema:
                reader = reader.schema(schema)
            return reader.load(path)
        return read_table(self.spark, self.root, name)


# Largest input ``spread`` may redistribute (optimizer size estimate), and the
# usual Parquet row-group size: a scan cannot use more tasks than row groups.
SPREAD_MAX_BYTES = 32 << 30
ROW_GROUP_BYTES = 128 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for a scan)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size if isinstance(size, int) else int(size.toString())


def spread(df: DataFrame, min_partitions: int | None = None, max_bytes: int = SPREAD_MAX_BYTES) -> DataFrame:
    """Guarantee at least ``min_partitions`` tasks (default: the cluster's default
    parallelism) before CPU-heavy per-row work such as regex tokenisation.

    A Parquet row group is never split, so a scan runs at most one busy task
    per row group, whatever the number of planned splits (Spark plans splits
    by bytes, and a split holding no row-group start reads nothing).  The busy
    tasks are estimated as the planned splits, capped by the larger of the file
    count and the data size in typical row groups; only an input with fewer
    busy tasks than cores, and only when its estimated size is at most
    ``max_bytes``, is redistributed round-robin: a checked, bounded shuffle.  A
    large table (many row groups) passes through untouched, as does an input
    that is already shuffled or laid out in buckets.
    """
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if n <= 1 or "Exchange" in plan.toString():
        return df  # one core, or already spread over shuffle partitions
    # a deliberate layout (bucketed table) keeps its partitioning; checked before
    # Spark's rule that turns bucketed reads off where the plan so far gains nothing
    if "UnknownPartitioning" not in df._jdf.queryExecution().sparkPlan().outputPartitioning().toString():
        return df
    size = estimated_bytes(df)
    if size > max_bytes:
        return df
    # busy scan tasks: at most the planned splits, at least one per file, and
    # about one per typical row group of data; the file list is consulted last
    planned = df.rdd.getNumPartitions()
    if planned < n:
        return df.repartition(n)
    if -(-size // ROW_GROUP_BYTES) >= n or len(df.inputFiles()) >= n:
        return df
    return df.repartition(n)
