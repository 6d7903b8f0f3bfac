"""Corpus pipeline: operators of ``prefline.llm`` applied to ``documents`` one after the
other.  Each stage gets what the one before it kept, with the columns of documents
(n_chars brought up to date); the last one returns packed pieces.

Toxicity drops the documents that the model rejects.  Line dedup and substring dedup cut
text out of documents and keep the documents, also those left empty.  Near-dedup keeps
the document with the least id of each group (shingles of five words, likeness of 0.8 or
more).  SQL cannot express the trained model or the tokenizer, so there is no oracle.

Every stage handles null and repeated ids, null and empty texts, empty tables and columns
of any other name, which pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prefline.llm.common import bound_batches, load, written
from prefline.llm.cover_anchors import remove_repeats
from prefline.llm.line_variants import remove_lines
from prefline.llm.set_sketch import link
from prefline.llm.string_kernel import held_out, score, train
from prefline.llm.tier_packing import packed_pieces
from prefline.operators.tokens import dense_order_ids

NEAR_PERCENT = 80
BATCH_ROWS = 400


def _bounded(spark: SparkSession) -> None:
    """Small Arrow batches: the stages run one after the other in the same executors, and
    whole rows with their texts go to the workers and back."""
    bound_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names of its other columns that no operator uses."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"pipeline_column_{i}" for i, c in enumerate(docs.columns)])


def _restored(docs: DataFrame, out: DataFrame, text=None) -> DataFrame:
    """The columns of ``docs`` from ``out``, which has them under plain names; with a new
    ``text``, and n_chars brought up to date, where the stage changes it."""
    columns = []
    for c, own in zip(docs.columns, _plain(docs).columns):
        value = text if text is not None and c == "text" else F.col(own)
        if text is not None and c == "n_chars":
            value = F.length(text).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return out.select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay.  The model is fitted on the labelled documents of
    the folder that are not held out; without labels of both classes all documents stay.
    Null and empty texts are scored like a text without any known word."""
    labels = load(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = train(load(spark, sf_dir, "documents"), labels)
    _bounded(spark)
    return _restored(docs, score(_plain(docs), model).where("score < 0.5"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, are cut out.  All documents stay; null
    texts stay null; repeated rows of one id and text lose the same lines."""
    _bounded(spark)
    return _restored(docs, remove_lines(_plain(docs)), F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the least id, a null id coming
    last.  Rows are told apart even where ids are null or repeated; then, and only then,
    they are numbered first.  Texts without words are linked with nothing and stay."""
    _bounded(spark)
    rows = _plain(docs)
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null")
    if unclear.head(1):
        text = F.coalesce("text", F.lit(""))
        order = [F.asc_nulls_last("doc_id"), F.xxhash64(text), F.length(text)]
        rows = written(dense_order_ids(rows, order, 0, "pipeline_row"), "pipeline-rows")
        key = F.col("pipeline_row")
    else:
        key = F.col("doc_id")
    gone = link(rows.select(key.alias("doc_id"), "text"), NEAR_PERCENT).where("not kept").select(F.col("doc_id").alias("pipeline_gone"))
    return _restored(docs, rows.join(gone, key == F.col("pipeline_gone"), "left_anti"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand anywhere else are cut out.  All documents stay; a text
    without such a passage stays as it is, another keeps its words joined by one space."""
    _bounded(spark)
    return _restored(docs, remove_repeats(_plain(docs)), F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; other columns are left
    out, a null text is an empty one, and an empty table gives no pieces."""
    _bounded(spark)
    return packed_pieces(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
