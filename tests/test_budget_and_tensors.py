"""Batch scorers bounded by tokens, and arrays stored with an index of rows."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from prefline.operators.budget import _TOKENS, BudgetScorer, budgeted
from prefline.operators.scorers import WordStatDetector, build_scorer
from prefline.session import scratch_path
from prefline.sources.sinks import read_row_tensors, write_row_tensors

TEXTS = [(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, "x " * 900), (3, "Über über 12"), (None, "?!")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=6), st.integers(1, 40))
def test_batches_keep_rows_in_order_and_within_the_budget(parts, budget):
    frames = [pa.record_batch({_TOKENS: pa.array(p, pa.int32())}) for p in parts]
    out = [t.column(_TOKENS).to_pylist() for t in budgeted(iter(frames), budget)]
    assert sum(out, []) == sum(parts, [])
    assert all(b and (len(b) == 1 or len(b) * max(1, *b) <= budget) for b in out)
    for a, b in zip(out, out[1:]):  # a batch ends only where the next row does not fit
        assert (len(a) + 1) * max(1, *a, b[0]) > budget


def _models():  # inner functions travel to the workers, which cannot import this file
    def sizes():
        return lambda texts: [[{"label": "rows", "score": len(texts)}, {"label": "chars", "score": len(t)}] for t in texts]

    def joined():
        return lambda items: [[{"label": f"{i['text']}|{i['text_pair']}", "score": 1}] for i in items]

    def one_short():
        return lambda texts: [[] for _ in texts[1:]]
    return sizes, joined, one_short


sizes, joined, one_short = _models()


@pytest.mark.parametrize("limit", [None, 2])
def test_outputs_stand_beside_their_texts(spark, limit):
    df = spark.createDataFrame(TEXTS, "id int, t string").withColumn("out_of", F.lit("kept"))
    rows = BudgetScorer("sizes", sizes, budget=8, max_tokens=limit, partitions=2).score_frame(df, "t", "out").collect()
    assert sorted(map(str, ((r["id"], r["t"], r["out_of"]) for r in rows))) == sorted(str((*t, "kept")) for t in TEXTS)
    cut = {"a b c": 3, "x " * 900: 3, "Über über 12": 9}
    for r in rows:
        whole = r["t"] or ""
        assert r["out"][1]["score"] == (cut.get(whole, len(whole)) if limit else len(whole))
        assert r["out"][0]["score"] <= 8
        if whole == "x " * 900 and not limit:
            assert r["out"][0]["score"] == 1  # longer than the budget: a batch of its own


def test_pairs_clashes_empty_tables_and_a_model_that_loses_a_text(spark):
    df = spark.createDataFrame([("q", "a", "old"), (None, "b", "old"), ("q", None, "old")], "q string, a string, out string")
    scored = BudgetScorer("joined", joined).score_pairs(df, "q", "a", "out")  # a column named like the output is replaced
    assert sorted(r["out"][0]["label"] for r in scored.collect()) == ["q|", "q|a", "|b"]
    assert BudgetScorer("sizes", sizes).score_frame(df.limit(0), "q", "out").count() == 0
    with pytest.raises(Exception, match="outputs for"):
        BudgetScorer("one_short", one_short, partitions=1).score_frame(df, "q", "s").collect()
    with pytest.raises(ValueError):
        BudgetScorer("none", sizes, budget=0)


def test_scorer_by_name_equals_the_native_one(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string")
    by_batch = build_scorer("text-classification:wordstat-batch").score_frame(df, "t", "out")
    native = WordStatDetector().score_frame(df, "t", "out").select("id", "t", "out")
    assert sorted(map(str, by_batch.collect())) == sorted(map(str, native.collect()))


def stored(spark, n, shard_rows, length=3):
    path = scratch_path(spark, "test-tensors")
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("key"), F.array(*[(F.col("id") + i).cast("int") for i in range(length)]).alias("ids"))
    write_row_tensors(df, path, ["key"], ["ids"], length, shard_rows)
    return path


@pytest.mark.parametrize("shard_rows", [1, 7, 100])
def test_any_range_of_rows_is_read_back(spark, shard_rows):
    path = stored(spark, 40, shard_rows)
    want = [(i, i + 1, [39 - i, 40 - i, 41 - i]) for i in range(40)]
    for start, stop in [(0, None), (0, 0), (0, 1), (6, 8), (7, 14), (13, 40), (39, 90), (40, None)]:
        got = sorted((r["row"], r["key"], r["ids"]) for r in read_row_tensors(spark, path, start, stop).collect())
        assert got == want[start:stop], (start, stop)


def test_only_the_shards_of_the_range_are_read(spark):
    path = stored(spark, 40, 8)
    df = read_row_tensors(spark, path, 10, 20)
    assert {f.split("first_row=")[1].split("/")[0] for f in df.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {"8", "16"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(after_row" in plan and "PushedFilters: [IsNotNull(row)" in plan


@pytest.mark.parametrize("ids", [[1, 2], [1, 2, 3, 4], [1, None, 3], None])
def test_arrays_of_another_form_are_an_error(spark, ids):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, ids)], "key int, ids array<int>")
    with pytest.raises(Exception, match="3 elements"):
        write_row_tensors(df, scratch_path(spark, "test-tensors"), ["key"], ["ids"], 3)


def test_an_empty_table_is_stored_and_read(spark):
    df = spark.createDataFrame([], "key int, ids array<int>")
    path = scratch_path(spark, "test-tensors")
    write_row_tensors(df, path, ["key"], ["ids"], 3)
    assert read_row_tensors(spark, path, schema=df.schema).collect() == []
