"""The stages of the corpus pipeline: what they keep, clashing columns, odd rows, and the
whole run against its own stages."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from given_tables import SF_SMALL
from prefline.llm import common, line_variants, piece_cache, queries, set_sketch, tier_packing

CLASH = "doc_id bigint, text string, n_chars int, score string, n_lines int, n_removed string, n_words int, kept string, __gone int, pipeline_row int, key string, __text string, __null int, toxic int"


def table(spark, rows):
    made = [(i, t, -1, "s", k, "r", 7, "kept", 3, 4, "key", "own", 5, 6) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, CLASH).repartition(3)


def rest(spark, stage, rows):
    out = stage(spark, table(spark, rows), SF_SMALL)
    assert out.columns == [c.split()[0] for c in CLASH.split(", ")]
    got = out.collect()
    assert all((r["score"], r["n_removed"], r["n_words"], r["kept"], r["__gone"], r["key"], r["__text"]) == ("s", "r", 7, "kept", 3, "key", "own") for r in got)
    return got


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)]


ODD = [(990, None), (991, ""), (992, " \n\t"), (None, None), (993, "x" * 50_000), (994, "word " * 3000)]
STAGES = [f for name, f in C.STAGES if name != "packing"]


def test_toxicity_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rest(spark, C.toxicity, [*texts.items(), *ODD])
    stay = {r["doc_id"] for r in got}
    assert {990, 991, 992, 993, 994, None} <= stay and all(r["n_chars"] == -1 and r["text"] == texts.get(r["doc_id"], r["text"]) for r in got)
    clean = [i for i, x in labels.items() if x == 0]
    toxic = [i for i, x in labels.items() if x == 1]
    assert sum(i in stay for i in clean) >= 0.95 * len(clean) and sum(i in stay for i in toxic) <= 0.3 * len(toxic)


def test_line_dedup_stage(spark):
    lines = [" ".join(words(k, 8)) for k in range(4)]
    rows = [(1, "\n".join(lines[:2])), (2, "\n".join([lines[2], lines[0], lines[1] + "x"])), (None, lines[3]), (3, lines[3]), (3, lines[3]), *ODD]
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rest(spark, C.line_dedup, rows) if r["doc_id"] in (1, 2, 3))
    assert got == [(1, rows[0][1], len(rows[0][1])), (2, lines[2], len(lines[2])), (3, "", 0), (3, "", 0)]
    assert len(rest(spark, C.line_dedup, rows)) == len(rows)


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    base, other = words(1, 200), words(2, 200)
    near = " ".join(base[:100] + ["changed"] + base[101:])
    rows = [(5, " ".join(base)), (3, near), (9, " ".join(other)), *[(i, t) for i, t in ODD if i]]
    stay = {r["doc_id"] for r in rest(spark, C.near_dedup, rows)}
    assert stay == {3, 9, 990, 991, 992, 993, 994}
    # one id on two texts, one of them a copy; copies that share an id; copies without one
    rows = [(1, " ".join(base)), (2, near), (2, " ".join(other)), (4, "copy " + near), (4, "copy " + near), *[(None, " ".join(words(3, 90)))] * 40, (None, None), (None, "")]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in rest(spark, C.near_dedup, rows))
    assert got == sorted([(1, " ".join(base)), (2, " ".join(other)), (0, " ".join(words(3, 90))), (0, ""), (0, "")])


def test_substring_dedup_stage(spark):
    shared = " ".join(words(7, 60))
    rows = [(1, "only here  " + shared), (2, shared + " and there"), (3, "left  as \n it is"), (None, shared), *ODD]
    got = {r["doc_id"]: r for r in rest(spark, C.substring_dedup, rows)}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["only here", "and there", "left  as \n it is"]
    assert [got[i]["n_chars"] for i in (1, 2, 3)] == [9, 9, 16] and got[990]["text"] is None and got[994]["text"] == ""


def test_packing_stage(spark):
    rows = [(1, "some words"), (2, None), *ODD[1:]]
    out = C.packing(spark, table(spark, rows), SF_SMALL)
    pieces = out.collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, 991, 992, 993, 994, None}
    per = {}
    for r in pieces:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in per.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES])
def test_stages_on_empty_tables(spark, stage):
    assert stage(spark, spark.createDataFrame([], CLASH), SF_SMALL).count() == 0


@pytest.mark.parametrize("stage", STAGES)
def test_stages_on_null_rows_only(spark, stage):
    out = stage(spark, table(spark, [(None, None)] * 5), SF_SMALL)
    assert out.count() == 5


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF_SMALL), "by-hand")
    order = ["doc_id", "start"]
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(C.run(spark, SF_SMALL).orderBy(*order)) == key(docs)


COLUMNS = {
    "op1_nn_descent": ["query_id", "rank", "vec_id", "score"], "op2_bucket_digest": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op3_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op4_string_kernel": ["doc_id", "held_out", "score", "predicted"],
    "op5_tier_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op6_cover_anchors": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_line_variants": ["doc_id"], "op8_repair_shards": ["doc_id", "start", "n_tokens", "ids_crc32"], "op9_set_sketch": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10_bpe_chunks": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op11_gram_scan": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12_survival_words": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op13_scalar_tables": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]}
BY_DOCUMENT = ["op2_bucket_digest", "op4_string_kernel", "op6_cover_anchors", "op7_line_variants", "op8_repair_shards", "op9_set_sketch", "op10_bpe_chunks", "op11_gram_scan"]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_returns_its_columns_and_rows(spark, name):
    out = queries.QUERIES[name](spark, SF_SMALL)
    assert set(COLUMNS[name]) <= set(out.columns)
    n_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert out.count() == n_docs if name in BY_DOCUMENT else out.count() > 0
    if name in BY_DOCUMENT:
        assert out.agg(F.countDistinct("doc_id")).first()[0] == n_docs


def test_line_query_equals_its_operator(spark):
    import hashlib
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r for r in line_variants.remove_lines(docs).collect()}
    for r in queries.QUERIES["op7_line_variants"](spark, SF_SMALL).collect():
        own = texts[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["kept_sha256"]) == (own["n_lines"], own["n_removed"], hashlib.sha256((own["text"] or "").encode()).hexdigest())


def test_a_worker_drops_what_another_operator_kept(spark):
    import public_tokenizers

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(piece_cache._READY) + (len(common.WORDS._up) > 1)] * b.num_rows, pa.int64())], ["n"])

    docs = spark.createDataFrame([(i, "some words " * 9) for i in range(8)], "doc_id bigint, text string").coalesce(1)
    tier_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2).count()
    sketches = set_sketch.sketches(docs, 20)
    assert sketches.count() == 8
    # each worker: the next operator's function finds nothing of the one before
    assert {r.n for r in docs.mapInArrow(common.in_turn("next", held), "n bigint").collect()} == {0}
    piece_cache.encoder(public_tokenizers.path("word_bpe_49k.json"))
    common.WORDS.prefix(np.ones(9, np.uint64))
    list(common.in_turn("first", iter)([]))
    assert not piece_cache._READY and len(common.WORDS._up) == 1


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2 ** 20
    finally:
        tracemalloc.stop()


def test_sketches_and_sets_need_little_memory():
    text = " ".join(words(5, 5000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([text] * 100), *[pa.array([1] * 100, pa.int64())] * 2], ["doc_id", "text", "cluster", "n_blocks"])
    for run in (set_sketch._sketch(20), set_sketch._sets):
        common.WORDS.clear()
        assert peak(lambda: sum(b.num_rows for b in run(iter([batch])))) < 25  # noqa: B023


def test_intersections_need_little_memory_and_are_right():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 3000, n)).astype(np.uint64) for n in (2000, 1, 500, 2500)]
    for i, row in enumerate(set_sketch.intersections(sets)):
        for j, n in enumerate(row):
            if i != j:
                assert n == len(np.intersect1d(sets[i], sets[j]))
    large = [np.arange(k, k + 100_000, dtype=np.uint64) * np.uint64(k % 2 + 1) for k in range(10)]
    assert peak(lambda: set_sketch.intersections(large)) < 50
