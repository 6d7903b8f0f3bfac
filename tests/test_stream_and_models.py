"""Streaming scorer (stream = batch, incremental, exactly-once), generator and trained scorer."""

import os
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prefline.config import TokenConfig
from prefline.operators.generate import EchoGenerator, collate, generate
from prefline.operators.ml_scorer import LinearTextScorer
from prefline.operators.rewards import human_scores
from prefline.operators.tokens import Encoder, build_vocab, encode_join
from prefline.functions.text import words
from prefline.sources.sinks import append_log, cadence, read_log
from prefline.sources.tables import read_table, table_path
from prefline.streaming.score_stream import score_new_turns, score_turns

from given_tables import SF_SMALL


def test_stream_equals_batch(spark):
    src = table_path(SF_SMALL, "conversations")
    streamed = score_new_turns(spark, src)
    batch = score_turns(read_table(spark, SF_SMALL, "conversations"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_is_incremental_and_exactly_once(spark):
    d = tempfile.mkdtemp(prefix="prefline-src-")
    table = pq.read_table(table_path(SF_SMALL, "conversations"))
    half = table.num_rows // 2
    pq.write_table(table.slice(0, half), os.path.join(d, "part-0.parquet"))
    sink = tempfile.mkdtemp(prefix="prefline-sink-")
    ckpt = tempfile.mkdtemp(prefix="prefline-ckpt-")
    first = score_new_turns(spark, d, sink, ckpt).count()
    again = score_new_turns(spark, d, sink, ckpt).count()      # nothing new: no duplicates
    assert first == again
    pq.write_table(table.slice(half), os.path.join(d, "part-1.parquet"))
    total = score_new_turns(spark, d, sink, ckpt).count()
    expected = score_turns(read_table(spark, SF_SMALL, "conversations")).count()
    assert total == expected and first < total


def test_generator_batches(spark):
    qs = spark.createDataFrame([(1, "Hello big World"), (2, None), (3, "x " * 600)], "conv_id long, query string")
    got = {r["conv_id"]: (r["response"], r["ref_response"]) for r in generate(qs, EchoGenerator).collect()}
    assert got[1] == ("world big hello", "hello big world")
    assert got[2] == (None, None)
    assert len(got[3][0].split()) == 600  # whole, unless the caller sets a budget
    assert len(generate(qs.where("conv_id = 3"), lambda: EchoGenerator(512)).first()["response"].split()) == 512
    import pandas as pd
    assert collate(pd.DataFrame({"a": [1, 2], "b": ["x", "y"]})) == {"a": [1, 2], "b": ["x", "y"]}


def test_linear_scorer_plugs_into_rewards(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    labels = read_table(spark, SF_SMALL, "labels").selectExpr("doc_id", "quality as label")
    scorer = LinearTextScorer(num_features=1 << 12, max_iter=5).fit(docs.join(labels, "doc_id"), "text", "label")
    ro = docs.limit(5).selectExpr("doc_id as conv_id", "text as response", "text as ref_response")
    out = human_scores(ro, scorer, "text-classification:linear").collect()
    assert len(out) == 5 and all(0 <= r["human"] <= 1 and r["human"] == r["ref_human"] for r in out)


def test_arrow_and_join_encoders_agree(spark):
    cfg = TokenConfig(vocab_size=300)
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", words("text").alias("w"))
    vocab = build_vocab(read_table(spark, SF_SMALL, "documents"), "text", cfg)
    enc = Encoder(spark, vocab, cfg)
    a = {r["doc_id"]: r["ids"] for r in docs.select("doc_id", enc.encode("w").alias("ids")).collect()}
    b = {r["doc_id"]: r["input_ids"] for r in encode_join(docs, "doc_id", "w", vocab, cfg=cfg).collect()}
    assert a == b
    assert any(1 in v for v in a.values())           # unknown words occur
    dec = docs.select(enc.decode(enc.encode("w")).alias("t"), "w").limit(20).collect()
    known = set(r["tok"] for r in vocab.collect())
    for r in dec:
        assert r["t"] == " ".join(x for x in r["w"] if x in known)


def test_joined_encoding_is_lossless(spark, monkeypatch):
    import prefline.operators.tokens as TK
    monkeypatch.setattr(TK, "HEAD_ENTRIES", 50)  # most words take the shuffled way
    rows = read_table(spark, SF_SMALL, "documents").select("doc_id", words("text").alias("w"))
    empty = spark.createDataFrame([(-1, []), (-2, None)], "doc_id long, w array<string>")
    vocab = build_vocab(read_table(spark, SF_SMALL, "documents"))
    ids = encode_join(rows.unionByName(empty), "doc_id", "w", vocab)
    back = {r["doc_id"]: r for r in TK.decode_join(ids, "doc_id", "input_ids", vocab).collect()}
    assert len(back) == rows.count() + 2
    for r in back.values():
        assert r["text"] == " ".join(r["w"] or []) and len(r["input_ids"]) == len(r["w"] or [])


@pytest.mark.parametrize("run", [1 << 20, 3])
@pytest.mark.parametrize("head", [0, 2, 65_536])
def test_joined_lookup_places_missed_words(spark, monkeypatch, head, run):
    import prefline.operators.tokens as TK
    monkeypatch.setattr(TK, "HEAD_ENTRIES", head)
    monkeypatch.setattr(TK, "RUN_ITEMS", run)
    long = "l" * 70  # frequent, but too long for the head
    texts = [(1, f"a b c {long} a a".split()), (2, ["b", None, "none", "a"]), (3, []), (4, None), (None, ["c", "b"]), (None, ["a"]),
             (5, [long, "b"]), (5, ["a", "c", "a"])]
    df = spark.createDataFrame(texts, "k long, w array<string>")
    vocab = spark.createDataFrame([("a", 9, 4), (long, 8, 5), ("b", 7, 6), ("c", 1, 7)], "tok string, n long, id long")
    out = encode_join(df, "k", "w", vocab)
    got = sorted((str(r["k"]), r["input_ids"]) for r in out.collect())
    # rows of one key have one list, by position and then id
    assert got == [("1", [4, 6, 7, 5, 4, 4]), ("2", [6, 1, 1, 4]), ("3", []), ("4", []), ("5", [4, 5, 6, 7, 4]), ("5", [4, 5, 6, 7, 4]),
                   ("None", [4, 7, 6]), ("None", [4, 7, 6])]
    back = TK.decode_join(out.where("k < 5"), "k", "input_ids", vocab)
    assert {r["k"]: r["text"] for r in back.collect()} == {1: f"a b c {long} a a", 2: "b a", 3: "", 4: ""}


def test_joined_lookup_shuffles_few_words_and_every_row_once(spark, monkeypatch):
    import prefline.operators.tokens as TK
    monkeypatch.setattr(TK, "HEAD_ENTRIES", 495)
    path = tempfile.mkdtemp(prefix="prefline-lookup-")
    spark.range(400).selectExpr("id AS k", "transform(sequence(1, 500), i -> concat('w', i)) AS w").write.parquet(f"{path}/rows")
    vocab = spark.createDataFrame([(f"w{i}", 1, 3 + i) for i in range(1, 501)], "tok string, n long, id long")
    out = TK.encode_join(spark.read.parquet(f"{path}/rows"), "k", "w", vocab)
    assert all(r["input_ids"] == list(range(4, 504)) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the words are not exploded, and both uses of the rows' lists read one exchange
    assert "posexplode" not in plan and "ReusedExchange" in plan


def test_uncapped_vocab_ids_dense(spark):
    docs = spark.createDataFrame([("b a a c",), ("a b",)], "text string")
    v = build_vocab(docs, "text", TokenConfig(vocab_size=None)).orderBy("id").collect()
    assert [(r["tok"], r["n"], r["id"]) for r in v] == [("a", 3, 4), ("b", 2, 5), ("c", 1, 6)]


def test_log_sink_and_cadence(spark, tmp_path):
    df = spark.range(1, 31).selectExpr("id as conv_id", "'q' as query", "'r' as response",
                                      "'rr' as ref_response", "0.5D as ref_rewards", "id as step")
    path = str(tmp_path / "log")
    append_log(df, path, "run-a", step="step")
    append_log(df.limit(3), path, "run-b", step="step")
    assert read_log(spark, path, "run-a").count() == 30
    assert read_log(spark, path, "run-b").count() == 3
    steps = sorted(r["step"] for r in cadence(read_log(spark, path, "run-a")).collect())
    assert steps == [1, 10, 20, 30]


def test_pandas_scorers_match_native(spark):
    import regex as re_
    from prefline.operators.scorers import (OverlapPairScorer, PandasPairScorer, PandasTextScorer,
                                            WordStatDetector, truncate_words)
    from prefline.operators.rewards import pair_scores
    word = re_.compile(r"[\p{L}\p{N}_]+")

    def detector_factory():
        def fn(texts):
            out = []
            for t in texts:
                w = word.findall(t.lower())
                logit = 8.0 * len(set(w)) / len(w) - 6.0 if w else float("nan")
                out.append([{"label": "ChatGPT", "score": -logit}, {"label": "Human", "score": logit}])
            return out
        return fn

    def pair_factory():
        def fn(batch):
            out = []
            for item in batch:
                q = set(word.findall(item["text"].lower()))
                a = set(word.findall(item["text_pair"].lower()))
                s = len(q & a) / len(q)
                out.append([{"label": "LABEL_0", "score": s}])
            return out
        return fn

    ro = read_table(spark, SF_SMALL, "conversations").where("role = 'assistant'") \
        .selectExpr("conv_id * 100 + turn as conv_id", "text as query", "text as response",
                    "concat(text, ' x') as ref_response")
    py = human_scores(ro, PandasTextScorer("py-detector", detector_factory, max_tokens=None))
    native = human_scores(ro, WordStatDetector())
    a = {r["conv_id"]: (r["human"], r["ref_human"]) for r in py.collect()}
    b = {r["conv_id"]: (r["human"], r["ref_human"]) for r in native.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0]) and a[k][1] == pytest.approx(b[k][1])
    pp = pair_scores(ro, PandasPairScorer("py-pair", pair_factory, max_tokens=None)).collect()
    pn = {r["conv_id"]: r["ref_helpful"] for r in pair_scores(ro, OverlapPairScorer()).collect()}
    assert all(r["ref_helpful"] == pytest.approx(pn[r["conv_id"]]) for r in pp)
    t = spark.createDataFrame([("  One, two; three four!",), (None,)], "t string")
    got = [r[0] for r in t.select(truncate_words("t", 2)).collect()]
    assert got == ["  One, two", None]


def test_tensor_dataset_round_trip(spark, tmp_path):
    from prefline.sources.sinks import write_tensor_dataset
    df = spark.createDataFrame([(1, [0, 0, 5], [0, 0, 1])], "conv_id long, input_ids array<int>, attention_mask array<int>")
    path = str(tmp_path / "tensors")
    write_tensor_dataset(df, path)
    t = pq.read_table(path)
    assert t.column("input_ids").to_pylist() == [[0, 0, 5]]


def test_vocab_numbering_matches_a_sort(spark):
    import prefline.operators.tokens as TK
    docs = read_table(spark, SF_SMALL, "documents")
    cfg = TokenConfig(vocab_size=700)
    top = TK.word_counts(docs).orderBy(F.desc("n"), "tok").limit(700).collect()
    direct = [(r["tok"], r["n"], 4 + i) for i, r in enumerate(top)]
    dist = [tuple(r) for r in TK.build_vocab(docs.repartition(5), "text", cfg).orderBy("id").collect()]
    assert dist == direct and len(direct) == 700


@pytest.mark.parametrize("large", ["true", "false"])
def test_encoder_with_large_arrow_types(spark, large):
    key = "spark.sql.execution.arrow.useLargeVarTypes"
    old = spark.conf.get(key, None)
    spark.conf.set(key, large)
    try:
        vocab = build_vocab(spark.createDataFrame([("b a a c",)], "text string"), "text", TokenConfig(vocab_size=2))
        enc = Encoder(spark, vocab, TokenConfig(vocab_size=2))
        df = spark.createDataFrame([(1, "A b z"), (2, None), (3, "")], "id long, t string")
        got = {r["id"]: (r["ids"], r["back"]) for r in
               df.select("id", enc.encode(words("t")).alias("ids"))
                 .select("id", "ids", enc.decode("ids").alias("back")).collect()}
        assert got == {1: ([4, 5, 1], "a b"), 2: (None, None), 3: ([], "")}
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def test_rollout_step_logs_and_reads_back(spark, tmp_path):
    from prefline.config import RewardConfig
    from prefline.operators.rollout import log_rollout, rollout_rewards
    from prefline.operators.scorers import OverlapPairScorer, WordStatDetector
    qs = spark.createDataFrame([(1, "Alpha beta beta"), (2, "gamma")], "conv_id long, query string")
    out = rollout_rewards(qs, WordStatDetector(), OverlapPairScorer(), RewardConfig())
    path = str(tmp_path / "log")
    log_rollout(out, path, "r1")
    logged = {r["conv_id"]: r for r in read_log(spark, path, "r1").collect()}
    assert logged[1]["response"] == "beta beta alpha" and logged[1]["ref_response"] == "alpha beta beta"
    expected = {r["conv_id"]: r["ref_reward"] for r in out.collect()}
    assert {k: v["ref_rewards"] for k, v in logged.items()} == expected


def test_generators_do_not_share_worker_cache(spark):
    qs = spark.createDataFrame([(1, "a b c d")], "conv_id long, query string")
    short = generate(qs, lambda: EchoGenerator(1)).first()
    longer = generate(qs, lambda: EchoGenerator(3)).first()
    assert (short["response"], longer["response"]) == ("d", "d c b")


def test_stream_backlog_in_bounded_batches(spark):
    from prefline.streaming.score_stream import start_scoring
    d = tempfile.mkdtemp(prefix="prefline-src-")
    table = pq.read_table(table_path(SF_SMALL, "conversations"))
    step = table.num_rows // 3 + 1
    for i in range(3):
        pq.write_table(table.slice(i * step, step), os.path.join(d, f"part-{i}.parquet"))
    sink, ckpt = tempfile.mkdtemp(prefix="prefline-sink-"), tempfile.mkdtemp(prefix="prefline-ckpt-")
    q = start_scoring(spark, d, sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination(300)
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == 3
    expected = score_turns(read_table(spark, SF_SMALL, "conversations")).count()
    assert spark.read.parquet(sink).count() == expected


def test_encoder_result_independent_of_arrow_batch_size(spark):
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    old = {k: spark.conf.get(k, None) for k in keys}
    cfg = TokenConfig(vocab_size=300)
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", words("text").alias("w"))
    enc = Encoder(spark, build_vocab(read_table(spark, SF_SMALL, "documents"), "text", cfg), cfg)
    base = {r["doc_id"]: r["e"] for r in docs.select("doc_id", enc.encode("w").alias("e")).collect()}
    try:
        spark.conf.set(keys[0], str(64 << 10))
        spark.conf.set(keys[1], "7")
        small = {r["doc_id"]: r["e"] for r in docs.select("doc_id", enc.encode("w").alias("e")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert small == base


def test_empty_run_reads_as_empty_log(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, query string, response string, ref_response string, "
                                   "ref_rewards double")
    path = str(tmp_path / "log")
    append_log(df, path, "empty-run")
    assert read_log(spark, path, "empty-run", df.schema).count() == 0
    with pytest.raises(Exception):
        read_log(spark, path, "empty-run")


def test_truncation_leaves_short_texts_and_normal_training_uses_the_main_scorer(spark):
    from prefline.config import RewardConfig
    from prefline.operators.rewards import compute_reward
    from prefline.operators.scorers import OverlapPairScorer, WordStatDetector, truncate_words

    t = spark.createDataFrame([("hi there! :)",), ("!!!",), ("a b c.",), (" a b",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(truncate_words("t", 2)).collect()] == ["hi there! :)", "!!!", "a b", " a b", "", None]
    ro = spark.createDataFrame([("one two", "two three", "four one")], "query string, response string, ref_response string")
    cfg = RewardConfig(normal_training=True)
    main = compute_reward(ro, OverlapPairScorer(), WordStatDetector(), cfg).select("reward", "ref_reward").first()
    assert main == compute_reward(ro, OverlapPairScorer(), None, cfg).select("reward", "ref_reward").first()
