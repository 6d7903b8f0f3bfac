"""Hand-made edge frames (FIXTURES §4)."""

import math

import pytest
from pyspark.sql import functions as F

from prefline.config import RewardConfig, SplitConfig, TokenConfig
from prefline.functions import scores as S
from prefline.functions import templates as TM
from prefline.operators import preference as P
from prefline.operators import rewards as R
from prefline.operators.pairs import incomplete, pair_keys, preference_pairs
from prefline.operators.scorers import OUTPUT_TYPE, WordStatDetector
from prefline.operators.split import split_flags, split_parts
from prefline.operators.tokens import Encoder, attention_mask, build_vocab, pad
from prefline.sources.adapters import adapt_queries, drop_existing, nested_queries

OUT_SCHEMA = f"id long, outputs {OUTPUT_TYPE.simpleString()}"


def test_label_score_cases(spark):
    rows = [
        (1, [("ChatGPT", 0.9), ("machine", 0.1)]),        # no human label
        (2, [("human", 0.2), ("Human", 0.7)]),            # two human labels -> first
        (3, [("ChatGPT", -1.0), ("HUMAN", 0.4)]),         # upper case
        (4, []),                                          # empty array
    ]
    df = spark.createDataFrame(rows, OUT_SCHEMA)
    got = {r["id"]: r["s"] for r in df.select("id", S.label_score("outputs").alias("s")).collect()}
    assert got == {1: None, 2: 0.2, 3: 0.4, 4: None}


def test_top_score_picks_best_not_first(spark):
    df = spark.createDataFrame([(1, [("LABEL_1", -0.5), ("LABEL_0", 0.5)])], OUT_SCHEMA)
    r = df.select(S.top_score("outputs").alias("s"), S.top_label("outputs").alias("l")).first()
    assert (r["s"], r["l"]) == (0.5, "LABEL_0")


def test_cap_and_scale(spark):
    vals = [(1, 1.0), (2, 1.0 + 1e-12), (3, -0.25), (4, float("nan")), (5, None), (6, 0.5)]
    df = spark.createDataFrame(vals, "id long, x double")
    got = {r["id"]: r["y"] for r in df.select("id", S.capped_scaled("x").alias("y")).collect()}
    assert got[1] == 4.0 and got[2] == 4.0
    assert got[3] == -4.0 + (-0.25 / 1.0) * 8.0
    assert math.isnan(got[4]) and got[5] is None
    assert got[6] == 0.0


def test_scale_rejects_equal_bounds():
    with pytest.raises(ValueError):
        S.scale(F.lit(1.0), 2.0, 2.0, 0.0, 1.0)


def test_guarded_min_and_weighted(spark):
    df = spark.createDataFrame([(1, 0.3, 0.5), (2, None, 0.5), (3, float("nan"), 0.1), (4, -2.0, 0.9)],
                               "id long, a double, b double")
    got = {r["id"]: r["m"] for r in df.select("id", S.guarded_min("a", "b").alias("m")).collect()}
    assert got[1] == 0.3 and got[2] is None and math.isnan(got[3]) and got[4] == -2.0
    w = df.select(S.weighted("b", "a", 0.5).alias("w")).where("a = 0.3").first()["w"]
    assert w == 0.5 * 0.5 + 0.5 * ((1 / 256) * 0.3)


def test_reward_quarantine_on_missing_human(spark):
    df = spark.createDataFrame([(1, "q", "a b c", ""), (2, "q", "x y", "z z")],
                               "conv_id long, query string, response string, ref_response string")
    scored = R.compute_reward(df, WordStatDetector(), None, RewardConfig(use_helpfulness=False))
    good, bad = R.split_valid(scored, ["reward", "ref_reward"])
    assert [r["conv_id"] for r in good.collect()] == [2]
    assert [(r["conv_id"], r["reason"]) for r in bad.collect()] == [(1, "null_ref_reward")]


def test_length_filter_boundaries(spark):
    from prefline.config import DatasetConfig
    from prefline.operators.datasets import build_query_dataset
    L = 3
    rows = [(1, "a b"), (2, "a b c"), (3, "a b c d"), (4, ""), (5, "!!! ...")]
    df = spark.createDataFrame(rows, "conv_id long, query string")
    vocab = build_vocab(spark.createDataFrame([("a b c",)], "text string"), "text", TokenConfig(vocab_size=10))
    enc = Encoder(spark, vocab, TokenConfig(vocab_size=10))
    out = build_query_dataset(df, enc, DatasetConfig(max_length=L, tokens=TokenConfig(vocab_size=10)), template=False)
    got = {r["conv_id"]: (r["input_ids"], r["attention_mask"]) for r in out.collect()}
    assert set(got) == {1, 2, 4, 5}          # L+1 dropped, L kept
    assert got[2][1] == [1, 1, 1] and len(got[2][0]) == L
    assert got[1][0][0] == 0 and got[1][1] == [0, 1, 1]
    assert got[4] == ([0, 0, 0], [0, 0, 0])


def test_pad_right_and_no_truncation(spark):
    df = spark.createDataFrame([([5, 6],), ([1, 2, 3, 4],)], "ids array<int>")
    got = df.select(pad("ids", 3, "right", 9).alias("p"), attention_mask("ids", 3, "right").alias("m")).collect()
    assert got[0]["p"] == [5, 6, 9] and got[0]["m"] == [1, 1, 0]
    assert got[1]["p"] == [1, 2, 3, 4] and got[1]["m"] == [1, 1, 1, 1]


def test_message_rendering_edges(spark):
    schema = "id long, chosen array<struct<role:string,content:string>>, " \
             "rejected array<struct<role:string,content:string>>"
    two = [("system", "be 'nice'"), ("user", 'say "hi"\nnow')]
    rows = [(0, [], two), (1, [("user", "x")], two), (2, two + [("assistant", "ok")], two)]
    df = spark.createDataFrame(rows, schema)
    out = P.render_messages(df).collect()
    assert [r["id"] for r in out] == [1, 2]
    assert (out[0]["prompt"], out[0]["chosen"]) == ("</s>", "user: x\n\n</s>")
    r = out[1]
    assert r["prompt"] == "system: be 'nice'\n\nuser: say \"hi\"\nnow\n\n</s>"
    assert r["chosen"] == "assistant: ok\n\n</s>"
    assert r["rejected"] == "user: say \"hi\"\nnow\n\n</s>"


def test_model_family_dispatch():
    assert TM.model_family("mistralai/Mistral-7B") == "mistral"
    assert TM.model_family("google/Gemma-2b") == "gemma"
    assert TM.model_family("gemma-mistral-merge") == "mistral"  # first match wins
    assert TM.model_family("microsoft/phi-3") == "default"


def test_flat_render_reads_inputs_before_overwrite(spark):
    df = spark.createDataFrame([(1, "Q", "good", "bad")], "conv_id long, query string, chosen string, rejected string")
    r = P.render_flat(df, "google/gemma", sys_prompt=True).first()
    assert r["prompt"] == "system: Provide naturally sounding answers.\n\nuser: Q\n\n</s>"
    assert r["chosen"] == "<start_of_turn>model\ngood<end_of_turn>\n"
    assert r["rejected"] == "<start_of_turn>model\nbad<end_of_turn>\n"


def test_nested_adapter(spark):
    schema = "source string, conversation array<struct<input:string,output:string>>"
    df = spark.createDataFrame([("s", [("first", "a"), ("second", "b")]), ("t", [])], schema)
    got = [r["query"] for r in adapt_queries(df, "someone/pure-dove-chats").collect()]
    assert got == ["first", None]
    assert nested_queries(df).columns == ["query"]
    with pytest.raises(ValueError):
        drop_existing(df, ["missing"])


def test_pairs_tiny(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "user", "q0"), (0, 2, "assistant", "a0"), (0, 3, "assistant", "a0b"),
            (1, 0, "user", "q1"),                      # no answer: no pair, passed over as a next one
            (2, 1, "user", "q2"), (2, 0, "assistant", "a2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in preference_pairs(df).collect())
    # the next answered one after 0 is 2, after 2 it is 0
    assert got == [(0, "q0", "a0", "a2"), (2, "q2", "a2", "a0")]
    assert [tuple(r) for r in incomplete(df).collect()] == [(1, "no_answer")]
    assert sorted(r[0] for r in pair_keys(df).collect()) == [0, 2]


def test_pairs_on_sparse_ids(spark):
    rows = [(i, t, r, f"{r}{i}") for i in (-5, 0, 1_000_000, 2 ** 60) for t, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows + [(None, 0, "user", "x"), (None, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rejected"] for r in preference_pairs(df.repartition(3)).collect()}
    assert got == {-5: "assistant0", 0: "assistant1000000", 1_000_000: f"assistant{2 ** 60}", 2 ** 60: "assistant-5"}
    assert [tuple(r) for r in incomplete(df).collect()] == [(None, "null_id")]
    assert preference_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7])
@pytest.mark.parametrize("frac", [0.0, 0.8, 1.0])
def test_split_sizes(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "k")
    flags = split_flags(df, "k", SplitConfig(fraction=frac, seed=7)).collect()
    n_train = sum(r["in_train"] for r in flags)
    assert n_train == int(frac * n)
    assert all(r["in_train"] != r["in_eval"] for r in flags)
    ind = split_parts(df, "k", SplitConfig(fraction=frac, seed=7, mode="independent")).collect()
    assert sum(r["part"] == "train" for r in ind) == int(frac * n)
    assert sum(r["part"] == "eval" for r in ind) == n - int(frac * n)


def test_trial_schedule_edges(spark):
    from prefline.operators.trials import with_schedule
    t = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 4, 4)], "trial long, mini_batch int, accum int")
    got = {r["trial"]: (r["steps"], r["log_steps"]) for r in with_schedule(t, F.lit(20)).collect()}
    assert got == {0: (20, 3), 1: (5, 1), 2: (2, 1)}          # logged: step 1, 10, 20
    assert {r["trial"]: r["log_steps"] for r in with_schedule(t, F.lit(20), 1).collect()} == {0: 20, 1: 5, 2: 2}
    assert {r["steps"] for r in with_schedule(t, F.lit(0)).collect()} == {0}
    assert {r["log_steps"] for r in with_schedule(t, F.lit(0)).collect()} == {0}


def test_split_null_keys_in_neither_part(spark):
    df = spark.createDataFrame([(i,) for i in range(10)] + [(None,), (None,)], "k long")
    rows = split_flags(df, "k", SplitConfig(fraction=0.5, seed=3)).collect()
    assert len(rows) == 12
    assert sum(r["in_train"] for r in rows) == 5
    assert sum(r["in_eval"] for r in rows) == 5
    assert all(not r["in_train"] and not r["in_eval"] for r in rows if r["k"] is None)


def test_catalog_load(spark, tmp_path):
    from prefline.sources.tables import Catalog
    from given_tables import SF_SMALL
    cat = Catalog(spark, SF_SMALL)
    assert cat.load("labels").columns == ["doc_id", "quality", "toxic"]
    path = str(tmp_path / "reviews.json")
    spark.createDataFrame([(1, "nice")], "id long, text string").write.json(path)
    cat.register("imdb", path, "json", "id BIGINT, text STRING")
    assert [tuple(r) for r in cat.load("imdb").collect()] == [(1, "nice")]
    with pytest.raises(ValueError):
        cat.load("imdb", split="test")


def test_query_dataset_with_chat_template(spark):
    from prefline.config import DatasetConfig
    from prefline.operators.datasets import build_query_dataset
    cfg_t = TokenConfig(vocab_size=10)
    vocab = build_vocab(spark.createDataFrame([("user hello system you",)], "text string"), "text", cfg_t)
    enc = Encoder(spark, vocab, cfg_t)
    df = spark.createDataFrame([(1, "Hello there")], "conv_id long, query string")
    ids = {t: [r["input_ids"] for r in build_query_dataset(
        df, enc, DatasetConfig(max_length=8, padding=False, tokens=cfg_t, sys_prompt=s,
                               sys_prompt_text="You"), template=True).collect()][0]
        for t, s in (("plain", False), ("system", True))}
    voc = {r["tok"]: r["id"] for r in vocab.collect()}
    assert ids["plain"] == [voc["user"], voc["hello"], 1, 3]          # user: hello there</s>
    assert ids["system"] == [voc["system"], voc["you"], voc["user"], voc["hello"], 1, 3]
    short = build_query_dataset(df, enc, DatasetConfig(max_length=3, padding=False, tokens=cfg_t), template=True)
    assert short.count() == 0                                           # 4 tokens with eos > 3


def test_preference_form_dispatch(spark):
    from prefline.sources.adapters import preference_form
    flat = spark.createDataFrame([("q", "a", "b")], "query string, chosen string, rejected string")
    msgs = spark.createDataFrame([([("user", "x")], [("user", "y")])],
                                 "chosen array<struct<role:string,content:string>>, "
                                 "rejected array<struct<role:string,content:string>>")
    assert preference_form(flat) == "flat" and preference_form(msgs) == "messages"
    assert preference_form(msgs, "org/long-pairs", flat_name_marker="long-pairs") == "flat"


def test_configure_cluster_sets_sql_conf(spark):
    from prefline.session import CLUSTER_CONF, configure_cluster
    keys = [k for k in CLUSTER_CONF if k.startswith("spark.sql.")]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        configure_cluster(spark)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 20000
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("256m", str(256 << 20))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_scorer_registry():
    from prefline.operators.scorers import (OverlapPairScorer, RawScoreDetector, build_scorer, parse_spec,
                                            register_scorer)
    assert parse_spec("text-classification:some/model") == ("text-classification", "some/model")
    for bad in ("no-colon", "a:b:c"):
        with pytest.raises(ValueError):
            parse_spec(bad)
    assert isinstance(build_scorer("text-classification:wordstat-detector"), WordStatDetector)
    assert isinstance(build_scorer("Binoculars"), RawScoreDetector)            # containment, any case
    with pytest.raises(KeyError):
        build_scorer("text-classification:unknown")
    register_scorer("text-classification:mine", OverlapPairScorer)
    assert isinstance(build_scorer("text-classification:mine"), OverlapPairScorer)


def test_conversation_messages_ordered(spark):
    rows = [(7, 2, "assistant", "c"), (7, 0, "system", "a"), (7, 1, "user", "b"), (8, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(m["role"], m["content"]) for m in r["messages"]]
           for r in P.conversation_messages(df).collect()}
    assert got == {7: [("system", "a"), ("user", "b"), ("assistant", "c")], 8: [("user", "x")]}
