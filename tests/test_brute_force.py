"""Spark operators against plain-Python brute force on small generated fixtures."""

import hashlib
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefline.functions import templates as TM
from prefline.functions.losses import preference_loss
from prefline.operators.pairs import preference_pairs

SETTINGS = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))

ROLES = ["system", "user", "assistant"]
texts = st.text(alphabet=st.sampled_from(list("ab cdé\n'\"Ü1_")), min_size=0, max_size=12)


@st.composite
def conversation_tables(draw):
    n_conv = draw(st.integers(min_value=1, max_value=6))
    rows = []
    for c in draw(st.lists(st.integers(-2 ** 40, 2 ** 40), min_size=n_conv, max_size=n_conv, unique=True)):
        turns = draw(st.lists(st.tuples(st.sampled_from(ROLES), texts), min_size=1, max_size=5))
        order = draw(st.permutations(list(range(len(turns)))))
        for t, (role, text) in zip(order, turns):
            rows.append((c, t, role, text))
    return rows


def pairs_brute(rows):
    first = {}
    for c, t, role, text in rows:
        k = (c, role)
        if k not in first or t < first[k][0]:
            first[k] = (t, text)
    out = set()
    answered = sorted(c for c, role in first if role == "assistant")
    for i, c in enumerate(answered):
        follower = answered[(i + 1) % len(answered)]
        if (c, "user") in first:
            out.add((c, first[c, "user"][1], first[c, "assistant"][1], first[follower, "assistant"][1]))
    return out


@SETTINGS
@given(conversation_tables())
def test_pairs_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in preference_pairs(df).collect()}
    assert got == pairs_brute(rows)


def render_brute(msgs, eos="</s>"):
    return "".join(f"{r}: {c}\n\n" for r, c in msgs) + eos


@SETTINGS
@given(st.lists(st.lists(st.tuples(st.sampled_from(ROLES), texts), max_size=4), min_size=1, max_size=6))
def test_template_equals_brute_force(spark, lists):
    schema = "id long, m array<struct<role:string,content:string>>"
    df = spark.createDataFrame(list(enumerate(lists)), schema)
    got = {r["id"]: r["p"] for r in df.select("id", TM.render("m").alias("p")).collect()}
    assert got == {i: render_brute(m) for i, m in enumerate(lists)}


def softplus(z):
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def loss_brute(x, b, e, kind):
    if kind == "sigmoid":
        return (1 - e) * softplus(-b * x) + e * softplus(b * x)
    if kind == "hinge":
        return max(0.0, 1 - b * x)
    if kind == "ipo":
        return (x - 1 / (2 * b)) ** 2
    return ((1 - e) * softplus(-b * x) - e * softplus(b * x)) / (1 - 2 * e)


@SETTINGS
@given(st.lists(st.floats(min_value=-50, max_value=50, allow_nan=False), min_size=1, max_size=20),
       st.floats(min_value=0.3, max_value=0.7), st.floats(min_value=0.0, max_value=0.49),
       st.sampled_from(["sigmoid", "hinge", "ipo", "robust"]))
def test_losses_equal_brute_force(spark, xs, beta, eps, kind):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(preference_loss("x", beta, eps, kind)).collect()]
    for g, x in zip(got, xs):
        assert math.isclose(g, loss_brute(x, beta, eps, kind), rel_tol=1e-12, abs_tol=1e-12)


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=60, unique=True),
       st.floats(min_value=0, max_value=1), st.integers(min_value=0, max_value=99))
def test_split_equals_global_sort(spark, keys, frac, seed):
    from prefline.config import SplitConfig
    from prefline.operators.split import split_flags
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"] for r in split_flags(df, "k", SplitConfig(frac, seed)).where("in_train").collect()}
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))
    assert got == set(order[:int(frac * len(keys))])
    assert F is not None


def test_pairs_with_one_hot_conversation(spark):
    """A third of all turns under one conversation id: partial aggregation keeps
    one row per map task for it, and the result equals the brute force."""
    from prefline.sources.tables import read_table
    from given_tables import SF_SMALL
    conv = read_table(spark, SF_SMALL, "conversations")
    n = conv.select(F.max("conv_id")).first()[0] + 1
    hot = n // 3
    skewed = conv.select(
        F.when(F.col("conv_id") < hot, F.lit(0)).otherwise(F.col("conv_id")).alias("conv_id"),
        F.when(F.col("conv_id") < hot, F.col("conv_id") * 1000 + F.col("turn")).otherwise(F.col("turn")).alias("turn"),
        "role", "text").repartition(4)
    rows = [tuple(r) for r in skewed.collect()]
    assert sum(1 for r in rows if r[0] == 0) >= len(rows) // 4
    out = preference_pairs(skewed)
    assert {tuple(r) for r in out.collect()} == pairs_brute(rows)
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in p


def test_linear_scorer_matches_hand_computed_probability(spark):
    """q32's scoring: each probability equals the logistic of intercept + sum of
    coefficient x term count, recomputed by hand from the fitted model."""
    import regex
    from collections import Counter
    from prefline.operators.ml_scorer import LinearTextScorer
    from prefline.sources.tables import read_table
    from given_tables import SF_SMALL
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    labels = read_table(spark, SF_SMALL, "labels").select("doc_id", F.col("quality").alias("label"))
    scorer = LinearTextScorer(num_features=1 << 12, max_iter=10).fit(docs.join(labels, "doc_id"), "text", "label")
    tf, lr = scorer.model.stages[1], scorer.model.stages[2]
    coef = lr.coefficients.toArray()
    got = {r["doc_id"]: r["score"] for r in scorer.probability(docs, "text", "score").collect()}
    word = regex.compile(r"[\p{L}\p{N}_]+")
    for doc_id, text in docs.orderBy("doc_id").limit(8).collect():
        counts = Counter(tf.indexOf(w) for w in word.findall(text.lower()))
        margin = lr.intercept + sum(coef[i] * c for i, c in counts.items())
        assert math.isclose(got[doc_id], 1 / (1 + math.exp(-margin)), rel_tol=1e-9, abs_tol=1e-12)
    # the fit learned something: training accuracy beats the majority class
    train = docs.join(labels, "doc_id").collect()
    acc = sum((got[r["doc_id"]] > 0.5) == (r["label"] == 1) for r in train) / len(train)
    majority = max(sum(r["label"] for r in train), len(train) - sum(r["label"] for r in train)) / len(train)
    assert acc >= majority


@SETTINGS
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=8), st.booleans())
def test_known_render_equals_array_render(spark, rows, with_sys):
    df = spark.createDataFrame(rows, "q string, s string")
    system = "Be brief." if with_sys else None
    a = df.select(TM.user_prompt(F.col("q"), system).alias("p")).collect()
    b = df.select(TM.render(TM.user_messages(F.col("q"), system)).alias("p")).collect()
    assert a == b
    c = df.select(TM.default_answer(F.col("s")).alias("p")).collect()
    d = df.select(TM.render(F.array(TM.message("assistant", F.col("s")))).alias("p")).collect()
    assert c == d


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é", "ü1", "_x", "zz", "q"]), max_size=8)),
                min_size=1, max_size=12),
       st.integers(min_value=1, max_value=5))
def test_arrow_encoder_equals_dict_lookup(spark, lists, v):
    from prefline.config import TokenConfig
    from prefline.operators.tokens import Encoder, build_vocab
    corpus = spark.createDataFrame([("a a a b b é ü1 _x zz",)], "text string")
    cfg = TokenConfig(vocab_size=v)
    vocab = build_vocab(corpus, "text", cfg)
    ids = {r["tok"]: r["id"] for r in vocab.collect()}
    enc = Encoder(spark, vocab, cfg)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i long, w array<string>")
    rows = df.select("i", enc.encode("w").alias("e")).select("i", "e", enc.decode("e").alias("d")).collect()
    for r in rows:
        words_ = lists[r["i"]]
        if words_ is None:
            assert r["e"] is None and r["d"] is None
            continue
        assert r["e"] == [ids.get(t, cfg.unk_id) for t in words_]
        assert r["d"] == " ".join(t for t in words_ if t in ids)


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=60, unique=True),
       st.floats(min_value=0, max_value=1), st.integers(min_value=0, max_value=99))
def test_independent_split_equals_two_global_sorts(spark, keys, frac, seed):
    from prefline.config import SplitConfig
    from prefline.operators.split import split_flags
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = split_flags(df, "k", SplitConfig(frac, seed, mode="independent", eval_seed=seed + 7)).collect()
    k = int(frac * len(keys))
    by = lambda s: sorted(keys, key=lambda x: (hashlib.md5(f"{s}|{x}".encode()).hexdigest(), x))
    assert {r["k"] for r in rows if r["in_train"]} == set(by(seed)[:k])
    assert {r["k"] for r in rows if r["in_eval"]} == set(by(seed + 7)[:len(keys) - k])
