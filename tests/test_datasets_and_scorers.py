"""Chat templates, the Bayes scorer, length batches, the step log, exact splits on repeated
keys, nested sources and subword datasets, against brute force."""

import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from given_tables import SF_ORACLE
from prefline.config import CHAT_TEMPLATES, DatasetConfig, SplitConfig, TokenConfig, WORD_PATTERN
from prefline.functions import templates as TM
from prefline.functions.chat_template import TemplateError, compile_template
from prefline.operators import bayes_scorer, subword
from prefline.operators.batches import length_batches, pad_batches, padding_share
from prefline.operators.split import split_audit, split_flags, train_eval
from prefline.sources.adapters import adapt_queries, nested_reason
from prefline.sources.tables import read_table
from prefline.streaming import step_log

MESSAGES = "id int, m array<struct<role:string,content:string>>"
CHATS = [(1, [("system", " S\n"), ("user", "hi  "), ("assistant", "a 'b' \"c\"")]), (2, [("user", "q\n"), ("assistant", "")]), (3, []), (4, [("user", "x")] * 30)]


def rendered(spark, template, rows=CHATS, **options):
    out = spark.createDataFrame(rows, MESSAGES).select("id", compile_template(template, **options)("m").alias("t")).collect()
    return {r["id"]: r["t"] for r in out}


def test_fallback_template_is_the_written_out_one(spark):
    df = spark.createDataFrame(CHATS, MESSAGES).select(compile_template(CHAT_TEMPLATES["fallback"])("m").alias("a"), TM.render("m").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


@pytest.mark.parametrize("prompt", [False, True])
def test_templates_equal_plain_code(spark, prompt):
    marks = {i: "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in m) + ("<|im_start|>assistant\n" if prompt else "") for i, m in CHATS}
    assert rendered(spark, CHAT_TEMPLATES["im_marks"], add_generation_prompt=prompt) == marks

    def turns(m):
        head = m[0][1].strip() + "\n\n" if m and m[0][0] == "system" else ""
        body = "".join(f"<start_of_turn>{'model' if r == 'assistant' else r}\n{c.strip()}<end_of_turn>\n" for r, c in (m[1:] if head else m))
        return "<b>" + head + body + ("<start_of_turn>model\n" if prompt else "")
    assert rendered(spark, CHAT_TEMPLATES["turn_marks"], bos_token="<b>", add_generation_prompt=prompt) == {i: turns(m) for i, m in CHATS}


@pytest.mark.parametrize("template, expected", [
    ("a\n{% if true %}\nb\n{% endif %}\nc", "a\nb\nc"),
    ("a\n   {%- if false -%}  b {% elif 1 == 1 %}\n c {%- else %}d{% endif %}  e", "a c  e"),
    ("{# note #}x{{ '}}' ~ \"%}\" }}y{{ '\\n' }}", "x}}%}y\n"),
    ("{% set a = 'p' %}{% if not (a == 'q') and true or false %}{% set a = a + 'r' %}{% endif %}{{ a }}", "pr"),
    ("{% for message in messages %}{{ loop.index }}{% if loop.first %}F{% endif %}{% if loop.last %}L{% endif %}{% if loop.index0 % 2 == 0 %}e{% endif %}{% endfor %}", "1Fe2L"),
    ("{{ messages[1].role }}{{ messages[7]['content'] }}{{ (messages[0]['content'] + 'z') | trim }}", "assistantq\nz"),
    ("  {% for m in messages[1:] %}{{ m.role }}{% endfor %}", "assistant"),
    ("", ""),
])
def test_template_syntax(spark, template, expected):
    assert rendered(spark, template)[2] == expected


def test_null_messages(spark):
    rows = [(1, None), (2, [(None, None), ("user", None)]), (3, [])]
    assert rendered(spark, CHAT_TEMPLATES["fallback"], rows) == {1: None, 2: ": \n\nuser: \n\n</s>", 3: "</s>"}


@pytest.mark.parametrize("template", [
    "{% macro x() %}{% endmacro %}", "{{ tools }}", "{{ message['role'] }}", "{% for a in messages %}", "{% if true %}x", "{{ messages[0]['name'] }}",
    "{{ 'a' | upper }}", "{{ raise_exception('no') }}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ 'a' ", "{% endfor %}",
    "{% set a %}", "{{ messages[x] }}", "{% if true %}{% set a = 'b' %}{% endif %}{{ a }}", "{{ 'a' 'b' }}", "{% for c in eos_token %}{% endfor %}", "{{ 1 & 2 }}"])
def test_unknown_syntax_is_an_error(spark, template):
    with pytest.raises(TemplateError):
        compile_template(template)


# ---------------------------------------------------------------- naive Bayes

def tokens(text):
    return regex.findall(WORD_PATTERN, (text or "").lower())


def brute_bayes(train, texts):
    counts = {0: Counter(), 1: Counter()}
    docs = Counter()
    for t, y in train:
        if t is not None and y in (0, 1):
            counts[y].update(tokens(t))
            docs[y] += 1
    vocab = set(counts[0]) | set(counts[1])
    n = {y: sum(counts[y].values()) for y in counts}
    near = lambda x: math.floor(abs(x) * 1e6 + 0.5) * (1 if x >= 0 else -1)
    weight = {w: near(math.log(((counts[1][w] + 1) * (n[0] + len(vocab))) / ((counts[0][w] + 1) * (n[1] + len(vocab))))) for w in vocab}
    prior = near(math.log((docs[1] + 1) / (docs[0] + 1)))
    return [prior + sum(weight.get(w, 0) for w in tokens(t)) for t in texts]


@pytest.mark.parametrize("head", [bayes_scorer.HEAD, 20])
def test_bayes_scores_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(bayes_scorer, "HEAD", head)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["the"] * 60 + ["Ünï", "x" * 80]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(80)] + [None, "", "the " * 4000]
    labelled = [(t, rng.choice([0, 1, 1, 2, None])) for t in texts]
    model = bayes_scorer.train(spark.createDataFrame(labelled, "text string, label int"))
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, "another text of id 0 w1"), (1, texts[1]), (1, texts[1]), (None, "the w3"), (None, None), (900, "unseen the the")]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id bigint, text string, score string").repartition(5)
    got = sorted(((r[0] is None, r[0] or 0, r[1]) for r in bayes_scorer.score(docs, model, "doc_id").collect()))
    assert got == sorted((k is None, k or 0, s) for (k, _), s in zip(rows, brute_bayes(labelled, [t for _, t in rows])))


def test_bayes_without_rows_or_labels(spark):
    empty = bayes_scorer.train(spark.createDataFrame([], "text string, label int"))
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in bayes_scorer.score(docs, empty, "doc_id").collect()) == [(1, 0), (2, 0)]
    one = bayes_scorer.train(spark.createDataFrame([("a b", 1)], "text string, label int"))
    assert bayes_scorer.score(docs.limit(0), one, "doc_id").count() == 0
    assert one.prior == round(1e6 * math.log(2))


def test_bayes_accuracy_on_held_out_labels(spark):
    """Better than always giving the commoner label, on rows that training did not see."""
    import __spark_entry__ as E
    out = E.queries()["q39_bayes_scorer"](spark, SF_ORACLE).where("held_out")
    rows = out.join(read_table(spark, SF_ORACLE, "labels"), "doc_id").select("predicted", "quality").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    common = max(Counter(r["quality"] for r in rows).values()) / len(rows)
    assert right >= common, (right, common, len(rows))


# ---------------------------------------------------------------- batches

def test_length_batches_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [rng.randrange(9) for _ in range(rng.choice([0, 3, 3, 3, 17]))]) for k in range(53)] + [(60, None)]
    df = spark.createDataFrame([(k, x, "c") for k, x in rows], "key bigint, ids array<int>, batch_size string").repartition(4)
    batched = length_batches(df, "key", "ids", 8)
    out = {r["key"]: r for r in pad_batches(batched, "ids").collect()}
    lists = {k: x or [] for k, x in rows}
    assert sorted(out) == sorted(lists)
    groups = {}
    for k, r in out.items():
        groups.setdefault(r["batch"], []).append(k)
    lengths = [sorted(len(lists[k]) for k in groups[b]) for b in sorted(groups)]
    assert [x for g in lengths for x in g] == sorted(len(x) for x in lists.values())
    assert [len(g) for g in lengths] == [8] * 6 + [6]
    for b, keys in groups.items():
        longest = max(len(lists[k]) for k in keys)
        for k in keys:
            n = len(lists[k])
            assert out[k]["batch_length"] == longest and out[k]["n_tokens"] == n and out[k]["batch_size"] == "c"
            assert out[k]["ids"] == [0] * (longest - n) + lists[k] and out[k]["attention_mask"] == [0] * (longest - n) + [1] * n
    total, slots = sum(map(len, lists.values())), sum(max(g) * len(g) for g in lengths)
    share = padding_share(batched).first()
    assert (share["tokens"], share["slots"]) == (total, slots) and share["padding_share"] == (slots - total) / slots
    raised = pad_batches(batched, "ids", TokenConfig(pad_id=None), "right", multiple=4).collect()
    assert all(len(r["ids"]) % 4 == 0 and r["ids"][r["n_tokens"]:] == [3] * (len(r["ids"]) - r["n_tokens"]) for r in raised)


def test_length_batches_of_nothing(spark):
    df = spark.createDataFrame([], "key bigint, ids array<int>")
    batched = length_batches(df, "key", "ids", 4)
    assert batched.count() == 0 and padding_share(batched).first()["padding_share"] is None
    with pytest.raises(ValueError):
        length_batches(df, "key", "ids", 0)


# ---------------------------------------------------------------- step log

TURNS = "conv_id bigint, turn bigint, role string, text string"


def write_turns(spark, folder, files):
    """Files of 7 conversations each, in the order in which a stream reads them."""
    import os
    import time
    rows = [[(7 * f + c, t, ("user", "assistant")[t % 2], f"word {c} {t} x" if c else None) for c in range(7) for t in range(4)] for f in range(files)]
    for f, part in enumerate(rows):
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and name not in getattr(write_turns, "seen", set()):
                os.utime(os.path.join(folder, name), (time.time() - 1000 + f,) * 2)
                write_turns.seen = getattr(write_turns, "seen", set()) | {name}
    return [(c, t) for part in rows for c, t, role, _ in part if role == "assistant"]


def expected_log(rows, size):
    steps = [(c, t, k // size + 1) for k, (c, t) in enumerate(sorted(rows))]
    return sorted(s for s in steps if s[2] == 1 or s[2] % 10 == 0)


@pytest.mark.parametrize("files", [1, 2, 100])
def test_step_log_equals_one_batch_job(spark, tmp_path, files):
    rows = write_turns(spark, str(tmp_path / "turns"), 5)
    log = step_log.log_scored_turns(spark, str(tmp_path / "turns"), 3, str(tmp_path / "log"), str(tmp_path / "ckpt"), files)
    assert sorted((r["conv_id"], r["turn"], r["step"]) for r in log.collect()) == expected_log(rows, 3)


def test_step_log_after_a_failure_between_its_writes(spark, tmp_path):
    """The run ends after a micro-batch's rows are written and before its state is: what a
    reader sees then is the log up to the micro-batch before it, and the next run repeats
    the micro-batch, so that each row is logged once."""
    rows = write_turns(spark, str(tmp_path / "turns"), 6)
    source, path, ckpt = (str(tmp_path / x) for x in ("turns", "log", "ckpt"))

    def stop(epoch):
        if epoch == 3:
            raise RuntimeError("stopped here")
    with pytest.raises(Exception, match="stopped here"):
        step_log.log_scored_turns(spark, source, 2, path, ckpt, 1, fail_before_state=stop)
    schema = "conv_id bigint, turn bigint, score double, step bigint"
    part = sorted((r["conv_id"], r["turn"], r["step"]) for r in step_log.read_step_log(spark, path, schema).collect())
    assert part == expected_log(rows[:3 * 14], 2)
    log = step_log.log_scored_turns(spark, source, 2, path, ckpt, 1)
    assert sorted((r["conv_id"], r["turn"], r["step"]) for r in log.collect()) == expected_log(rows, 2)
    again = step_log.log_scored_turns(spark, source, 2, path, ckpt, 1)  # nothing new: nothing more is logged
    assert again.count() == log.count()
    more = write_turns(spark, source, 1)  # the same turns arrive once more and are numbered on
    longer = step_log.log_scored_turns(spark, source, 2, path, ckpt, 1)
    late = [(len(rows) + k) // 2 + 1 for k in range(len(more))]
    assert longer.count() == log.count() + sum(s % 10 == 0 for s in late)


def test_step_log_without_rows(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, score double, step bigint"
    assert step_log.read_step_log(spark, str(tmp_path / "none"), schema).count() == 0


# ---------------------------------------------------------------- splits on repeated keys

@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.55, 0.8, 1.0])
@pytest.mark.parametrize("keys", [["a"] * 40 + ["b"] * 60, ["a"] * 100, list(range(100)), [k % 7 for k in range(100)] + [None] * 9])
def test_split_sizes_are_exact_on_any_multiset(spark, fraction, keys):
    df = spark.createDataFrame([(k if k is None else str(k), i) for i, k in enumerate(keys)], "key string, n int").repartition(6)
    known = sum(k is not None for k in keys)
    train, evaluation = train_eval(df, "key", SplitConfig(fraction=fraction))
    a, b = ([r["n"] for r in x.collect()] for x in (train, evaluation))
    assert len(a) == int(fraction * known) and len(b) == known - len(a) and not set(a) & set(b)
    flags = split_flags(df, "key", SplitConfig(fraction=fraction, mode="independent")).collect()
    assert sum(r["in_train"] for r in flags) == int(fraction * known) and sum(r["in_eval"] for r in flags) == known - int(fraction * known)
    audit = {r["mode"]: r["n_eval"] for r in split_audit(df, "key", fraction).collect()}
    assert audit == {"disjoint": known - int(fraction * known), "independent": known - int(fraction * known)}


def test_split_of_identical_rows(spark):
    train, evaluation = train_eval(spark.createDataFrame([("k",)] * 10, "key string"), "key", SplitConfig(fraction=0.35))
    assert (train.count(), evaluation.count()) == (3, 7)


# ---------------------------------------------------------------- nested sources

def test_nested_source_with_reasons(spark):
    rows = [(1, "s", [("a", "b"), ("c", "d")]), (2, "s", []), (3, "s", None), (4, "s", [(None, "b"), ("c", "d")])]
    df = spark.createDataFrame(rows, "id int, source string, conversation array<struct<input:string,output:string>>")
    out = adapt_queries(df.withColumn("reason", nested_reason()))
    assert out.columns == ["id", "reason", "query"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, "a"), (2, "empty_list", None), (3, "null_list", None), (4, "no_input", None)]


# ---------------------------------------------------------------- subword vocabularies

@pytest.fixture(scope="module")
def vocabulary_file():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def test_subword_prompts_equal_the_library(spark, vocabulary_file):
    tokenizer, own = subword.SubwordTokenizer(spark, vocabulary_file), library(vocabulary_file)
    rows = [(1, "Hello there  é 日本"), (2, ""), (3, None), (4, "x <|endoftext|> y"), (5, "long " * 400)]
    source = spark.createDataFrame(rows, "conv_id bigint, query string")
    cfg = DatasetConfig(max_length=60, sys_prompt=True, sys_prompt_text="Be brief.")
    out = {r["conv_id"]: r for r in subword.build_query_dataset(source, tokenizer, cfg).collect()}
    for i, query in rows:
        if query is None or i == 5:
            assert i not in out
            continue
        ids = own.encode(f"system: Be brief.\n\nuser: {query}\n\n<|endoftext|>", add_special_tokens=False).ids
        assert ids[-1] == 50256
        assert out[i]["input_ids"] == [50256] * (60 - len(ids)) + ids and out[i]["attention_mask"] == [0] * (60 - len(ids)) + [1] * len(ids)
    plain = subword.build_query_dataset(source, tokenizer, DatasetConfig(max_length=60, padding=False), compile_template(CHAT_TEMPLATES["im_marks"]))
    texts = {r["conv_id"]: r["text"] for r in plain.withColumn("text", tokenizer.decode("input_ids")).collect()}
    assert texts[1] == "<|im_start|>user\nHello there  é 日本<|im_end|>\n" and texts[4] == "<|im_start|>user\nx  y<|im_end|>\n"


@pytest.mark.parametrize("padding", ["max_length", "longest", True, False])
def test_subword_padding_modes(spark, vocabulary_file, padding):
    tokenizer = subword.SubwordTokenizer(spark, vocabulary_file)
    source = spark.createDataFrame([(k, "word " * k) for k in range(20)], "conv_id bigint, query string")
    rows = subword.build_query_dataset(source, tokenizer, DatasetConfig(max_length=50, padding=padding), batch_size=6).collect()
    assert len(rows) == 20 and all(len(r["input_ids"]) == len(r["attention_mask"]) and sum(r["attention_mask"]) == r["n_tokens"] for r in rows)
    sizes = Counter(len(r["input_ids"]) for r in rows)
    assert {"max_length": sizes == {50: 20}, "longest": sorted(sizes.values()) == [2, 6, 6, 6], "False": len(sizes) > 15}.get(str(padding), sizes == {50: 20})


def test_subword_padding_errors(spark, vocabulary_file):
    tokenizer = subword.SubwordTokenizer(spark, vocabulary_file)
    source = spark.createDataFrame([(1, "a")], "conv_id bigint, query string")
    for cfg in (DatasetConfig(padding="longest"), DatasetConfig(padding="other")):
        with pytest.raises(ValueError):
            subword.build_query_dataset(source, tokenizer, cfg)
    with pytest.raises(ValueError):
        subword.SubwordTokenizer(spark, vocabulary_file, "<none>")


def test_subword_prefix_equals_the_library(spark, vocabulary_file):
    tokenizer, own = subword.SubwordTokenizer(spark, vocabulary_file), library(vocabulary_file)
    docs = read_table(spark, SF_ORACLE, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = subword.build_prefix_dataset(docs, tokenizer).collect()
    assert len(rows) == sum(len(t or "") > 200 for t in texts.values())
    for r in rows:
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids[:r["k"]]
        assert r["input_ids"] == ids and r["query"] == own.decode(ids, skip_special_tokens=True) and 2 <= r["k"] < 8


def test_subword_encodes_once(spark, vocabulary_file):
    tokenizer = subword.SubwordTokenizer(spark, vocabulary_file)
    source = spark.createDataFrame([(1, "a")], "conv_id bigint, query string")
    plan = subword.build_query_dataset(source, tokenizer, DatasetConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_subword_prefix_takes_one_worker_for_each_task(spark, vocabulary_file):
    tokenizer = subword.SubwordTokenizer(spark, vocabulary_file)
    docs = spark.createDataFrame([(1, "word " * 60), (None, "word " * 60), (2, "short"), (3, None)], "doc_id bigint, text string")
    out = subword.build_prefix_dataset(docs, tokenizer)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "review", "k", "input_ids", "query"] and set(rows) == {1, None}
    assert len(rows[1]["input_ids"]) == rows[1]["k"] and rows[None][2:] == (None, None, None)


def test_subword_encode_holds_few_ids_as_objects(spark, vocabulary_file):
    import tracemalloc

    import pyarrow as pa
    tokenizer, own = subword.SubwordTokenizer(spark, vocabulary_file), library(vocabulary_file)
    texts = [None, "", "x" * 3 + " é 日本 <|endoftext|> "] + ["ab cd ef gh " * 500] * 1500 + [None]  # 9 MB
    column = pa.array(texts)
    calls = {"encode": lambda: tokenizer._encode.func(column), "prefix": lambda: tokenizer._prefix.func(column, pa.array([3] * len(texts)))}
    for name, call in calls.items():
        call()  # the tokenizer is read
        tracemalloc.start()
        out = call()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30 << 20, (name, peak)
        ids = out if name == "encode" else out.field("ids")
        assert len(ids) == len(texts) and ids.null_count == 2
        for i in (1, 2, 3, 1502):
            whole = own.encode(texts[i], add_special_tokens=False).ids
            assert ids[i].as_py() == (whole if name == "encode" else whole[:3])
    assert len(tokenizer._encode.func(column.slice(0, 0))) == 0
