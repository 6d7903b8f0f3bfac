"""Operators 11 to 13 against brute force, their edge cases, and their queries against SQL."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from given_tables import SF_SMALL
from prefline.llm import gram_scan, queries, scalar_tables, survival_words
from prefline.plans.compare import compare, duckdb_connection


@pytest.mark.parametrize("name", ["op3_chat_format", "op11_gram_scan", "op12_survival_words", "op13_scalar_tables"])
def test_query_equals_its_sql(spark, name):
    r = compare(queries.QUERIES[name](spark, SF_SMALL), duckdb_connection(SF_SMALL), queries.SQL[name])
    assert r["match"], r


# ---------------------------------------------------------------- 11

GRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def gram_words(text):
    return GRAM_WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items):
    own = gram_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = gram_words(item)
        size = min(len(w), 10)
        if not size:
            continue
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(own) - size + 1):
            if tuple(own[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item_id)
    return own, hit, found


def gram_case():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Cc", "é", "42", "x_y", "ÉL"])
    items = [(1, " ".join(word() for _ in range(14))), (2, " ".join(word() for _ in range(25))), (3, "One, two three"), (30, "zwei"),
             (5, None), (6, " ,;. "), (None, "no id here"), (2, "second row of two"), (7, " ".join("same" for _ in range(12)))]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += [f"before {items[1][1].upper()} after", "x ONE - two\n\nthree y zwei", None, "", " \n.,", "no ID here", "same " * 40, "same " * 9, "second row of TWO", "zwei"]
    return items, texts


@pytest.mark.parametrize("limit", [gram_scan.BROADCAST_GRAMS, 0])
def test_gram_scan_equals_brute_force(spark, limit):
    items, texts = gram_case()
    rows = list(enumerate(texts)) + [(None, texts[41]), (None, texts[41]), (7, texts[7]), (7, "another text, one two three")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, hash string, size int").repartition(3)
    known = gram_scan.GramSet(spark.createDataFrame(items, "item_id bigint, text string"), limit=limit)
    assert known.small == (limit > 0)
    found = gram_scan.scan(docs, known)
    got = {(r["doc_id"], r["k1"]): (r["copies"], r["n_words"], {k for s in r["spans"] for k in range(s["start"] - 1, s["start"] - 1 + s["size"])}, r["n"])
           for r in found.select("*", gram_scan.covered(F.col("spans")).alias("n")).collect()}
    keys = {(r["doc_id"], r["text"]): r["k1"] for r in docs.select("doc_id", "text", *gram_scan.row_key(F.col("text"))).collect()}
    listed = {(r["doc_id"], r["k1"]): r["items"] for r in gram_scan.items_found(found, known).collect()}
    for i, t in rows:
        own, hit, ids = brute_hits(t, items)
        copies, n, places, covered = got[(i, keys[(i, t)])]
        assert (copies, n, places, covered) == (rows.count((i, t)), len(own), hit, len(hit))
        assert listed.get((i, keys[(i, t)]), []) == sorted(str(x) for x in ids if x is not None)


def test_decontaminate(spark):
    items, texts = gram_case()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, k1 int")
    cut = {r["doc_id"]: r for r in gram_scan.decontaminate(docs, bench).collect()}
    left = {r["doc_id"] for r in gram_scan.decontaminate(docs, bench, "documents").collect()}
    for i, t in enumerate(texts):
        own, hit, _ = brute_hits(t, items)
        assert (i in left) == (not hit)
        assert (cut[i]["spans"], cut[i]["k1"]) == ("k", 1)
        if not hit:
            assert cut[i]["text"] == t
        else:
            assert gram_words(cut[i]["text"]) == [w for k, w in enumerate(own) if k not in hit]
    assert cut[41]["text"] == "x y"
    with pytest.raises(ValueError):
        gram_scan.decontaminate(docs, bench, "lines")


def test_gram_scan_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert gram_scan.scan(docs, gram_scan.GramSet(bench)).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    assert [(r["n_words"], r["spans"]) for r in gram_scan.scan(one, gram_scan.GramSet(bench)).collect()] == [(2, [])]
    assert gram_scan.decontaminate(one, bench).collect()[0]["text"] == "some words"


def test_gram_scan_stays_in_the_jvm(spark):
    plan = queries.QUERIES["op11_gram_scan"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- 12

def brute_fails(rows):
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append([len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)),
                    doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows)])
    return out


def brute_audit(rows, labels):
    fails, good, toxic = brute_fails(rows), {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out = {}
    parts = {p or "" for _, _, p in rows}
    for part in parts:
        own = [(f, i in good and i is not None, i in toxic and i is not None) for f, (i, _, p) in zip(fails, rows) if (p or "") == part]
        shapley = [0] * 5
        for order in permutations(range(5)):
            for step, x in enumerate(order):
                early = [any(f[y] for y in order[:step]) for f, _, _ in own]
                removed = [f[x] and not e for (f, _, _), e in zip(own, early)]
                shapley[x] += sum(removed)
                out[part, "".join("ABCDE"[y] for y in order), step + 1] = [
                    sum(not e and not f[x] for (f, _, _), e in zip(own, early)), sum(removed), sum(f[x] and e for (f, _, _), e in zip(own, early)),
                    sum(f[x] and sum(f) == 1 for f, _, _ in own), sum(r and g for r, (_, g, _) in zip(removed, own)), sum(r and t for r, (_, _, t) in zip(removed, own)), x]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_survival_audit_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "  \n", "A# b", "ÄÖ é", " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k % 100}" for k in range(150)), "SHOUT " * 120, " ".join(f"W{k}" for k in range(120)) + " 5 %"]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)] + [(99, "x" * 200_000, "fr")]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, p, "c") for i, t, p in rows], "doc_id bigint, text string, lang string, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in survival_words.audit(survival_words.survivors(docs, marks)).collect()}
    assert got == brute_audit(rows, labels)


def test_survival_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert survival_words.audit(survival_words.survivors(docs, marks)).count() == 0


def test_survival_labels_do_not_go_through_the_driver(spark, tmp_path):
    spark.range(6000).selectExpr("id doc_id", "int(id % 3) quality", "int(id % 2) toxic").write.parquet(str(tmp_path / "labels"))
    marks = spark.read.parquet(str(tmp_path / "labels"))  # a few kB, 64,000 rows with their salts
    rows = spark.range(0, 12000, 2).selectExpr("id doc_id", "string(id % 5) part", "int(id % 7) fails")
    got = survival_words.with_labels(rows, marks)
    counts = {r["label"]: r["n"] for r in got.groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert counts == {0: 5000, 1: 1000}  # even ids: never toxic, a third of those below 6000 good
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_survival_audit_broadcasts_frequent_texts_only(spark):
    docs = spark.range(9000).selectExpr("id doc_id", "if(id < 100, 'the same', concat('text ', id div 2)) text", "'en' lang")
    fails = survival_words.failures(docs)
    repeats = fails.where("fails >= 16")
    assert repeats.count() == 99 + 8900 // 2
    fails.collect()
    plan = fails._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"\bBroadcastHashJoin\b", plan)) == 2 and len(re.findall(r"\bSortMergeJoin\b", plan)) == 1


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 1000, 4099):
        words = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        assert survival_words.positional_popcount(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def test_very_many_parts_are_handed_on():
    import pyarrow as pa

    n = survival_words.HELD_PARTS + 100
    one = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(n)]), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32())], ["part", "label", "fails"])
    out = list(survival_words._count(iter([one, one])))
    assert len(out) > 1 and sum(b.num_rows for b in out) == 2 * n
    assert sum(sum(x[0] for x in b.column("survivors").to_pylist()) for b in out) == 2 * n


# ---------------------------------------------------------------- 13

def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cents = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(cents)):
            own = [q for (_, q), c in zip(kept, of) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *reversed(near(q))) for i, q in kept], cents


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_clusters_equal_brute_force(spark, scale):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 1) * scale)) for _ in range(64)]) for i in range(150)]
    rows += [(k, list(rows[3][1])) for k in range(200, 230)] + [(rows[0][0], list(rows[0][1])), (None, list(rows[1][1]))]
    rows += [(300, None), (301, [0.5] * 63), (302, [0.5] * 63 + [None]), (303, [float("nan")] * 64), (304, [float("inf")] + [0.0] * 63), (305, [-0.0] * 64)]
    table = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id bigint, embedding array<float>, cluster string").repartition(5)
    got, cents = scalar_tables.cluster(table)
    want, want_cents = brute_clusters(rows, 16, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert cents.tolist() == want_cents


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    got, cents = scalar_tables.cluster(spark.createDataFrame([], schema))
    assert got.count() == 0 and len(cents) == 0
    got, cents = scalar_tables.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [-0.01] * 64), (3, [1e30] * 64)], schema))
    assert sorted((r["vec_id"], r["distance"]) for r in got.collect()) == [(1, 0), (2, 0)]
    assert sorted(c[0] for c in cents.tolist()) == [-1, 32]


def test_cluster_query_of_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES["op13_scalar_tables"](spark, str(tmp_path)).count() == 0
