"""Brute-force, round-trip and edge-case checks of the training-data operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from prefline.llm import bpe_chunks, bucket_digest, chat_format, cover_anchors, line_variants, nn_descent, repair_shards, set_sketch, string_kernel, tier_packing
from prefline.llm.components import components
from prefline.llm.piece_cache import encoder

ODD = ["", None, "a", " \n\t ", "é日本😀 ", "x" * 5000, "word " * 300, "same text here and there", "same text here and there", "it's 'll don't  \n\n x"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def long_texts(seed, n=60):
    """Random texts, copies, texts with a few words changed and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    out = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(n)]
    for k in range(n):
        base = out[k].split()
        if k % 3 == 0:
            for _ in range(k % 5):
                base[rng.randrange(len(base))] = word()
            out.append(" ".join(base))
        if k % 7 == 0:
            at = rng.randrange(len(base))
            out.append(out[(k + 1) % n] + " " + " ".join(base[at:at + 50]))
    return out + ODD


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["### ", "</turn>\n", "\\0", "\\", ":", ": ", "assistant", "#", "<", "é", "\n", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(8))) for c in (1, 2, None) for t in range(600 if c == 1 else 5)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, block string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.render(df)).collect()}
    for c in (1, 2, None):
        own = [(r or "", t or "") for x, _, r, t in rows if x == c]
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in own))
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    blocks = chat_format.render(df.where("conv_id = 2"))
    whole = blocks.first().rendered
    for r in chat_format.materialise(blocks, chat_format.expand(blocks)).collect():
        assert whole.startswith(r.context + r.reply + chat_format.TAIL) and r.context.endswith("### assistant: ")
    assert chat_format.digests(chat_format.render(df.limit(0))).count() == 0


def test_bpe_chunks(make):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "  ", " ", "\n", "é", "'s", "'", "don't", "!!", "12", "x" * rng.randint(1, 90), "日本", "😀"]) for _ in range(300)) for _ in range(40)] + ["a" * 3000, " " * 999]
    got = {r.doc_id: r for r in bpe_chunks.decode(bpe_chunks.encode(make(texts), *args, chunk=64, overlap=16), *args).collect()}
    own = bpe_chunks._tables(*args)[0]
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == own.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()


def test_cached_encoder_equals_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = [chr(c) for c in range(9, 0x250)] + ["  ", "'s", "'ll", "'", "'re", "\n", " "] * 30 + list("Σİ日😀")
    texts = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(300)] + ["<|endoftext|> x", "", "'", "x'r"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(P.path(name))
        library.encode_special_tokens = True
        for text, ids in zip(texts, encoder(P.path(name)).arrays(texts, 9)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [9]


def test_bucket_digest(make):
    texts = long_texts(4, 30)
    got = {r.doc_id: r for r in bucket_digest.compare_edited(make(texts)).collect()}
    plain = {r.doc_id: r.fingerprint for r in bucket_digest.fingerprints(make(texts)).collect()}
    texts = [t or "" for t in texts]
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        changed = bucket_digest.edited(t, after)
        codes = bucket_digest.digests([t, changed, after])
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(changed))
        assert [got[i].fingerprint, got[i].edited_fingerprint] == bucket_digest.encode(codes[:2]) and plain[i] == got[i].fingerprint
        assert got[i].near_next == pytest.approx(bucket_digest.likeness(codes[:1], codes[2:])[0])
        assert (bucket_digest.decode([plain[i]]) == codes[0]).all()
    assert bucket_digest.compare_edited(make([])).count() == 0
    assert bucket_digest.compare_edited(make(["one"])).first().near_next == 1


def test_tier_packing(make):
    texts = long_texts(5, 40)
    own = encoder(P.path("word_bpe_49k.json"))
    out = tier_packing.pack(make(texts), P.path("word_bpe_49k.json"), 2, context=512, pool_tokens=3000).toPandas()
    for i, g in out.sort_values("start").groupby("doc_id"):
        assert b"".join(g.ids) == own.arrays([texts[i] or ""], 2)[0].astype("<u4").tobytes()
    assert out.doc_id.nunique() == len(texts)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        sizes = [len(x) // 4 for x in g.ids]
        assert g.offset.tolist() == np.cumsum([0, *sizes[:-1]]).tolist()
        total = sum(sizes)
        assert total & (total - 1) == 0 and total <= 512
    assert tier_packing.packed_pieces(make([])).count() == 0


def test_token_files(make):
    texts = long_texts(6, 30)
    path = P.path("byte_bpe_50k.json")
    files = repair_shards.write_files(make(texts), path, 0, shard_ids=500)
    got = repair_shards.read_files(files).orderBy("start").collect()
    expected = encoder(path).arrays([t or "" for t in texts], 0)
    assert [r.doc_id for r in got] == list(range(len(texts)))
    assert [zlib.crc32(bytes(r.ids)) for r in got] == [zlib.crc32(x.astype("<u4").tobytes()) for x in expected]
    assert [r.start for r in got] == np.cumsum([0, *map(len, expected[:-1])]).tolist()
    assert repair_shards.read_files(repair_shards.write_files(make([]), path, 0)).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 90, rng.integers(1, 60))
        ids = rng.integers(0, rng.integers(1, 6), sizes.sum()).astype(np.uint32)
        file = repair_shards.TokenFile(repair_shards.to_file(ids, sizes))
        i = int(rng.integers(len(sizes)))
        own = ids[sizes[:i].sum():][:sizes[i]]
        a = int(rng.integers(sizes[i]))
        n = int(rng.integers(1, sizes[i] - a + 1))
        assert (file.whole() == ids).all() and (file.document(i) == own).all() and (file.read(i, a, n) == own[a:a + n]).all()


def test_substring_dedup(make):
    texts = long_texts(7)
    got = {r.doc_id: r for r in cover_anchors.remove_repeats(make(texts)).collect()}
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k:k + 35])] = seen.get(tuple(w[k:k + 35]), 0) + 1
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept, got[i].key, got[i].text) == (len(w), sum(gone), kept, "x", texts[i])
    assert cover_anchors.remove_repeats(make([])).count() == 0


def test_cover_brings_any_two_places_together():
    n = cover_anchors.PERIOD
    assert all(any((a + s) % n in cover_anchors.COVER and (b + s) % n in cover_anchors.COVER for s in range(n)) for a in range(n) for b in range(n))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def test_line_dedup(make):
    rng = random.Random(8)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 40))) for _ in range(60)]
    for k in range(60):
        x = list(lines[k])
        for _ in range(k % 3):
            x[rng.randrange(len(x))] = rng.choice("abc")
        lines.append("".join(x[:-1] if k % 5 == 0 else x))
    lines += ["", " ", "short", "shorx", "aab" + "c" * 30, "ab" + "c" * 30, "é" + "c" * 30, "c" * 30]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r for r in line_variants.remove_lines(make(texts)).collect()}
    seen = []
    # documents in order; equal rows of one id do not occur here
    for i, t in enumerate(texts):
        kept = []
        for x in (t or "").split("\n"):
            if x.strip():
                gone = any(x == y or min(len(x), len(y)) >= line_variants.NEAR_CHARS and one_edit(x, y) for y in seen)
                seen.append(x)
                if gone:
                    continue
            kept.append(x)
        assert got[i].text == (None if t is None else "\n".join(kept)), i
    assert line_variants.remove_lines(make([])).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(make, percent):
    texts = long_texts(9)
    got = {r.doc_id: r for r in set_sketch.link(make(texts), percent).collect()}
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root[i], root[i] == i)
    assert set_sketch.link(make([])).count() == 0


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(x, x) == r for x, r in root.items())


def test_toxicity_finds_altered_words(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeou") for _ in range(rng.randint(1, 4)))
    sentence = lambda: [word() for _ in range(rng.randint(5, 30))]
    rows, labels = [], []
    for i in range(600):
        w = sentence()
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["wixxing", "qualvyx"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    probes = ["w.i.x.x.i.n.g", "wixx-ing", "qu4lvyx", "quaalvyx", "w i x x i n g"]
    rows += [(1000 + k, " ".join([*sentence(), p, *sentence()])) for k, p in enumerate(probes)]
    rows += [(2000, None), (2001, ""), (None, "plain words"), (2002, "z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = string_kernel.train(docs, marks.where(~string_kernel.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in string_kernel.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.97
    assert all(got[1000 + k] >= 0.5 for k in range(len(probes))), [got[1000 + k] for k in range(len(probes))]
    assert all(got[i] < 0.5 for i in (2000, 2001, 2002, None))
    assert string_kernel.train(docs, marks.limit(0)) is None
    assert string_kernel.score(docs, None).agg(F.max("score")).first()[0] == 0.0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((800, 16)).astype(np.float32)
    x[300:400] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (None, [1.0] * 16), (7, x[7].tolist()), (2005, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = nn_descent.valid_vectors(table)
    assert vectors.count() == 800
    graph = nn_descent.build(vectors)
    found = nn_descent.nearest(nn_descent.search(graph, graph.where("id % 20 = 0")), vectors, vectors.where("id % 20 = 0"), 20).toPandas()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    hits = 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in g.vec_id.tolist()
        assert np.allclose(exact[q, g.vec_id], g.score, atol=1e-12) and (np.diff(g.score) <= 0).all()
        hits += (g.score >= np.sort(exact[q])[-20] - 1e-9).sum()
    assert found.query_id.nunique() == 40 and hits / 800 >= 0.9
    few = vectors.where("id < 3")
    tiny = nn_descent.build(few)
    assert nn_descent.nearest(nn_descent.search(tiny, tiny), few, few, 20).count() == 6


def chain(spark, n):
    """Vectors of one number, each with the next and the last one as neighbours."""
    half = lambda x: np.asarray([x], np.float16).tobytes()
    rows = []
    for i in range(n):
        ids = [j for j in (i + 1, i - 1) if 0 <= j < n]
        rows.append((i, half(i / 64), np.array(ids, np.int64).tobytes(), np.array([i * j / 4096 for j in ids], np.float32).tobytes()))
    return spark.createDataFrame(rows, nn_descent.NODE), half


def test_search_goes_on_until_no_place_is_open(spark):
    graph, half = chain(spark, 9)
    query = spark.createDataFrame([(100, half(1), np.array([0], np.int64).tobytes(), np.zeros(1, np.float32).tobytes())], nn_descent.NODE)
    found = nn_descent.search(graph, query, beam=2).first()
    assert np.frombuffer(found.ids, np.int64).tolist() == [8, 7]


def test_graph_rounds_end_when_lists_stand_still(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2000, 24)).astype(np.float16).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    least = np.sort(s, axis=1)[:, -nn_descent.DEGREE]
    found = nn_descent.build(vectors, trees=2).toPandas()
    assert np.mean([(s[i, np.frombuffer(ids, np.int64)] >= least[i] - 1e-3).sum() / nn_descent.DEGREE for i, ids in zip(found.id, found.ids)]) > 0.97


def test_hub_parts_are_dealt_anew_in_each_round(spark):
    ids = np.array([0], np.int64).tobytes()
    graph = spark.createDataFrame([(i, b"\0\0", ids if i else b"", b"\0" * 4 if i else b"") for i in range(600)], nn_descent.NODE)
    parts = [{r.id: r.part for r in nn_descent.sent(graph, seed).where("at = 0").collect()} for seed in (1, 2)]
    assert len(set(parts[0].values())) > 1 and parts[0] != parts[1]


def test_nearest_of_many_copies_are_the_least_ids(spark):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((1300, 16)).astype(np.float32)
    x[rng.permutation(1300)[:700]] = x[5] = x[5] / np.linalg.norm(x[5]) * 9
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    found = nn_descent.neighbours(vectors, F.col("id") % 20 == 0, 20).toPandas()
    copies = np.flatnonzero((x == x[5]).all(axis=1))
    queries = [q for q in copies if q % 20 == 0]
    assert len(queries) > 20 and found.query_id.nunique() == 65
    for q in queries:
        assert found[found.query_id == q].sort_values("rank").vec_id.tolist() == [c for c in copies if c != q][:20]
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    for q, g in found.groupby("query_id"):
        others = [i for i in np.lexsort((np.arange(1300), -exact[q].round(9))) if i != q][:20]
        assert g.sort_values("rank").vec_id.tolist() == others


def test_places_of_equal_score_go_to_the_least_ids(spark):
    graph, half = chain(spark, 9)
    graph = graph.withColumn("vec", F.lit(half(1))).withColumn("scores", F.expr("repeat('x', 0)").cast("binary"))
    query = spark.createDataFrame([(100, half(1), np.array([8], np.int64).tobytes(), np.ones(1, np.float32).tobytes())], nn_descent.NODE)
    assert np.frombuffer(nn_descent.search(graph, query, beam=2).first().ids, np.int64).tolist() == [0, 1]


def test_more_new_words_than_the_cache_holds(monkeypatch):
    """Texts with more different pre-tokens than the cache has entries, in one call."""
    from prefline.llm import piece_cache
    from tokenizers import Tokenizer

    monkeypatch.setattr(piece_cache, "CACHE_ENTRIES", 500)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (3000, 0, 40, 1200)] + ["日本 " + word(), "a\0b", "x"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = P.path(name)
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        own = piece_cache.CachedEncoder(path)
        for _ in range(2):
            assert [x.tolist() for x in own.arrays(texts, 7)] == [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_line_variants_are_the_lines_without_one_character():
    """Keys of many lines in one batch: equal keys at equal places for equal rests."""
    lines = ["abcdefgh", "abcdxfgh", "abcdfgh", "", "é日本", "é日x本"]
    b = line_variants._emitted([(k, 10 * k, k) for k in range(len(lines))], lines)
    rows = list(zip(*(c.to_pylist() for c in b.columns)))
    assert b.num_rows == sum(map(len, lines)) + len(lines)
    spelt = {}
    for v, place, doc_id, key, line_no, line in rows:
        assert key == 10 * doc_id == 10 * line_no and line == (lines[doc_id] if place < 0 else None)
        rest = lines[doc_id] if place < 0 else lines[doc_id][:place] + lines[doc_id][place + 1:]
        assert spelt.setdefault(v, rest) == rest
    assert len(spelt) == len(set(spelt.values()))


def test_line_variants_in_small_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(line_variants, "KEYS", 10)
    text = "one line here\nanother line\nthird"
    b = pa.RecordBatch.from_arrays([pa.array([1, None], pa.int64()), pa.array([5, 6], pa.int64()), pa.array([text, text]), pa.array([[0, 2], [1]], pa.list_(pa.int32()))], ["doc_id", "key", "text", "line_nos"])
    out = [r for x in line_variants._variants(iter([b])) for r in zip(*(c.to_pylist() for c in x.columns))]
    assert [(d, k, n, line) for _, p, d, k, n, line in out if p < 0] == [(1, 5, 0, "one line here"), (1, 5, 2, "third"), (None, 6, 1, "another line")]


def test_substring_dedup_of_many_copies_without_ids(make):
    """Copies under a null id share one entry of ranges; the time does not grow with their square."""
    text = " ".join(f"w{k}" for k in range(60))
    out = cover_anchors.remove_repeats(make([text] * 3000 + ["a b c"], [None] * 3000 + [1])).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted((r["n_words"], r["n_removed"], r["count"]) for r in out) == [(3, 0, 1), (60, 60, 3000)]


def test_near_duplicates_of_groups_larger_than_a_block(make, monkeypatch):
    """Chains, stars and loners in groups of many blocks: no link between blocks is lost."""
    monkeypatch.setattr(set_sketch, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):  # a chain: each changes a word of the one before it, far ends differ
        base = list(base)
        base[rng.randrange(120)] = f"c{k}"
        texts.append(" ".join(base))
    star = [f"s{k}" for k in range(100)]
    texts += [" ".join(star[:k] + [f"t{k}"] + star[k + 1:]) for k in range(60)]
    texts += [" ".join(star[:50] + [f"u{k}{m}" for m in range(50)]) for k in range(20)]
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in set_sketch.link(make(texts), 80).collect()}
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))


def test_bands_follow_the_threshold():
    assert [set_sketch.bands_for(x) for x in (0.85, 0.8)] == [20, 29]
    assert set_sketch.bands_for(0.7) > 29


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e5, 1e30])
def test_nearest_neighbours_at_any_scale(spark, scale):
    """Half precision must not lose small or large numbers, nor vectors of unlike sizes."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)) * scale
    x[::7] *= 1e-6
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    got = {}
    for r in nn_descent.neighbours(table, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: set(np.argsort(-np.where(np.arange(600) == q, -np.inf, x @ x[q]), kind="stable")[:20].tolist()) for q in range(0, 600, 20)}
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.95
