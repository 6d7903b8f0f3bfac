"""Operator 1, approximate nearest neighbours: NN-descent graph and greedy graph search.

Building.  Vectors are dealt to blocks by the signs of a few random projections, once
for each of ``TREES`` drawings; a block that got too many is dealt on by a hash.  The
nearest in a block are a first neighbour list.  Then, in rounds, every vector is sent to
each of its neighbours; those that meet there are neighbours' neighbours of each other,
are compared, and tell each other where that beats their lists.  A vector that very many
have as a neighbour is split into blocks of ``MEET`` of them, anew in each round.  The
rounds end when at most ``STILL`` of the list entries are new.

Search.  ``expands(x)`` are the vectors that have x in their list, so each is found from
any of its neighbours.  A query begins with entry points (an indexed row: its own list),
and expands the nearest ``BEAM`` found so far that it has not expanded, all at once,
until no query has one left.  The best found are scored again in double
precision on the original vectors.

Of equal vectors the one with the least vec_id is indexed, and after the search stands for
all of them: of its members only the ``k`` + 1 with the least vec_id can be among a query's
best.  Queries with equal vectors are searched for once.

In the graph vectors are half-precision, which bounds what is shuffled.  Every distinct
vector is indexed; nothing is sampled.  ``recall`` against brute force is measured in the tests.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers
take no part; nor do those whose length is not the commonest (the smaller, of two); rows
of one vec_id count once, with the least vector; null vec_id takes no part; equal scores
rank by vec_id; fewer candidates than asked for give all found; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import fan_out, load, mix, sorted_runs, written

DEGREE = 32
TREES, LEAF = 8, 384
STILL = 0.001
MEET = 128
BEAM = 256
NODE = "id bigint, vec binary, ids binary, scores binary"
NODE_ARROW = pa.schema([("id", pa.int64()), ("vec", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])
MERGED_ARROW = NODE_ARROW.append(pa.field("fresh", pa.int32()))


def valid_vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, embedding array<double>) of the vectors that take part."""
    rows = table.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = rows.where(finite).where(F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0)).groupBy("id").agg(F.min("embedding").alias("embedding"))


def _half(largest: float):
    """Vectors in half precision, each with a power of two of its own in front (of the
    vector divided by that of the largest component of all), so that no size of numbers is
    lost: a cell is the power's exponent in a byte, then the components."""
    whole = np.frexp(largest)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for v in (x.values.to_numpy() for x in b.column(1)):
                own = int(np.frexp(np.abs(v).max())[1])
                made.append(np.int8(np.clip(own - whole, -126, 127)).tobytes() + np.ldexp(v, -own).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["id", "vec"])
    return run


def _matrix(cells, width: int = 0) -> np.ndarray:
    """The vectors of some cells, or of their bytes one after the other (``width`` each).
    Cells of an even number of bytes are components without an exponent."""
    raw = cells if width else b"".join(cells)
    raw = np.frombuffer(raw, np.uint8).reshape(-1, width or len(raw) // len(cells))
    if raw.shape[1] % 2 == 0:
        return np.ascontiguousarray(raw).view(np.float16).astype(np.float32)
    scale = np.ldexp(np.float32(1), np.ascontiguousarray(raw[:, :1]).view(np.int8).astype(np.int32))
    return np.ascontiguousarray(raw[:, 1:]).view(np.float16).astype(np.float32) * scale


def _projected(trees: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1).to_pylist())
            planes = np.random.default_rng(7).standard_normal((x.shape[1], trees * bits)).astype(np.float32)
            side = (x @ planes > 0).reshape(len(x), trees, bits)
            leaf = (side * (1 << np.arange(bits))).sum(axis=2)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t] + (t << 32), pa.int64()), *b.columns], ["leaf", "id", "vec"])
    return run


def _nodes(ids, vecs, lists, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(lists, pa.binary()), pa.array(scores, pa.binary())], schema=NODE_ARROW)


def _in_leaf(degree: int):
    """Blocks of vectors -> for each its nearest in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["leaf", "part"]):
            ids, vecs = t.column("id").to_numpy(), t.column("vec").to_pylist()
            first = t.column("leaf")[0].as_py() >> 32 == 0
            for i in range(0, len(ids), 4 * LEAF):
                own, x = ids[i:i + 4 * LEAF], _matrix(vecs[i:i + 4 * LEAF])
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                k = min(degree, len(own) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(own), 0), np.int64)
                best = np.take_along_axis(s, top, axis=1)
                yield _nodes(own, vecs[i:i + 4 * LEAF] if first else [None] * len(own), [own[r].tobytes() for r in top], [r.tobytes() for r in best])
    return run


def _merge(degree: int):
    """Rows of a vector -> one row with its best neighbours, equal ones in a mixed order,
    and how many of them the row that has the vector did not list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for t in sorted_runs(batches, ["id"]):
            me = t.column("id")[0].as_py()
            vecs, lists = t.column("vec").to_pylist(), t.column("ids").to_pylist()
            ids = np.frombuffer(b"".join(x for x in lists if x), np.int64)
            scores = np.frombuffer(b"".join(x for x in t.column("scores").to_pylist() if x), np.float32)
            # of two scores of a neighbour, that differ by rounding, the greater: lists only get better
            order = np.lexsort((-scores, ids))
            ids, at = np.unique(ids[order], return_index=True)
            scores = scores[order][at]
            order = np.lexsort((mix((ids ^ me).view(np.uint64)), -scores))
            order = order[ids[order] != me][:degree]
            vec, own = next(((v, x) for v, x in zip(vecs, lists) if v is not None), (None, b""))
            fresh = int((~np.isin(ids[order], np.frombuffer(own, np.int64))).sum())
            rows.append((me, vec, ids[order].tobytes(), scores[order].tobytes(), fresh))
            if len(rows) >= 2000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MERGED_ARROW)], schema=MERGED_ARROW)
    return run


def _merged(rows: DataFrame, degree: int) -> DataFrame:
    n = fan_out(rows.sparkSession)
    return rows.repartition(n, "id").sortWithinPartitions("id").mapInArrow(_merge(degree), NODE + ", fresh int")


MESSAGE = "at bigint, id bigint, vec binary, least float"


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector to itself and to all its neighbours, with the score its list ends with."""
    for b in batches:
        for me, vec, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
            to = np.append(np.frombuffer(ids, np.int64), me)
            least = np.frombuffer(scores, np.float32)
            n = len(to)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array([me] * n, pa.int64()), pa.array([vec] * n, pa.binary()),
                                              pa.array([float(least[-1]) if len(least) >= DEGREE else -np.inf] * n, pa.float32())], ["at", "id", "vec", "least"])


def sent(graph: DataFrame, seed: int = 0) -> DataFrame:
    """Messages with ``part``: of those that meet at a vector, about ``MEET`` a part, dealt by ``seed``."""
    spark = graph.sparkSession
    met = graph.select("ids", "id").mapInArrow(_count, "at bigint").groupBy("at").agg(F.ceil(F.count("*") / MEET).alias("parts"))
    rows = graph.mapInArrow(_send, MESSAGE).join(met, "at", "left")
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.select("at", part.alias("part"), "id", "vec", "least").repartition(fan_out(spark), "at", "part")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], ["at"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those that meet -> what each learns that beats the end of its list."""
    for t in sorted_runs(batches, ["at", "part"]):
        if t.num_rows < 2:
            continue
        ids, least = t.column("id").to_numpy(), t.column("least").to_numpy()
        x = _matrix(t.column("vec").to_pylist())
        for i in range(0, len(ids), 4 * MEET):
            part = slice(i, i + 4 * MEET)
            s = x[part] @ x[part].T
            np.fill_diagonal(s, -np.inf)
            news = s > least[part, None]
            who = np.flatnonzero(news.any(axis=1))
            if len(who):
                yield _nodes(ids[part][who], [None] * len(who), [ids[part][news[r]].tobytes() for r in who], [s[r][news[r]].astype(np.float32).tobytes() for r in who])


def build(vectors: DataFrame, degree: int = DEGREE, trees: int = TREES, still: float = STILL) -> DataFrame:
    """The neighbour graph of (id, embedding): NODE rows, written.  Every entry that is new to a
    list has a better score than the last one there, so that the rounds come to an end."""
    largest = vectors.agg(F.max(F.array_max(F.transform("embedding", F.abs))).alias("x")).first()["x"]
    half = written(vectors.mapInArrow(_half(largest or 1.0), "id bigint, vec binary"), "vectors")
    bits = max(1, int(np.ceil(np.log2(max(2, half.count() / LEAF)))))
    leaves = half.mapInArrow(_projected(trees, bits), "leaf bigint, id bigint, vec binary")
    sizes = leaves.select("leaf").groupBy("leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    blocks = leaves.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("id", "leaf"), "parts").cast("int").alias("part"), "id", "vec")
    blocks = blocks.repartition(fan_out(vectors.sparkSession), "leaf", "part").sortWithinPartitions("leaf", "part")
    graph = written(_merged(blocks.mapInArrow(_in_leaf(degree), NODE), degree), "graph").drop("fresh")
    for seed in count(1):
        news = sent(graph, seed).sortWithinPartitions("at", "part").mapInArrow(_meet, NODE)
        merged = written(_merged(graph.unionByName(news), degree), "graph")
        graph = merged.drop("fresh")
        fresh, entries = merged.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.coalesce(F.sum(F.length("ids")), F.lit(0)) / 8).first()
        if fresh <= still * entries:
            return graph


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, qvec, least, last, found: vectors) -> what a query found by expanding one vector,
    as far as it stands before ``last``, the end of a full beam."""
    for b in batches:
        rows = []
        for me, qvec, least, last, ids, vecs in zip(*(b.column(c).to_pylist() for c in ("id", "qvec", "least", "last", "found_ids", "found_vecs"))):
            s = _matrix(vecs, len(qvec)) @ _matrix(qvec, len(qvec))[0]
            ids = np.frombuffer(ids, np.int64)
            good = ((s > least) | (s == least) & (ids < last)) & (ids != me)
            if good.any():
                rows.append((me, None, ids[good].tobytes(), s[good].astype(np.float32).tobytes()))
        if rows:
            yield _nodes(*zip(*rows))


BEAMS = "id bigint, vec binary, ids binary, scores binary, done binary"


def _advance(beam: int):
    """A query's beam and what it found -> its beam, with what is still to be expanded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for t in sorted_runs(batches, ["id"]):
            vec, done = next((v, d) for v, d in zip(t.column("vec").to_pylist(), t.column("done").to_pylist()) if v is not None)
            ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), np.int64)
            scores = np.frombuffer(b"".join(t.column("scores").to_pylist()), np.float32)
            ids, at = np.unique(ids, return_index=True)
            order = np.lexsort((ids, -scores[at]))[:beam]
            rows.append((t.column("id")[0].as_py(), vec, ids[order].tobytes(), scores[at][order].tobytes(), done))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), [*NODE_ARROW, pa.field("done", pa.binary())])], [*NODE_ARROW.names, "done"])
    return run


FRONT = "id bigint, qvec binary, least float, last bigint, at bigint"
FRONT_NAMES = ["id", "qvec", "least", "last", "at"]


def _open(beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for me, vec, ids, scores, done in zip(*(c.to_pylist() for c in b.columns)):
                ids, scores = np.frombuffer(ids, np.int64), np.frombuffer(scores, np.float32)
                to = np.setdiff1d(ids, np.frombuffer(done, np.int64))
                n = len(to)
                if n:
                    least, last = (float(scores[-1]), int(ids[-1])) if len(scores) >= beam else (-np.inf, 0)
                    yield pa.RecordBatch.from_arrays([pa.array([me] * n, pa.int64()), pa.array([vec] * n, pa.binary()), pa.array([least] * n, pa.float32()),
                                                      pa.array([last] * n, pa.int64()), pa.array(to)], FRONT_NAMES)
    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [np.union1d(np.frombuffer(i, np.int64), np.frombuffer(d, np.int64)).tobytes() for i, d in zip(b.column("ids").to_pylist(), b.column("done").to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(done, pa.binary())], b.schema.names)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in sorted_runs(batches, ["at", "part"]):
        yield pa.RecordBatch.from_arrays([pa.array([t.column("at")[0].as_py()], pa.int64()), pa.array([t.column("id").to_numpy().tobytes()], pa.binary()),
                                          pa.array([b"".join(t.column("vec").to_pylist())], pa.binary())], ["at", "found_ids", "found_vecs"])


def search(graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """Greedy search for queries (id, vec, ids, scores: NODE rows, the ids being entry
    points); returns (id, ids, scores) with the ``beam`` nearest found, nearest first."""
    spark = graph.sparkSession
    n = fan_out(spark)
    expands = sent(graph).sortWithinPartitions("at", "part").mapInArrow(_gather, "at bigint, found_ids binary, found_vecs binary")
    # dealt and sorted once: a hop shuffles only the queries' open places
    expands = expands.repartition(n, "at").sortWithinPartitions("at").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state = written(queries.select(*NODE_ARROW.names, F.lit(b"").alias("done")), "beams")
        while True:
            front = state.mapInArrow(_open(beam), FRONT).repartition(n, "at")
            found = front.join(expands.hint("merge"), "at").mapInArrow(_scored, NODE).withColumn("done", F.lit(None).cast("binary"))
            both = state.mapInArrow(_finish, BEAMS).unionByName(found).repartition(n, "id").sortWithinPartitions("id")
            state = written(both.mapInArrow(_advance(beam), BEAMS), "beams")
            if not state.mapInArrow(_open(beam), FRONT).head(1):
                break
    finally:
        expands.unpersist()
    return state.select("id", "ids", "scores")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for me, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([me] * len(ids), pa.int64()), pa.array(ids)], ["query_id", "vec_id"])


def _product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: what was found, scored in double precision."""
    pairs = found.mapInArrow(_pairs, "query_id bigint, vec_id bigint")
    pairs = pairs.join(vectors.select(F.col("id").alias("vec_id"), F.col("embedding").alias("a")), "vec_id")
    pairs = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("b")), "query_id")
    best = pairs.select("query_id", F.struct((-_product("a", "b")).alias("less"), "vec_id").alias("r")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("r")), 1, k).alias("r"))
    return best.select("query_id", F.posexplode("r").alias("pos", "r")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.less")).alias("score"))


def neighbours(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (id, embedding) that ``is_query`` picks.

    Other classes of equal vectors than a query's own come by rank of score and least id,
    so all that can be among its ``k`` best are in the ``k`` first and its own."""
    classes = written(vectors.groupBy("embedding").agg(F.min("id").alias("id")).select("id", "embedding"), "classes")
    members = written(vectors.join(classes.select(F.col("id").alias("class"), "embedding"), "embedding").select("id", "class"), "members")
    graph = build(classes)
    asked = members.where(is_query)
    wanted = asked.select(F.col("class").alias("id")).distinct()
    others = nearest(search(graph, graph.join(wanted, "id", "left_semi")), classes, classes, k).select("query_id", "vec_id", "score")
    own = classes.join(wanted, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), _product("embedding", "embedding").alias("score"))
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("n") <= k + 1)
    rows = others.unionByName(own).join(first, F.col("vec_id") == F.col("class")).select("query_id", F.struct((-F.col("score")).alias("less"), F.col("id").alias("vec_id")).alias("r"))
    best = rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("r")), 1, k + 1).alias("r"))
    best = asked.join(best, F.col("class") == F.col("query_id")).select("id", F.slice(F.filter("r", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("r"))
    return best.select(F.col("id").alias("query_id"), F.posexplode("r").alias("pos", "r")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.less")).alias("score"))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(valid_vectors(load(spark, sf_dir, "embeddings")), "embeddings")
    return neighbours(vectors, F.col("id") % 20 == 0, 20)
