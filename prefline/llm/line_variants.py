"""Operator 7, line dedup by a deletion-neighbourhood join.

A line goes if an earlier line, by document and place, is equal or is one edit away: a
character inserted, left out or replaced.  Equal lines are first grouped into classes.
For nearly equal ones every class emits a hashed key for the line itself and for each
line with one character left out.  Two lines that share a key by leaving out the same
place differ there only; a line that is another's key as it stands lacks one of its
characters.  So the earliest line of a key and place, and of a key, is all that its
other lines need to know: no pairs.  The edit distance to that earliest line is then
verified on the texts.

One edit leaves one half of a line as it was.  Hence only classes that share a hashed
half with another class emit keys; all others have no line within the bound.

Defined results: lines end at a newline; blank lines stay and are compared with none;
lines of fewer than ``NEAR_CHARS`` code points go for equal lines only; documents are
ordered by doc_id (null first), then by a hash of the text; repeated rows of one id
and text are one document; null text stays null; a document may end up empty and stays;
other columns pass through; an empty table gives an empty result.  Whether the earlier
line itself goes makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Rolling, fan_out, in_turn, load, mix, written

NEAR_CHARS = 24
KEYS = 1 << 16
_HASH = Rolling(0xE7037ED1A0B428DB)
ORDER = ["doc_id", "key", "line_no"]
VARIANTS = "v bigint, place int, doc_id bigint, key bigint, line_no int, line string"


def _emitted(places: list[tuple], lines: list[str]) -> pa.RecordBatch:
    """The keys of some lines (``places``: doc_id, key, line_no of each) in one batch."""
    n = np.array([len(x) for x in lines])
    points = mix(np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    prefix, down = _HASH.prefix(points), _HASH._powers(len(points) + 1)[1]
    end, own = np.cumsum(n), np.repeat(np.arange(len(n)), n)
    first = end - n
    whole = (prefix[end] - prefix[first]) * down[first]
    at = np.arange(len(points))
    less = (prefix[at] - prefix[first[own]]) * down[first[own]] + (prefix[end[own]] - prefix[at + 1]) * down[first[own] + 1]
    # each line's own key, then those without one of its characters
    head = first + np.arange(len(n))
    body = np.ones(len(points) + len(n), bool)
    body[head] = False
    v = np.empty(len(body), np.uint64)
    v[head], v[body] = mix(whole + n.astype(np.uint64)), mix(less + (n[own] - 1).astype(np.uint64))
    place = np.full(len(body), -1, np.int32)
    place[body] = at - first[own]
    doc_ids, keys, numbers = zip(*places)
    of = pa.array(np.repeat(np.arange(len(n)), n + 1), pa.int32())
    text = pa.array(np.where(body, -1, np.repeat(np.arange(len(n)), n + 1)), pa.int32(), mask=body)
    return pa.RecordBatch.from_arrays([
        pa.array(v.view(np.int64)), pa.array(place), pa.array(doc_ids, pa.int64()).take(of), pa.array(keys, pa.int64()).take(of),
        pa.array(numbers, pa.int32()).take(of), pa.array(lines, pa.string()).take(text)], [c.split()[0] for c in VARIANTS.split(", ")])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text, line_nos) -> keys of those lines; place -1: the line itself,
    which alone carries its text.  A batch holds about ``KEYS`` keys, or those of one
    longer line."""
    places, held, size = [], [], 0
    for b in batches:
        for doc_id, key, text, line_nos in zip(*b.columns):
            lines, doc_id, key = text.as_py().split("\n"), doc_id.as_py(), key.as_py()
            for k in line_nos.as_py():
                if held and size + len(lines[k]) > KEYS:
                    yield _emitted(places, held)
                    places, held, size = [], [], 0
                places.append((doc_id, key, k))
                held.append(lines[k])
                size += len(lines[k])
    if held:
        yield _emitted(places, held)


def _keep(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, removed = [], [], []
            for text, kept in zip(b.column("__text").to_pylist(), b.column("kept").to_pylist()):
                lines, kept = (text or "").split("\n"), set(kept or ())
                stay = [x for k, x in enumerate(lines) if k in kept or not x.strip(" \t\r\x0b\x0c")]
                total.append(len(lines) if text else 0)
                removed.append(len(lines) - len(stay))
                texts.append(None if text is None else "\n".join(stay))
            named = {n: c for n, c in zip(b.schema.names[:columns], b.columns)}
            named["__text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*named.values(), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*named, "n_lines", "n_removed"])
    return run


def halves(line: Column, n: Column) -> list[Column]:
    """Hashed halves of a line, as the longer or the shorter one of a pair."""
    out = []
    for longer in (n, n + 1):
        h = F.floor(longer / 2).cast("int")
        out += [F.xxhash64(F.lit(0), longer, F.left(line, h)), F.xxhash64(F.lit(1), longer, F.right(line, longer - h))]
    return out


def remove_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """All columns of ``docs``, the text without the lines that go, n_lines, n_removed."""
    columns, own = docs.columns, [f"__{i}" if c != "text" else "__text" for i, c in enumerate(docs.columns)]
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")))
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(r"line rlike '[^ \\t\\r\\x0B\\f]'")
    n = F.length("line")
    classes = lines.select(*ORDER, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.when(n >= near_chars, F.array(*halves(F.col("line"), n))).alias("halves"))
    # the first line of each class; a line that is everywhere is reduced where it is read
    classes = written(classes.groupBy("h1", "h2").agg(F.min(F.struct(*ORDER)).alias("first"), F.any_value("halves").alias("halves")), "line-classes")
    n_parts = fan_out(docs.sparkSession)
    half = classes.select("h1", F.explode("halves").alias("half")).repartition(n_parts, "half")
    shared = half.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half")
    sharing = half.join(shared.hint("merge"), "half", "left_semi").select("h1").distinct()
    candidates = classes.select("h1", "first").join(sharing, "h1", "left_semi").select("first.*")
    per_doc = candidates.groupBy("key", F.col("doc_id").alias("of")).agg(F.collect_list("line_no").alias("line_nos"))
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(columns, own)], F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"))
    near = rows.join(per_doc.hint("shuffle_merge"), "key").where(F.col("of").eqNullSafe(F.col("doc_id")))
    # equal rows are one document; their variants are equal too
    near = written(near.select("doc_id", "key", "__text", "line_nos").mapInArrow(in_turn(__name__, _variants), VARIANTS), "line-variants")
    place = F.struct(*ORDER)
    # most variants are of one line: they go before places are compared
    thin = near.select("v", "place", *ORDER).repartition(n_parts, "v")
    often = thin.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    variants = written(thin.join(often.hint("merge"), "v", "left_semi").select("v", "place", place.alias("at")), "shared-variants")
    of_place = variants.groupBy("v", "place").agg(F.min("at").alias("first_there"))
    of_key = variants.groupBy("v").agg(F.min("at").alias("first_any"), F.min(F.when(F.col("place") < 0, F.col("at"))).alias("first_whole"))
    known = variants.join(of_key, "v").join(of_place, ["v", "place"])
    earliest = F.least("first_there", "first_whole", F.when(F.col("place") < 0, F.col("first_any")))
    known = known.select("at", earliest.alias("earlier")).where("earlier < at").groupBy("at").agg(F.min("earlier").alias("earlier"))
    texts = near.where("place < 0").select(place.alias("whose"), "line")
    pairs = known.join(texts.withColumnRenamed("line", "a"), F.col("at") == F.col("whose")).drop("whose")
    pairs = pairs.join(texts.withColumnRenamed("line", "b"), F.col("earlier") == F.col("whose"))
    gone = pairs.where(F.levenshtein("a", "b", 1) >= 0).select(F.col("at.key").alias("key"), F.col("at.line_no").alias("line_no"))
    kept = classes.select("first.key", "first.line_no").join(gone.distinct(), ["key", "line_no"], "left_anti")
    kept = kept.groupBy("key").agg(F.collect_list("line_no").alias("kept"))
    joined = rows.join(kept.hint("shuffle_merge"), "key", "left").select(*own, "kept")
    schema = StructType([StructField(o, f.dataType) for o, f in zip(own, docs.schema.fields)] + [StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    out = joined.mapInArrow(in_turn(__name__, _keep(len(own))), schema)
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, columns)], "n_lines", "n_removed")


def op7_line_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
