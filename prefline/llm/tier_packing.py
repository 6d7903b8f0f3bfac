"""Operator 5, hierarchical multi-length packing.

Sequences come in tiers of 4096, 2048, ... tokens.  A document is cut into full 4096
windows; what is left goes to the smallest tier that holds it and opens a window there.
From the longest tier down, gaps are filled with whole documents of shorter tiers, the
largest that fits first, and the last of a gap with a part cut from one.  So every
sequence is exactly as long as its tier: there is no padding.  A pool's unfinished last
window goes into the next pool; at a partition's end its ids are cut into powers of two.

Sequences are dealt to step groups, tier by tier to and fro, so that groups hold about
the same tokens and the same mix of lengths.

Every task packs the documents it reads, a bounded pool at a time: no shuffle, and a
lost task gives the same sequences again.

Defined results: null text: only the end id; null doc_id and repeated rows are packed
as they stand, each for itself; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import PIECE_BYTES, in_turn, load
from .piece_cache import encoder, in_pieces

CONTEXT = 4096
SMALLEST_TIER = 256
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16

PIECE_SCHEMA = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


class Part:
    """Ids ``start`` to ``end`` of one document."""

    __slots__ = ("doc", "start", "end")

    def __init__(self, doc, start, end):
        self.doc, self.start, self.end = doc, start, end

    def __len__(self):
        return self.end - self.start

    def split(self, n):
        return Part(self.doc, self.start, self.start + n), Part(self.doc, self.start + n, self.end)


def tier_of(n: int, context: int = CONTEXT) -> int:
    return min(context, max(SMALLEST_TIER, 1 << (n - 1).bit_length()))


class Shelf:
    """Parts by length: the largest not over a length, or any part, in O(log n)."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.parts: dict[tuple[int, int], Part] = {}
        self.count = 0

    def put(self, part: Part):
        key = (len(part), self.count)
        self.count += 1
        insort(self.keys, key)
        self.parts[key] = part

    def take(self, at: int) -> Part:
        return self.parts.pop(self.keys.pop(at))

    def fitting(self, n: int) -> Part | None:
        at = bisect_right(self.keys, (n, self.count)) - 1
        return self.take(at) if at >= 0 else None


def pack_pool(parts: list[Part], context: int = CONTEXT) -> tuple[list[list[Part]], list[Part]]:
    """Full sequences made of the parts, and the parts left over (less than a window)."""
    full, shelf = [], Shelf()
    for part in parts:
        while len(part) >= context:
            head, part = part.split(context)
            full.append([head])
        if len(part):
            shelf.put(part)
    rest = sum(k[0] for k in shelf.keys)
    while shelf.keys:
        first = shelf.take(-1)  # the longest tier first
        tier = tier_of(len(first), context)
        if rest < tier:
            shelf.put(first)
            break
        window, gap = [first], tier - len(first)
        while gap:
            part = shelf.fitting(gap)
            if part is None:  # only longer ones are left: cut the shortest
                head, tail = shelf.take(0).split(gap)
                shelf.put(tail)
                part = head
            window.append(part)
            gap -= len(part)
        full.append(window)
        rest -= tier
    return full, [shelf.parts[k] for k in reversed(shelf.keys)]


def cut_to_powers(parts: list[Part]) -> list[list[Part]]:
    """The last parts as sequences whose lengths are powers of two."""
    out, parts = [], list(parts)
    total = sum(map(len, parts))
    while total:
        size, window = 1 << (total.bit_length() - 1), []
        total -= size
        while size:
            part = parts.pop(0)
            if len(part) > size:
                part, tail = part.split(size)
                parts.insert(0, tail)
            window.append(part)
            size -= len(part)
        out.append(window)
    return out


def deal_steps(sequences: list[list[Part]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence: the longest first, dealt to and fro."""
    lengths = [sum(map(len, s)) for s in sequences]
    groups = max(1, round(sum(lengths) / step_tokens))
    out = [0] * len(sequences)
    for turn, i in enumerate(sorted(range(len(sequences)), key=lambda i: -lengths[i])):
        lap, at = divmod(turn, groups)
        out[i] = at if lap % 2 == 0 else groups - 1 - at
    return out


def _pack(path: str, end_id: int, context: int, pool_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, base = encoder(path).arrays, TaskContext.get().partitionId() << 32
        made = steps = 0

        def rows(sequences):
            nonlocal made, steps
            columns = [[] for _ in range(8)]
            groups = deal_steps(sequences)
            for sequence, group in zip(sequences, groups):
                offset, tier = 0, sum(map(len, sequence))
                for p in sequence:
                    doc_id, ids = p.doc
                    for c, x in zip(columns, (doc_id, p.start, ids[p.start:p.end].astype("<u4").tobytes(), len(ids), base + made, offset, tier, base + steps + group)):
                        c.append(x)
                    offset += len(p)
                made += 1
            steps += max(groups, default=-1) + 1
            types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in PIECE_SCHEMA.split(", ")])

        pool, size = [], 0
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in in_pieces(texts, PIECE_BYTES):
                for doc_id, ids in zip(doc_ids[i:j], encode(texts[i:j], end_id)):
                    pool.append(Part((doc_id, ids), 0, len(ids)))
                    size += len(ids)
                    if size >= pool_tokens:
                        full, pool = pack_pool(pool, context)
                        size = sum(map(len, pool))
                        yield rows(full)
        full, pool = pack_pool(pool, context)
        yield rows(full + cut_to_powers(pool))
    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, context: int = CONTEXT, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece with its ids (binary: little-endian unsigned 32-bit)."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(in_turn(__name__, _pack(tokenizer_path, end_id, context, pool_tokens)), PIECE_SCHEMA)


END_ID = 2


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces with the digest of their ids in place of the ids."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op5_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(load(spark, sf_dir, "documents"))
