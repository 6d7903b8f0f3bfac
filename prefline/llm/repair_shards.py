"""Operator 8, token ids in files: Re-Pair grammar compression per shard.

Documents in ascending doc_id order are encoded and gathered into shards of about
``SHARD_IDS`` ids.  In a shard, pairs of neighbouring symbols that are frequent are
replaced by nonterminals, again and again, until no pair is frequent or the symbols no
longer fit 16 bits; no pair spans two documents.  A file holds the header, the rules,
the expansion lengths, each document's symbol and id counts, and the symbols.  So a
document, or a range of its ids, is decoded without decoding what stands before it.

Format of a file (little-endian): ``RPG1``; unsigned 32-bit terminals, rules, documents;
rules x 2 symbols; rules expansion lengths; documents symbol counts; documents id
counts; a byte with a symbol's width (2 or 4); the symbols.  Arrays but the last are
unsigned 32-bit.  Files are cells of a Parquet table (bucket, shard, start in bucket,
doc_ids, payload), so Spark's writers commit them and any store that Spark reads serves.

Defined results: null text: only the end id; null doc_id comes first; rows of one
doc_id come in the order of their texts; other columns are ignored; an empty table
gives no file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import PIECE_BYTES, fan_out, load, spans, written
from .ordered import range_buckets
from .piece_cache import encoder, in_pieces

SHARD_IDS = 1 << 19
FREQUENT = 32  # pairs with fewer places in a shard are not replaced
PER_ROUND = 8192  # pairs replaced at once
TERMINALS = 50_304
SYMBOLS = 1 << 16


def _cell(code: np.ndarray, cells: int) -> np.ndarray:
    return (code * 0x9E3779B97F4A7C1 >> 40) & (cells - 1)


def compress(ids: np.ndarray, sizes: np.ndarray, terminals: int = TERMINALS, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, symbols per document) of documents of ``sizes`` ids each."""
    seq, last = ids.astype(np.int64), np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    rules: dict[int, int] = {}
    # places whose pair may be replaced: a pair that is not frequent gets no more places
    # but where a symbol next to it is new, so only these are counted again
    at = np.flatnonzero(~last[:-1]) if len(seq) else np.zeros(0, np.int64)
    while len(at) and terminals + len(rules) < SYMBOLS:
        code = seq[at] << 32 | seq[at + 1]
        # count by hash first: only pairs in well-filled cells can be frequent
        cells = 1 << min(20, max(12, (2 * len(at)).bit_length()))
        cell = _cell(code, cells)
        kept = code[(np.bincount(cell, minlength=cells) >= frequent)[cell]]
        pairs, counts = np.unique(kept, return_counts=True)
        known = np.fromiter(rules, np.int64, len(rules))
        often = counts >= frequent
        top = np.flatnonzero(often & ~np.isin(pairs, known))
        top = top[np.argsort(-counts[top], kind="stable")][:min(PER_ROUND, SYMBOLS - terminals - len(rules))]
        if not len(top):
            break
        chosen = np.concatenate([known, pairs[top]])
        # the best chosen pair of each cell; another one there waits for a later round
        best = np.full(cells, len(chosen), np.int32)
        np.minimum.at(best, _cell(chosen, cells), np.arange(len(chosen), dtype=np.int32))
        rank = best[cell]
        rank[np.append(chosen, -2)[rank] != code] = len(chosen)
        # a place wins if no overlapping place has a better pair; of equal ones the first
        wins = rank < len(chosen)
        beside = at[1:] == at[:-1] + 1
        wins[1:] &= ~beside | (rank[1:] < rank[:-1])
        wins[:-1] &= ~beside | (rank[:-1] <= rank[1:])
        place = at[wins]
        if not len(place):
            break
        # pairs that stay worth a look, by the same cells: frequent ones and known ones
        look = np.zeros(cells, bool)
        look[_cell(pairs[often], cells)] = True
        look[_cell(chosen, cells)] = True
        for pair in pairs[top].tolist():
            rules[pair] = terminals + len(rules)
        seq[place] = terminals + rank[wins]
        last[place] |= last[place + 1]
        stays = np.ones(len(seq), bool)
        stays[place + 1] = False
        open_ = np.zeros(len(seq), bool)
        open_[at[look[cell]]] = True
        open_[place] = True
        before = place[place > 0] - 1
        before -= ~stays[before]  # the symbol before a new one may have been replaced too
        open_[before] = True
        seq, last, open_ = seq[stays], last[stays], open_[stays]
        at = np.flatnonzero(open_[:-1] & ~last[:-1])
    pairs = np.fromiter(rules, np.int64, len(rules))
    ends = np.flatnonzero(last)
    return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1), seq, np.diff(ends, prepend=-1)


def to_file(ids: np.ndarray, sizes: np.ndarray, terminals: int = TERMINALS) -> bytes:
    if len(ids) and int(ids.max()) >= terminals:
        terminals = int(ids.max()) + 1
    rules, symbols, counts = compress(ids, sizes, terminals)
    lengths = np.ones(terminals + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[terminals + i] = lengths[a] + lengths[b]
    width = 2 if terminals + len(rules) <= SYMBOLS else 4
    u4 = [x.astype("<u4").tobytes() for x in (rules, lengths[terminals:], counts, sizes)]
    return b"".join([b"RPG1", struct.pack("<III", terminals, len(rules), len(sizes)), *u4, bytes([width]), symbols.astype(f"<u{width}").tobytes()])


class TokenFile:
    """A file opened for reading; decodes whole, by document, or by range."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPG1":
            raise ValueError("not a file of this format")
        self.terminals, n, docs = struct.unpack_from("<III", payload, 4)
        at = 16

        def array(count, kind="<u4"):
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out.astype(np.int64)

        self.rules = array(2 * n).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), array(n)])
        self.counts, self.sizes = array(docs), array(docs)
        width = payload[at]
        at += 1
        self.symbols = array((len(payload) - at) // width, f"<u{width}")
        self.first = np.cumsum(self.counts) - self.counts
        self._flat = None

    def _table(self):
        """Each rule's expansion, all in one array, and where it begins."""
        if self._flat is None:
            sizes = self.lengths[self.terminals:]
            begin = np.cumsum(sizes) - sizes
            flat = np.zeros(int(sizes.sum()), np.uint32)
            for i, pair in enumerate(self.rules.tolist()):
                to = begin[i]
                for s in pair:
                    if s < self.terminals:
                        flat[to] = s
                        to += 1
                    else:
                        j = s - self.terminals
                        flat[to:to + sizes[j]] = flat[begin[j]:begin[j] + sizes[j]]
                        to += sizes[j]
            self._flat = flat, begin
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._table()
        sizes = self.lengths[symbols]
        source = np.concatenate([np.arange(self.terminals, dtype=np.uint32), flat])
        start = np.concatenate([np.arange(self.terminals), self.terminals + begin])
        return source[spans(start[symbols], sizes)]

    def whole(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[i]:self.first[i] + self.counts[i]])

    def read(self, i: int, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length`` of document ``i``; only the symbols that
        cover them are expanded, found by their expansion lengths."""
        own = self.symbols[self.first[i]:self.first[i] + self.counts[i]]
        ends = np.cumsum(self.lengths[own])
        a, b = np.searchsorted(ends, [start, start + length - 1], side="right")
        cover = own[a:b + 1]
        before = int(ends[a - 1]) if a else 0
        return self.expand(cover)[start - before:start - before + length]


FILE_SCHEMA = "bucket int, shard int, start bigint, n_ids bigint, doc_ids array<bigint>, payload binary"


def _write(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).arrays
        docs, ids, size, bucket, shard, start = [], [], 0, None, 0, 0

        def closed():
            sizes = np.array([len(x) for x in ids])
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([to_file(np.concatenate(ids), sizes)], pa.binary())],
                [c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for b in batches:
            buckets, doc_ids, texts = (c.to_pylist() for c in b.columns)
            encoded = (x for i, j in in_pieces(texts, PIECE_BYTES) for x in encode(texts[i:j], end_id))
            for of, doc_id, own in zip(buckets, doc_ids, encoded):
                if docs and (of != bucket or size >= shard_ids):
                    yield closed()
                    shard, start = shard + 1, start + size
                    docs, ids, size = [], [], 0
                if of != bucket:
                    bucket, shard, start = of, 0, 0
                docs.append(doc_id)
                ids.append(own)
                size += len(own)
        if docs:
            yield closed()
    return run


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, compress and write; returns the written table of files.  One shuffle of
    the texts into ranges of doc_id."""
    n = fan_out(docs.sparkSession)
    rows = range_buckets(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")), n)
    rows = rows.select("bucket", "doc_id", "text").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")
    return written(rows.mapInArrow(_write(tokenizer_path, end_id, shard_ids), FILE_SCHEMA), "token-files")


READ_SCHEMA = "bucket int, doc_id bigint, start bigint, ids binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for bucket, _, start, _, doc_ids, payload in zip(*b.columns):
            file = TokenFile(payload.as_py())
            ends = np.cumsum(file.sizes)
            ids = file.whole().astype("<u4")
            cells = [ids[e - s:e].tobytes() for s, e in zip(file.sizes, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket.as_py()] * len(cells), pa.int32()), doc_ids.values, pa.array(start.as_py() + ends - file.sizes, pa.int64()), pa.array(cells, pa.binary())],
                [c.split()[0] for c in READ_SCHEMA.split(", ")])


def read_files(files: DataFrame) -> DataFrame:
    """Every document's ids (binary: little-endian unsigned 32-bit) and how many ids
    stand before it in all files.  Only a total for each bucket goes to the driver."""
    totals = files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect()
    before, rows = 0, []
    for t in totals:
        rows.append((t["bucket"], before))
        before += t["n"]
    spark = files.sparkSession
    offsets = spark.createDataFrame(rows, "bucket int, before bigint")  # a row for each bucket
    back = files.select("bucket", "shard", "start", "n_ids", "doc_ids", "payload").mapInArrow(_read, READ_SCHEMA)
    return back.join(F.broadcast(offsets), "bucket").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")


END_ID = 0


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_files(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return read_files(files).select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
