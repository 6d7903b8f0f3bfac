"""Operator 10, byte-level BPE encoding and decoding by overlapping chunks.

A text of at most ``CHUNK`` code points is encoded where it is read.  A longer one
is cut into chunks that overlap by ``OVERLAP`` code points.  Chunks are pre-tokenised
and encoded in parallel.  A pre-tokeniser has no memory: once two runs begin a match
at the same place, they agree from there on.  So neighbours are stitched at the first
boundary that both found within their overlap; what a chunk made of the text before
that place is dropped in favour of its predecessor's.  Where a single match is longer
than the overlap there is no such place, and the text from the last sure boundary on
is pre-tokenised and encoded anew together with the next chunk.

Defined results: null text: no ids; rows are treated one by one, so repeated rows
and ids give repeated results; null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import load, spans

CHUNK, OVERLAP = 1 << 16, 1 << 12
_READY: dict[tuple, tuple] = {}


def _tables(ranks_path: str, pattern: str):
    """Per worker: tiktoken's encoder, the compiled pattern, and each id's bytes."""
    if (ranks_path, pattern) not in _READY:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            size[rank] = len(piece)
        flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        _READY[ranks_path, pattern] = encoder, regex.compile(pattern), np.cumsum(size) - size, size, flat
    return _READY[ranks_path, pattern]


def _ids(encoder, text: str) -> np.ndarray:
    return np.asarray(encoder.encode_to_numpy(text, disallowed_special=()), np.uint32)


def _encode_short(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tables(path, pattern)[0]
        for b in batches:
            ids = [_ids(encoder, t).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return run


CHUNKS = "doc_id bigint, row_key bigint, k bigint, text string"
ENCODED = CHUNKS + ", starts array<int>, counts array<int>, ids binary, last boolean"


def _cut(chunk: int, overlap: int):
    """(doc_id, row_key, text) -> overlapping chunks."""
    def run(batches):
        for b in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in b.columns)):
                for k in range(max(1, -(-len(text) // chunk))):
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": doc, "row_key": key, "k": k, "text": text[k * chunk:(k + 1) * chunk + overlap], "last": (k + 1) * chunk >= len(text)}],
                        pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("last", pa.bool_())]))
    return run


def _encode_chunks(path: str, pattern: str):
    """Pre-tokenise and encode each chunk: where its matches start, and ids before each."""
    def run(batches):
        encoder, matches, *_ = _tables(path, pattern)
        for b in batches:
            starts, counts, ids = [], [], []
            for text in b.column("text").to_pylist():
                pieces = [(m.start(), _ids(encoder, m.group())) for m in matches.finditer(text)]
                starts.append([s for s, _ in pieces])
                counts.append(np.cumsum([0, *(len(x) for _, x in pieces)])[:-1].tolist())
                ids.append(np.concatenate([np.zeros(0, np.uint32), *(x for _, x in pieces)]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "row_key", "k", "text")]
                + [pa.array(starts, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(ids, pa.binary()), b.column("last")],
                ["doc_id", "row_key", "k", "text", "starts", "counts", "ids", "last"])
    return run


class _Open:
    """The text of a document that was pre-tokenised last, and what is settled of it.

    ``base``: where the next chunk begins in it; ``begin``: the sure boundary from
    which its ids are still to be written.
    """

    def __init__(self, text, starts, counts, ids, begin, base):
        self.text, self.starts, self.counts, self.ids, self.begin, self.base = text, np.asarray(starts), counts, ids, begin, base

    def ids_between(self, begin, end=None) -> np.ndarray:
        at = [len(self.ids) if x is None or (i := int(np.searchsorted(self.starts, x))) == len(self.starts) else self.counts[i] for x in (begin, end)]
        return self.ids[at[0]:at[1]]


def _stitch(path: str, pattern: str, chunk: int):
    """Chunks, those of a document together and in order -> a row of ids each."""
    def run(batches):
        encoder, matches, *_ = _tables(path, pattern)
        for b in batches:
            for doc, _, k, text, starts, counts, ids, last in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(ids, "<u4")
                if k == 0:
                    parts, now = [], _Open(text, starts, counts, ids, 0, chunk)
                else:
                    both = np.intersect1d(now.starts, np.asarray(starts) + now.base)
                    both = both[both >= now.begin]
                    if len(both):
                        meet = int(both[0])
                        parts.append(now.ids_between(now.begin, meet))
                        now = _Open(text, starts, counts, ids, meet - now.base, chunk)
                    else:  # a match longer than the overlap
                        text, base = now.text[now.begin:now.base] + text, now.base - now.begin
                        pieces = [(m.start(), _ids(encoder, m.group())) for m in matches.finditer(text)]
                        sizes = np.cumsum([0, *(len(x) for _, x in pieces)])
                        now = _Open(text, [s for s, _ in pieces], sizes[:-1].tolist(), np.concatenate([x for _, x in pieces]), 0, base + chunk)
                if last:
                    parts.append(now.ids_between(now.begin))
                    whole = np.concatenate(parts).astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([whole], pa.binary())], ["doc_id", "ids"])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of every row's whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_encode_short(ranks_path, pattern), "doc_id bigint, ids binary")
    cut = rows.where(F.length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text")
    cut = cut.mapInArrow(_cut(chunk, overlap), CHUNKS + ", last boolean")
    parts = cut.repartition("doc_id", "row_key", "k").mapInArrow(_encode_chunks(ranks_path, pattern), ENCODED)
    stitched = parts.repartition("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "k")
    return short.unionByName(stitched.mapInArrow(_stitch(ranks_path, pattern, chunk), "doc_id bigint, ids binary"))


def _decode(ranks_path: str, pattern: str):
    def run(batches):
        *_, first, size, flat = _tables(ranks_path, pattern)
        for b in batches:
            out = []
            for cell in b.column(1).to_pylist():
                ids = np.frombuffer(cell, "<u4")
                out.append(flat[spans(first[ids], size[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])
    return run


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: the ids' raw bytes one after the other."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(ranks_path, pattern), "doc_id bigint, ids binary, decoded binary")


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = decode(encode(load(spark, sf_dir, "documents"), *args), *args)
    return back.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
