"""Word-level tokenisation: vocabulary (E2), encode (T6), pad + mask (T8, T10),
random prefix (T7) and decode (T9).

Words are ``prefline.functions.text.words`` (lower-cased Unicode word runs).
Reserved ids come from ``TokenConfig`` (0 pad, 1 unknown, 2 bos, 3 eos); words
get ids from 4 in order of descending frequency, ties by binary string order.

Encoding strategies
-------------------
``encode_join`` / ``decode_join`` (default): for a vocabulary of any size, so that
every word of the corpus has an id and decoding gives back the words that were
encoded.  Ids go by frequency, so the hot words are the first ``HEAD_ENTRIES``:
those (of bounded length, so bounded in bytes) are broadcast and looked up in their
row by Arrow's ``index_in`` kernel; only the rare rest is exploded, shuffled to the
rest of the vocabulary and back to its row.
``Encoder``: for a vocabulary that the caller caps (``vocab_size``).  A scalar
Arrow UDF looks every word up in the broadcast vocabulary with Arrow's
``index_in`` kernel; words beyond the cap become the unknown id.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefline.config import PREFIX_MAX, PREFIX_MIN, TokenConfig
from prefline.functions.text import h8, words
from prefline.operators.workers import runs
from prefline.session import reliable_checkpoint
from prefline.sources.tables import spread

# Largest capped vocabulary that an Encoder ships to every worker (entries).
BROADCAST_MAX_ENTRIES = 2_000_000
# The broadcast part of a joined vocabulary: so many words of at most so many
# characters (at most 16 MB of text).
HEAD_ENTRIES, HEAD_CHARS = 65_536, 64
# Elements that a Python worker looks up at a time.
RUN_ITEMS = 1 << 20


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------- vocabulary

def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(tok, n) over all rows; hash aggregate with map-side partial counts, so a
    very frequent word costs one row per map task in the shuffle."""
    src = spread(df.select(text))
    return src.select(F.explode(words(text)).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


def dense_order_ids(df: DataFrame, order: list, first: int = 0, out: str = "id") -> DataFrame:
    """Number rows 0.. in ``order`` across the cluster, without a single-partition
    window and without Python: range-sort, cut lineage with a reliable checkpoint
    (so partition contents are fixed for both passes), count rows per partition
    (one row per partition reaches the driver), then add each partition's offset
    to the row's position inside its partition."""
    ordered = reliable_checkpoint(df.orderBy(*order))
    with_pos = ordered.select("*", F.spark_partition_id().alias("_pid"),
                              F.monotonically_increasing_id().alias("_mid"))
    sizes = dict(with_pos.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for pid in range(ordered.rdd.getNumPartitions()):
        offsets.append((pid, acc))
        acc += sizes.get(pid, 0)
    # one row per partition: broadcast size bounded by the partition count
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    numbered = with_pos.join(F.broadcast(table), "_pid")
    return numbered.withColumn(out, (F.lit(first) + F.col("_off") + pos).cast("long")).drop("_pid", "_mid", "_off")


def build_vocab(df: DataFrame, text: str = "text", cfg: TokenConfig = TokenConfig()) -> DataFrame:
    """(tok, n, id), ids from ``first_word_id`` by descending count, ties by token.

    Numbered across the cluster (``dense_order_ids``), whatever its size;
    ``vocab_size``, if the caller sets one, is then a filter on the id.
    """
    counts = word_counts(df, text)
    first = cfg.first_word_id
    order = [F.desc("n"), F.asc("tok")]
    numbered = dense_order_ids(counts, order, first)
    if cfg.vocab_size is not None:
        numbered = numbered.where(F.col("id") < F.lit(first + cfg.vocab_size))
    return numbered.select("tok", "n", "id")


def vocab_tokens(vocab: DataFrame, cfg: TokenConfig = TokenConfig()) -> list[str]:
    """The capped vocabulary as a list in id order (index i -> id first + i).

    Only for a vocabulary with a proven bound; the bound is checked here.
    """
    if cfg.vocab_size is None or cfg.vocab_size > BROADCAST_MAX_ENTRIES:
        raise ValueError("an Encoder needs a vocabulary capped by vocab_size; use encode_join")
    rows = vocab.select("tok", "id").collect()
    if len(rows) > cfg.vocab_size:
        raise ValueError("vocabulary larger than its declared cap")
    toks = [None] * len(rows)
    for tok, i in rows:
        toks[i - cfg.first_word_id] = tok
    return toks


# --------------------------------------------------------------------------- encode

class Encoder:
    """Holds a broadcast vocabulary and builds the Arrow encode/decode UDFs."""

    def __init__(self, spark, vocab: DataFrame, cfg: TokenConfig = TokenConfig()):
        self.cfg = cfg
        self.vocab = vocab
        self._bc = spark.sparkContext.broadcast(vocab_tokens(vocab, cfg))
        src = (uuid.uuid4().hex, self._bc)
        self.encode_udf = _make_encode_udf(src, cfg.first_word_id, cfg.unk_id)
        self.decode_udf = _make_decode_udf(src, cfg.first_word_id, cfg.special_ids)

    def encode(self, word_array) -> Column:
        return self.encode_udf(_c(word_array))

    def decode(self, ids) -> Column:
        return self.decode_udf(_c(ids))

    def unpersist(self):
        self._bc.unpersist()


_VALUE_SETS: "OrderedDict[str, pa.Array]" = OrderedDict()
_VALUE_SETS_MAX = 8  # vocabularies kept per long-lived Python worker


def _value_set(src) -> pa.Array:
    """The vocabulary as an Arrow array, built once per Python worker (small LRU)."""
    key, bc = src
    vs = _VALUE_SETS.get(key)
    if vs is None:
        vs = _VALUE_SETS[key] = pa.array(bc.value, type=pa.string())
        while len(_VALUE_SETS) > _VALUE_SETS_MAX:
            _VALUE_SETS.popitem(last=False)
    else:
        _VALUE_SETS.move_to_end(key)
    return vs


def _rebase(arr: pa.ListArray) -> pa.Array:
    offsets = arr.offsets
    return pc.subtract(offsets, offsets[0])


def _list_class(arr):
    """Build lists of the same kind Spark sent (``large_list`` when large var types are on)."""
    return pa.LargeListArray if pa.types.is_large_list(arr.type) else pa.ListArray


def _matching(vs: pa.Array, values: pa.Array) -> pa.Array:
    return vs if vs.type == values.type else vs.cast(values.type)


def _make_encode_udf(src, first_id: int, unk_id: int):
    @F.arrow_udf("array<int>")
    def encode(arr: pa.Array) -> pa.Array:
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        values = arr.flatten()
        idx = pc.index_in(values, value_set=_matching(_value_set(src), values))
        ids = pc.fill_null(pc.add(idx.cast(pa.int32()), pa.scalar(first_id, pa.int32())),
                           pa.scalar(unk_id, pa.int32()))
        return _list_class(arr).from_arrays(_rebase(arr), ids, mask=arr.is_null())
    return encode


def _make_decode_udf(src, first_id: int, special_ids: tuple[int, ...]):
    @F.arrow_udf("string")
    def decode(arr: pa.Array) -> pa.Array:
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        vs = _value_set(src)
        flat = arr.flatten().cast(pa.int64())
        rel = pc.subtract(flat, first_id)
        keep = pc.and_(pc.invert(pc.is_in(flat, value_set=pa.array(special_ids, pa.int64()))),
                       pc.and_(pc.greater_equal(rel, 0), pc.less(rel, len(vs))))
        toks = pc.take(vs, pc.filter(rel, keep))
        parents = pc.filter(pc.list_parent_indices(arr), keep).to_numpy(zero_copy_only=False)
        counts = np.bincount(parents, minlength=len(arr))
        cls = _list_class(arr)
        width = np.int64 if cls is pa.LargeListArray else np.int32
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(width))
        lists = cls.from_arrays(offsets, toks, mask=arr.is_null())
        return pc.binary_join(lists, " ")
    return decode


_HEAD_TYPES = {"tok": ("string", pa.string()), "id": ("int", pa.int32())}


def _head_entries(src, by: str, wanted: str) -> tuple[pa.Array, pa.Array]:
    """The broadcast head of a vocabulary as Arrow arrays, built once per Python worker."""
    key, bc = src
    if key not in _VALUE_SETS:
        _VALUE_SETS[key] = tuple(pa.array(c, _HEAD_TYPES[k][1]) for c, k in zip(bc.value, (by, wanted)))
        while len(_VALUE_SETS) > _VALUE_SETS_MAX:
            _VALUE_SETS.popitem(last=False)
    return _VALUE_SETS[key]


def _make_head_udf(src, by: str, wanted: str, item: str):
    """For every array: what the head has for each element, null if nothing, and the
    elements that it does not have, with their places.  A null array is an empty one."""
    def one(arr: pa.Array) -> pa.Array:
        keys, values = _head_entries(src, by, wanted)
        items, lists = arr.flatten(), _list_class(arr)
        large = lists is pa.LargeListArray
        if large and wanted == "tok":
            values = values.cast(pa.large_string())
        sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = pc.index_in(items, value_set=_matching(keys, items))
        miss = at.is_null().to_numpy(zero_copy_only=False)
        pos = (np.flatnonzero(miss) - np.repeat(ends[:-1], sizes)[miss]).astype(np.int32)
        missed = pa.StructArray.from_arrays([pa.array(pos), items.filter(pa.array(miss))], ["_pos", "_item"])
        missed_ends = np.concatenate([[0], np.cumsum(miss)])[ends]
        offsets = [pa.array(x.astype(np.int64 if large else np.int32)) for x in (ends, missed_ends)]
        return pa.StructArray.from_arrays([lists.from_arrays(offsets[0], values.take(at)),
                                           lists.from_arrays(offsets[1], missed)], ["known", "missed"])

    @F.arrow_udf(f"struct<known:array<{_HEAD_TYPES[wanted][0]}>,missed:array<struct<_pos:int,_item:{item}>>>")
    def found(arr: pa.Array) -> pa.Array:
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
        return pa.concat_arrays([one(arr.slice(0, 0))] + [one(run) for run in runs(arr, sizes, RUN_ITEMS)])
    return found


def _looked_up(df: DataFrame, key: str, array: str, vocab: DataFrame, by: str, wanted: str, entry, value, out: str,
               cfg: TokenConfig, finish) -> DataFrame:
    """``df`` plus ``out``: ``finish`` of the list that has, for every element of ``array``
    in order, ``wanted`` of the row of ``vocab`` whose column ``by`` is that element.
    ``entry`` makes a sortable value of an element's position and what was found, null if
    nothing; ``value`` takes from it what the list holds.

    Every row looks its elements up in the broadcast head; what the head does not have is
    exploded, meets the rest of the vocabulary and returns.  The rows are shuffled by key
    once: both uses of ``lists`` need its one column, so they share the exchange.
    """
    is_head = F.coalesce((F.col("id") < F.lit(cfg.first_word_id + HEAD_ENTRIES)) & (F.length("tok") <= HEAD_CHARS), F.lit(False))
    # at most HEAD_ENTRIES rows of HEAD_CHARS characters reach the driver
    head = vocab.where(is_head).select(F.col(by).alias("_by"), F.col(wanted).alias("_value")).collect()
    bc = df.sparkSession.sparkContext.broadcast(([r["_by"] for r in head], [r["_value"] for r in head]))
    item = df.schema[array].dataType.elementType.simpleString()
    found = _make_head_udf((uuid.uuid4().hex, bc), by, wanted, item)
    # the key is a struct, so that null keys meet and every step keeps one partitioning
    rows = df.select(F.struct(F.col(key)).alias("_key"), found(array).alias("_row"))
    lists = rows.groupBy("_key").agg(F.collect_list("_row").alias("_rows"))
    rest = vocab.where(~is_head).select(F.col(by).alias("_by"), F.col(wanted).alias("_value"))
    looked = lists.select("_key", F.inline(F.flatten("_rows.missed"))).join(rest, F.col("_item") == F.col("_by"), "left") \
        .groupBy("_key").agg(F.collect_list(entry(F.col("_pos"), F.col("_value"))).alias("_looked"))
    known = F.flatten(F.transform("_rows", lambda row: F.transform(row["known"], lambda x, i: F.when(x.isNotNull(), entry(i, x)))))
    none = F.array().cast(looked.schema["_looked"].dataType)
    whole = F.sort_array(F.concat(F.array_compact(known), F.coalesce("_looked", none)))
    values = lists.join(looked, "_key", "left").select("_key", finish(F.transform(whole, value)).alias(out))
    return df.withColumn("_key", F.struct(F.col(key))).join(values, "_key", "left").drop("_key")


def encode_join(df: DataFrame, key: str, word_array: str, vocab: DataFrame, out: str = "input_ids",
                cfg: TokenConfig = TokenConfig()) -> DataFrame:
    """Encode with a vocabulary of any size, in word order.

    ``key`` must be unique per row (the token lists of rows sharing a key would
    be merged).  A null array is encoded like an empty one.
    """
    # position and id in one long: a struct takes four times the room in a list
    def entry(pos, i):
        return F.shiftleft(pos.cast("long"), 32).bitwiseOR(F.coalesce(i, F.lit(cfg.unk_id)).cast("long"))

    value = lambda e: e.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return _looked_up(df, key, word_array, vocab, "tok", "id", entry, value, out, cfg, lambda ids: ids)


def decode_join(df: DataFrame, key: str, ids: str, vocab: DataFrame, out: str = "text",
                cfg: TokenConfig = TokenConfig()) -> DataFrame:
    """The words of ``ids`` joined by one space, without special ids, by a vocabulary of any size."""
    return _looked_up(df, key, ids, vocab, "id", "tok", lambda pos, tok: F.struct(pos.alias("_pos"), tok.alias("tok")),
                      lambda e: e["tok"], out, cfg, lambda toks: F.array_join(toks, " "))


# --------------------------------------------------------------------------- pad, prefix

def pad(ids, length: int, side: str = "left", pad_id: int = 0) -> Column:
    """Pad to ``length`` with ``pad_id`` (no truncation; longer rows are filtered first)."""
    ids = _c(ids)
    fill = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if side == "left" else F.concat(ids, fill)


def attention_mask(ids, length: int, side: str = "left") -> Column:
    """1 for a token, 0 for padding, aligned with ``pad``."""
    ids = _c(ids)
    n = F.size(ids)
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - n, F.lit(0)))
    ones = F.array_repeat(F.lit(1), n)
    return F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)


def prefix_length(key, salt: str = "prefix", lo: int = PREFIX_MIN, hi: int = PREFIX_MAX) -> Column:
    """A per-row length in [lo, hi) from a hash of the key (deterministic sampler)."""
    return (F.lit(lo) + F.pmod(h8(salt, key), F.lit(hi - lo))).cast("long")


def random_prefix(tokens, k) -> Column:
    return F.slice(_c(tokens), 1, _c(k))
