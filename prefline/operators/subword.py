"""T6, T9 with a given subword vocabulary (a public tokenizer's JSON file; none is trained
here), and the two datasets of the reference built on it (P9, P10).

The file is read where the driver can read it and sent to the workers, at most ``MAX_FILE``
bytes, so the workers need no copy at that path.  Texts are encoded by Arrow batches, one
tokenizer for each worker.  Ids are the library's own: the file's special strings are
recognised, as in a rendered template they must be, and no id is added.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefline.config import MIN_REVIEW_CHARS, PREFIX_MAX, PREFIX_MIN, DatasetConfig, TokenConfig
from prefline.functions import templates as TM
from prefline.operators.batches import length_batches, pad_batches
from prefline.operators.tokens import attention_mask, pad, prefix_length
from prefline.operators.workers import runs
from prefline.sources.adapters import adapt_queries
from prefline.sources.tables import spread

MAX_FILE = 64 << 20
# Bytes of text that are Python objects at a time; their ids take some thirty times as much.
RUN_BYTES = 1 << 20
_READY: dict[str, object] = {}


def _tokenizer(key: str, source):
    if key not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _READY.clear()  # one vocabulary at a time in a worker
        _READY[key] = Tokenizer.from_str(source.value)
    return _READY[key]


def _texts(column: pa.Array):
    """Lists of texts of at most ``RUN_BYTES`` together, or of one longer text."""
    for run in runs(column, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), RUN_BYTES):
        yield run.to_pylist()


class SubwordTokenizer:
    """Encodes and decodes columns by the vocabulary file at ``path``."""

    def __init__(self, spark: SparkSession, path: str, eos_token: str = "<|endoftext|>"):
        with open(path, encoding="utf-8") as f:
            text = f.read(MAX_FILE + 1)
        if len(text) > MAX_FILE:
            raise ValueError(f"a vocabulary file has at most {MAX_FILE} characters")
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(text)
        self.eos_token, self.eos_id = eos_token, own.token_to_id(eos_token)
        if self.eos_id is None:
            raise ValueError(f"{eos_token!r} is not in the vocabulary")
        self.size = own.get_vocab_size()
        self._source = spark.sparkContext.broadcast(text)
        self._encode, self._decode, self._prefix = _udfs(f"{path}:{len(text)}:{hash(text)}", self._source)

    @property
    def tokens(self) -> TokenConfig:
        """No padding token in the file, so padding is the end-of-sequence id."""
        return TokenConfig(pad_id=None, unk_id=self.eos_id, bos_id=self.eos_id, eos_id=self.eos_id)

    def encode(self, text) -> Column:
        """``array<int>``; a null text gives null."""
        return self._encode(text)

    def decode(self, ids) -> Column:
        """The text of ``ids`` without special tokens; null ids give null."""
        return self._decode(ids)

    def prefix(self, text, k) -> Column:
        """``struct<ids, text>``: the first ``k`` ids of the whole text, and those decoded.
        The ids beyond stay with the worker, and one worker does both."""
        return self._prefix(text, k)


def _udfs(key: str, source):
    ids, head = pa.list_(pa.int32()), pa.struct([("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def encoded(texts: list) -> list:
        found = _tokenizer(key, source).encode_batch([t or "" for t in texts], add_special_tokens=False)
        return [None if t is None else e.ids for t, e in zip(texts, found)]

    def encode(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], ids)] + [pa.array(encoded(texts), ids) for texts in _texts(column)])

    def decode(column: pa.Array) -> pa.Array:
        tokenizer = _tokenizer(key, source)
        return pa.array([None if x is None else tokenizer.decode(x, skip_special_tokens=True) for x in column.to_pylist()], pa.string())

    def prefix(column: pa.Array, k: pa.Array) -> pa.Array:
        tokenizer, firsts = _tokenizer(key, source), []
        for texts in _texts(column):
            sizes = k.slice(len(firsts), len(texts)).to_pylist()
            firsts += [None if x is None or n is None else x[:n] for x, n in zip(encoded(texts), sizes)]
        return pa.array([{"ids": x, "text": None if x is None else tokenizer.decode(x, skip_special_tokens=True)} for x in firsts], head)

    # not deterministic for the optimizer: a filter on the ids must not encode a second time
    return (F.arrow_udf(encode, "array<int>").asNondeterministic(), F.arrow_udf(decode, "string").asNondeterministic(),
            F.arrow_udf(prefix, "struct<ids:array<int>,text:string>").asNondeterministic())


def build_query_dataset(source: DataFrame, tokenizer: SubwordTokenizer, cfg: DatasetConfig = DatasetConfig(),
                        template: Callable[[Column], Column] | None = None, dataset_name: str | None = None,
                        key: str = "conv_id", batch_size: int | None = None) -> DataFrame:
    """Adapt -> messages -> template -> ids -> at most ``max_length`` -> pad.

    ``template`` is a compiled template; without one the fallback template is used, which
    ends with the tokenizer's end-of-sequence token.  Padding by ``cfg.padding``:
    ``"max_length"`` (or True) to ``max_length``, ``"longest"`` to the longest row of
    batches of ``batch_size`` rows of like length, False not at all.  A row without a
    query has no ids and goes, as has a row that is too long.
    """
    df = spread(adapt_queries(source, dataset_name))
    messages = TM.user_messages("query", cfg.sys_prompt_text if cfg.sys_prompt else None)
    text = template(messages) if template else TM.render(messages, tokenizer.eos_token)
    df = df.where("query is not null").withColumn("input_ids", tokenizer.encode(text))
    df = df.withColumn("n_tokens", F.size("input_ids").cast("long")).where(F.col("n_tokens") <= cfg.max_length)
    mode = {True: "max_length", False: "none"}.get(cfg.padding, cfg.padding)
    if mode == "longest":
        if not batch_size:
            raise ValueError("padding to the longest needs a batch_size")
        return pad_batches(length_batches(df, key, "input_ids", batch_size), "input_ids", tokenizer.tokens, cfg.padding_side)
    if mode == "none":
        return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    if mode != "max_length":
        raise ValueError(f"padding is max_length, longest, true or false, not {cfg.padding!r}")
    masked = df.withColumn("attention_mask", attention_mask("input_ids", cfg.max_length, cfg.padding_side))
    return masked.withColumn("input_ids", pad("input_ids", cfg.max_length, cfg.padding_side, tokenizer.tokens.effective_pad_id))


def build_prefix_dataset(reviews: DataFrame, tokenizer: SubwordTokenizer, key: str = "doc_id", min_len: int = PREFIX_MIN,
                         max_len: int = PREFIX_MAX, min_chars: int = MIN_REVIEW_CHARS, salt: str = "prefix") -> DataFrame:
    """P10: reviews longer than ``min_chars``, their first k ids (k by a hash of the key),
    decoded.  The whole review is encoded, as its first ids may depend on what follows."""
    df = spread(reviews).withColumnRenamed("text", "review").where(F.char_length("review") > min_chars)
    df = df.withColumn("k", prefix_length(F.col(key), salt, min_len, max_len))
    df = df.withColumn("_first", tokenizer.prefix("review", "k"))
    return df.withColumn("input_ids", F.col("_first.ids")).withColumn("query", F.col("_first.text")).drop("_first")
