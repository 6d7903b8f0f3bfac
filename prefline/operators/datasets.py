"""Dataset builders: query dataset (P5, P6, P9, F1) and random-prefix dataset.

Projections and filters are narrow; with a capped ``Encoder`` nothing is shuffled
beyond what the source adapter needs.  A vocabulary of any size is joined: the rare
words and the lists of ids are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefline.config import MIN_REVIEW_CHARS, PREFIX_MAX, PREFIX_MIN, DatasetConfig, TokenConfig
from prefline.functions import templates as TM
from prefline.functions.text import words
from prefline.operators.evaluate import evaluate_once
from prefline.operators.tokens import Encoder, attention_mask, decode_join, encode_join, pad, prefix_length, random_prefix
from prefline.sources.adapters import adapt_queries
from prefline.sources.tables import spread


def _encoded(df: DataFrame, vocab: Encoder | DataFrame, key: str, words_col: str, cfg: TokenConfig) -> DataFrame:
    if isinstance(vocab, Encoder):
        return df.withColumn("_ids", vocab.encode(words_col))
    return encode_join(df, key, words_col, vocab, "_ids", cfg)


def build_query_dataset(source: DataFrame, vocab: Encoder | DataFrame, cfg: DatasetConfig = DatasetConfig(),
                        dataset_name: str | None = None, template: bool = True, key: str = "conv_id") -> DataFrame:
    """Adapt -> template -> tokenise -> length filter -> encode -> pad.

    The rendered chat prompt (system message first when ``sys_prompt``) is
    tokenised, or the bare query without ``template``.  F1 keeps rows whose own
    token count is at most ``max_length``; the test runs on the word count
    *before* encoding and padding (same rows, less work).

    ``vocab`` is a vocabulary (``build_vocab``) of any size, joined on the words;
    ``key`` must then be unique.  Or a capped ``Encoder``.
    """
    df = adapt_queries(source, dataset_name)
    tok = cfg.tokens
    if template:
        # the prompt's end-of-sequence marker is the reserved eos id, not a word,
        # so it is appended after encoding
        system = cfg.sys_prompt_text if cfg.sys_prompt else None
        text, end = TM.user_prompt(F.col("query"), system, ""), [tok.eos_id]
    else:
        text, end = F.col("query"), []
    df = evaluate_once(df, _w=words(text)).where(F.size("_w") + F.lit(len(end)) <= cfg.max_length)
    df = _encoded(df, vocab, key, "_w", tok)
    if end:
        df = df.withColumn("_ids", F.concat("_ids", F.array(*[F.lit(i) for i in end])))
    if cfg.padding:
        df = df.withColumn("input_ids", pad("_ids", cfg.max_length, cfg.padding_side, tok.effective_pad_id)) \
               .withColumn("attention_mask", attention_mask("_ids", cfg.max_length, cfg.padding_side))
    else:
        df = df.withColumn("input_ids", F.col("_ids")) \
               .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("_ids")))
    return df.withColumn("n_tokens", F.size("_ids").cast("long")).drop("_w", "_ids")


def build_prefix_dataset(reviews: DataFrame, vocab: Encoder | DataFrame, key: str = "doc_id",
                         min_len: int = PREFIX_MIN, max_len: int = PREFIX_MAX,
                         min_chars: int = MIN_REVIEW_CHARS, salt: str = "prefix") -> DataFrame:
    """P10: rename text -> review, keep reviews longer than ``min_chars`` characters,
    take a per-row random number k of leading tokens (k in [min_len, max_len),
    from a hash of the key so retries and re-partitioning give the same k),
    encode them and decode back to text without special tokens.

    The whole review is tokenised (as the reference encodes the whole review
    before slicing); only its first k tokens are looked up and decoded.
    """
    df = spread(reviews).withColumnRenamed("text", "review")
    df = df.where(F.char_length("review") > min_chars)
    k = prefix_length(F.col(key), salt, min_len, max_len)
    df = df.withColumn("k", k)
    df = df.withColumn("_w", random_prefix(words("review"), F.col("k")))
    cfg = vocab.cfg if isinstance(vocab, Encoder) else TokenConfig()
    df = _encoded(df, vocab, key, "_w", cfg).drop("_w").withColumnRenamed("_ids", "input_ids")
    if isinstance(vocab, Encoder):
        return df.withColumn("query", vocab.decode("input_ids"))
    return decode_join(df, key, "input_ids", vocab, "query", cfg)
