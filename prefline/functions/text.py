"""Column functions on text: words, counts, deterministic hashes.

All are built-in expressions (JVM side, whole-stage codegen); none is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefline.config import WORD_PATTERN

# Java's plain ``\w`` is ASCII-only, so the word class is spelled out
# (``config.WORD_PATTERN``); DuckDB's RE2 accepts the same spelling.


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(text) -> Column:
    """Lower-cased word tokens of ``text`` (array<string>, empty for no words)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def token_count(text) -> Column:
    """``size(words(text))`` without building the array: matches counted on the
    same lower-cased string with the same pattern."""
    return F.regexp_count(F.lower(_c(text)), F.lit(WORD_PATTERN))


def word_count(text) -> Column:
    """Number of word-character runs in ``text`` (case is irrelevant)."""
    return F.regexp_count(_c(text), F.lit(WORD_PATTERN))


def distinct_count(arr) -> Column:
    return F.size(F.array_distinct(_c(arr)))


def h8(salt: str, key) -> Column:
    """First 8 hex digits of md5(salt || '|' || key) as a non-negative bigint.

    Deterministic in (salt, key) only, so it does not change with partitioning,
    retries or executor loss (unlike ``rand``).
    """
    digest = F.md5(F.concat(F.lit(salt), F.lit("|"), _c(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(salt: str, key) -> Column:
    """A uniform double in [0, 1) from ``h8``."""
    return h8(salt, key) / F.lit(4294967296.0)


def hash_key(seed, key) -> Column:
    """Full md5 hex of (seed, key): the random order used by the split."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), _c(key).cast("string")))
