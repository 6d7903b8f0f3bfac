"""Operator 3, chat formatting by prefix-target expansion (native).

Every turn is rendered as ``### role: text</turn>`` and a newline.  Inside roles
and texts the backslash, ``#``, ``<`` (and ``:`` in roles) are written as a
backslash and a digit, so no control string can stand inside a text, and undoing
the digits, the backslash last, gives the text back exactly.

A conversation is rendered once, in blocks of ``BLOCK_TURNS`` consecutive turn
numbers; an example is a row per assistant turn that holds the reply and points
at its context, the ``context_chars`` code points before the reply.  Thus all
examples of a conversation together take room in proportion to its length, not to
its square; ``materialise`` writes contexts out for those who need them.

Defined results: null text or role: empty; turns are ordered by number (null
first), then role, then text; repeated rows count as often as they stand; rows
with null conv_id make one conversation; other columns are ignored; no rows, no
output.  Only role ``assistant`` is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import load

BLOCK_TURNS = 256
# Fixed values of the template.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\0"), ("#", "\\1"), ("<", "\\2"), (":", "\\3")]
TARGET_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES[:4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def render(turns: DataFrame) -> DataFrame:
    """One row per block: conv_id, block, rendered, targets (start and reply of each
    assistant turn, in code points from the block's start), chars_before.

    Rows are gathered by conversation and block, never by conversation, so a very
    long conversation is spread; only block lengths meet in the running sum.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = F.array_sort(F.collect_list(turn))
    blocks = (
        turns.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"))
        .agg(sorted_turns.alias("turns"))
    )
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(HEAD), escape(t["role"], role=True), F.lit(COLON)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == TARGET_ROLE).alias("target")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("array()").cast("array<struct<start:bigint,reply:string>>").alias("found"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        found = F.when(p["target"], F.concat(acc["found"], F.array(F.struct(start.alias("start"), p["body"].alias("reply"))))).otherwise(acc["found"])
        return F.struct((start + F.length(p["body"]) + len(TAIL)).alias("at"), found.alias("found"))

    blocks = blocks.select("conv_id", "block", parts.alias("parts")).select(
        "conv_id", "block",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "").alias("rendered"),
        F.aggregate("parts", zero, step)["found"].alias("targets"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lengths = F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0))
    return blocks.withColumn("chars_before", lengths)


def expand(blocks: DataFrame) -> DataFrame:
    """One example per assistant turn: its reply (escaped, the only trainable part)
    and the number of code points of the rendering that are its context."""
    return blocks.select("conv_id", "block", "chars_before", F.explode("targets").alias("t")).select(
        "conv_id", "block", (F.col("chars_before") + F.col("t.start")).alias("context_chars"),
        F.length("t.reply").cast("bigint").alias("reply_chars"), F.col("t.reply").alias("reply"))


def materialise(blocks: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples with their context written out: conv_id, context, reply.  The output
    grows with the square of a conversation's length, as that is what is asked for."""
    whole = blocks.groupBy(F.col("conv_id").alias("conv")).agg(F.array_sort(F.collect_list(F.struct("block", "rendered"))).alias("b"))
    whole = whole.select("conv", F.array_join(F.transform("b", lambda x: x["rendered"]), "").alias("whole"))
    return examples.join(whole, F.col("conv").eqNullSafe(F.col("conv_id"))).select(
        "conv_id", F.expr("left(whole, cast(context_chars as int))").alias("context"), "reply")


def read_turns(rendered: Column) -> Column:
    """The turns in a rendering: array of (role, text), unescaped."""
    pieces = F.split(rendered, F.lit("</turn>\n"), -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p):
        at = F.instr(p, COLON)
        return F.struct(unescape(F.substring(p, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
                        unescape(F.substring(p, at + len(COLON), F.length(p))).alias("text"))

    return F.transform(whole, turn)


def digests(blocks: DataFrame) -> DataFrame:
    """What the output holds per conversation, read back from renderings and examples."""
    line = F.transform(read_turns(F.col("rendered")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    turns = blocks.select("conv_id", "block", F.size(line).alias("n"), F.array_join(line, "").alias("lines"), F.length("rendered").alias("chars"))
    joined = lambda c, *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: x[c]), "")
    turns = turns.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sha2(joined("lines", "block"), 256).alias("turns_sha256"),
        F.sum("chars").cast("bigint").alias("formatted_chars"))
    loss = expand(blocks).select("conv_id", "context_chars", unescape(F.col("reply")).alias("reply"))
    loss = loss.groupBy(F.col("conv_id").alias("conv")).agg(joined("reply", "context_chars").alias("loss"))
    loss_text = F.coalesce("loss", F.lit(""))
    return turns.join(loss, F.col("conv").eqNullSafe(F.col("conv_id")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss_text).cast("bigint").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars")


PROBE = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts imitate the template."""
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(render(load(spark, sf_dir, "conversations").unionByName(probe)))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
    length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS coded,
    length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS coded_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(said))::BIGINT AS loss_chars,
  sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(4 + length(role) + coded_role + 2 + length(text) + coded + 8)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
