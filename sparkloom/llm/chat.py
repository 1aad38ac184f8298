"""Chat formatting with a template whose output can always be read back.

Grammar of the output, one conversation a string::

    conversation = { turn }
    turn         = "<turn>" role "\n" text "</turn>\n"

A backslash in a role or text stands before a literal character. The parser
cuts at "</turn>\n", takes "<turn>" off, cuts the rest at the first newline
that no backslash precedes, and drops escaping backslashes. Text is first
rendered as it is; a turn that the parser does not give back is escaped; if a
whole conversation still differs from its source, all of its turns are.

Everything is made of SQL functions; a conversation is one row, as its output
is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


def _escape_text(text: Column) -> Column:
    """Backslashes are doubled and the closing mark is broken up."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("<\\/turn>"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape_text(role), F.lit("\n"), F.lit("\\\n"))


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def _body(piece: Column) -> Column:
    """A turn without its opening mark; the role ends at the first newline with no backslash before it."""
    return F.substr(piece, F.lit(len(OPEN) + 1))


ROLE = r"^([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n"


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != F.lit(""))

    def one(piece: Column) -> Column:
        body = _body(piece)
        role = F.regexp_extract(body, ROLE, 1)
        return F.struct(_unescape(role).alias("role"), _unescape(F.substr(body, F.length(role) + F.lit(2))).alias("text"))

    return F.transform(pieces, one)


def _same(parsed: Column, turns: Column) -> Column:
    return parsed == F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, n_turns, formatted.

    Turns go by turn, then role and text, so ties have one order; a null turn
    comes first. Null roles and texts count as empty, rows with a null conv_id
    form one conversation of their own, repeated rows are repeated turns, and
    an empty table gives no rows. Other columns are ignored.
    """
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    plain = lambda t: _render(t["role"], t["text"])
    escaped = lambda t: _render(_escape_role(t["role"]), _escape_text(t["text"]))
    back = lambda t: _same(parse(plain(t)), F.array(t))
    tried = turns.withColumn("tried", F.array_join(F.transform("turns", lambda t: F.when(back(t), plain(t)).otherwise(escaped(t))), ""))
    whole = F.array_join(F.transform("turns", escaped), "")
    formatted = F.when(_same(parse(F.col("tried")), F.col("turns")), F.col("tried")).otherwise(whole)
    return tried.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"))


def read_back(formatted: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id and formatted, with the turns, and the texts under the loss mask, that the parser finds in formatted."""
    parsed = formatted.withColumn("parsed", parse(F.col("formatted")))
    return parsed.withColumn("masked", F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == learn_from), lambda t: t["text"]), ""))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    out = read_back(format_conversations(rows.unionByName(extra)))
    lines = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A turn is escaped if a backslash stands before a character, or if it holds the closing mark and a newline; each backslash and each mark then takes one character more.
OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), f AS (
  SELECT *, 15 + length(role) + length(text) + CASE WHEN regexp_matches(text, '(?s)\\\\.') OR contains(text, '</turn>' || chr(10))
    THEN length(text) - length(replace(text, '\\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 ELSE 0 END AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
