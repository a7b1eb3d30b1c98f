r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all preceding
turns as context and only that reply trainable. DataFrame functions only.

A turn is written `### <role>: <text> </turn>` and a line end. Inside texts and roles every `\` becomes `\b`, `###`
becomes `\h` and `</turn>` becomes `\t`; inside roles `:` becomes `\c` as well. So a control string inside a text never
reads as one, and undoing the four in the order h, t, c, b gives the text back.

An example has the formatted text and the span of the reply (code points, end exclusive), which is the loss mask. Turns
after the last assistant turn, and conversations without one, come as one further example with an empty span, so that
the output holds every turn. Order is by turn, then role, then text; a null role or text counts as empty, null turns come
first and rows with a null conversation form one conversation. Repeated rows are repeated turns. Extra columns are ignored.
One conversation's text has to fit a Spark string, since an example is one string; examples of a conversation are made
one after the other and never held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END = "### ", ": ", " </turn>\n"
SLASH = "\\"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit(SLASH), F.lit("\\b"))
    out = F.replace(out, F.lit("###"), F.lit("\\h"))
    out = F.replace(out, F.lit("</turn>"), F.lit("\\t"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    out = text
    for code, plain in (("\\h", "###"), ("\\t", "</turn>"), ("\\c", ":"), ("\\b", SLASH)):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def prefix_targets(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """conv_id, example int (from 0), n_context int, formatted string, loss_start int, loss_end int: one row per example."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(HEAD), escape(by, True), F.lit(AFTER_ROLE))
    body = escape(said)
    line = F.struct(
        F.col(turn).alias("turn"), by.alias("role"), said.alias("text"),
        F.concat(head, body, F.lit(END)).alias("line"), F.length(head).alias("head_chars"), F.length(body).alias("body_chars"),
        (by == target).alias("is_target"),
    )
    turns = df.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(line)).alias("turns"))
    last = F.size("turns") - 1
    places = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["is_target"] | (i == last))
    each = turns.select("conv_id", "turns", F.posexplode(places).alias("example", "n_context"))
    own = F.get("turns", F.col("n_context"))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_context")), lambda t: t["line"]), "")
    each = each.select("conv_id", "example", "n_context", own.alias("own"), context.alias("context"))
    start = F.length("context") + F.col("own.head_chars")
    return each.select(
        "conv_id", "example", "n_context", F.concat("context", "own.line").alias("formatted"),
        F.when(F.col("own.is_target"), start).otherwise(0).alias("loss_start"),
        F.when(F.col("own.is_target"), start + F.col("own.body_chars")).otherwise(0).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> that a formatted text says."""
    lines = F.split(formatted, " </turn>\n")
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)

    def one(line: Column) -> Column:
        cut = F.call_function("locate", F.lit(AFTER_ROLE), line)
        return F.struct(unescape(F.substring(line, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)).alias("role"), unescape(F.substring(line, cut + len(AFTER_ROLE), F.length(line))).alias("text"))

    return F.transform(lines, one)


def digest(examples: DataFrame) -> DataFrame:
    """The contract's columns per conversation, read back from the examples' formatted texts and spans."""
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    by_conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = read_turns(F.col("whole"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by_conv = by_conv.select("conv_id", "formatted_chars", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    return by_conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE_SQL = r"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
    SELECT *, 15 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
              + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS chars
    FROM rows_
), prefixed AS (
    SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total
    FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR n = total THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM prefixed GROUP BY conv_id
"""
