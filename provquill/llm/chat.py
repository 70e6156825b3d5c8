r"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that turn's text
under the loss mask.  A conversation that does not end with an assistant turn has one more example, all context
and nothing to train, so that no turn is missing from the output.  The template is
``<|role|>text<|end|>`` per turn; inside roles and texts ``\``, ``<`` and ``>`` are written ``\b``, ``\l`` and
``\g``, so no text can spell a control string, and the way back is exact.

An example repeats its context, so a conversation of n turns takes n * n / 2 turns of output; that is what this
method is for, and rows are exploded one by one, never gathered.  The turns of one conversation are gathered in
one row, as one text is.

Defined results: null texts and roles are empty; turns go by (turn, role, text), null turns first; repeated
turns are kept; an empty table gives an empty one; columns beside the four named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, materialize, table

END = "<|end|>"
TRAINED_ROLE = "assistant"
#: The probe conversation that the query adds: both turns spell control strings.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"

_ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(c: Column) -> Column:
    for raw, written in _ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for raw, written in reversed(_ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(raw))
    return c


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, is_last, text, loss_from, loss_to): spans are code points, end exclusive.

    example is the number of turns in the text; is_last marks the one that holds the whole conversation.
    """
    rows = bare(conversations, "conv_id", "turn", "role", "text").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = turns.withColumn("written", F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TRAINED_ROLE).alias("trained"))))
    ends = F.expr("filter(sequence(1, size(written)), k -> written[k - 1].trained OR k = size(written))")
    exploded = written.select("conv_id", "written", F.explode(ends).alias("example"))
    last = F.expr("written[example - 1]")
    context = F.expr(f"array_join(transform(slice(written, 1, example - 1), w -> concat(w.head, w.body, '{END}')), '')")
    parts = exploded.select("conv_id", "example", (F.col("example") == F.size("written")).alias("is_last"), context.alias("context"), last["head"].alias("head"), last["body"].alias("body"), last["trained"].alias("trained"))
    start = F.length("context") + F.length("head")
    return parts.select(
        "conv_id", "example", "is_last", F.concat("context", "head", "body", F.lit(END)).alias("text"),
        F.when(F.col("trained"), start).otherwise(start + F.length("body")).alias("loss_from"), (start + F.length("body")).alias("loss_to"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(text, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.split(F.substring(p, 3, 2147483647), r"\|>")[0]).alias("role"), unescape(F.split(p, r"\|>")[1]).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(text, start + 1, end - start))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation, read back from the formatted examples."""
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    given = bare(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    written = materialize(format_examples(given.unionByName(probe)), "chat-examples")
    read = written.select(
        "conv_id", "example", F.when(F.col("is_last"), read_turns(F.col("text"))).alias("turns"), F.length("text").cast("long").alias("chars"), read_loss(F.col("text"), F.col("loss_from"), F.col("loss_to")).alias("loss")
    ).select("conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"), F.col("turns").isNotNull().alias("whole"))
    per = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).alias("n_turns"),
        F.max(F.when(F.col("whole"), F.col("sha"))).alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(4 + 7 + length(role) + length(text) + (length(role) + length(text)) - length(regexp_replace(role || text, '[\\<>]', '', 'g')))
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS whole,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
