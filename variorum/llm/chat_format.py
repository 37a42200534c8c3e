"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply is trainable.
Turns after the last reply, and conversations without a reply, make one more example without a trainable part, so that
the output holds every turn. A turn is written as <|im_start|>role, newline, text, <|im_end|>, newline. In texts and
roles each backslash is doubled and `<|` becomes `<\\|` (newlines of a role become `\\l`), so a control string inside a
text cannot be taken for a mark, and unescaping restores every character. DataFrame functions only.

Nulls and edge cases: a null text or role is empty; turns are ordered by turn, then role and text (null turns first);
repeated rows are turns of their own; a null conv_id is a conversation of its own; an empty table gives no rows.
The rows of one conversation are brought together, since an example holds all turns before its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def _replace(x, old: str, new: str):
    return F.replace(x, F.lit(old), F.lit(new))


def escape(x):
    return _replace(_replace(x, "\\", "\\\\"), "<|", "<\\|")


def unescape(x):
    return _replace(_replace(x, "<\\|", "<|"), "\\\\", "\\")


def escape_role(x):
    return _replace(escape(x), "\n", "\\l")


def unescape_role(x):
    """Pairs of backslashes are set apart first: what then remains of \\l and <\\| are escapes."""
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), lambda p: _replace(_replace(p, "<\\|", "<|"), "\\l", "\n")), "\\")


def format_chats(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """A row for each example: conv_id, example (from 1), n_turns, formatted, loss_start and loss_chars (code points of formatted, counted from 0; a null start: nothing is trainable)."""
    turns = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shaped = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))).alias("parts"),
        F.transform("turns", lambda t: t["role"] == role).alias("is_target"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("text_chars"),
    )
    targets = shaped.select(
        "*",
        F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("is_target", i) | (i == F.size("parts"))).alias("ends"),
    )
    rows = targets.select("conv_id", "parts", F.posexplode("ends").alias("k", "n"), "is_target", "text_chars")
    trainable = F.element_at("is_target", F.col("n"))
    out = rows.select(
        "conv_id",
        (F.col("k") + 1).alias("example"),
        F.col("n").cast("long").alias("n_turns"),
        F.array_join(F.slice("parts", 1, F.col("n")), "").alias("formatted"),
        trainable.alias("trainable"),
        F.element_at("text_chars", F.col("n")).alias("chars"),
    )
    tail = len(END) + 1
    return out.select(
        "conv_id", "example", "n_turns", "formatted",
        F.when(F.col("trainable"), F.length("formatted") - tail - F.col("chars")).cast("long").alias("loss_start"),
        F.when(F.col("trainable"), F.col("chars")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted):
    """The turns of a formatted text: array of (role, text)."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)

    def turn(x):
        end = F.length(x) - len(END) - 1
        at = F.instr(x, "\n")
        return F.struct(unescape_role(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(F.substring(x, at + 1, end - at)).alias("text"))

    return F.transform(marked, turn)


def read_loss(formatted, start, chars):
    """The text under the loss mask, unescaped; empty if nothing is trainable."""
    return F.when(start.isNull(), F.lit("")).otherwise(unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int"))))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """Read back from the examples: the longest example of a conversation holds all its turns."""
    sample = "<|im_end|><|im_start|>assistant ok"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, i AS turn, IF(i = 0, 'user', 'assistant') AS role, '' AS text FROM (SELECT explode(array(0L, 1L)) AS i)").withColumn("text", F.lit(sample))
    examples = format_chats(chats.unionByName(own))
    read = examples.select(
        "conv_id", "example", "n_turns", "formatted", F.length("formatted").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by("formatted", "example").alias("formatted"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(24 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
