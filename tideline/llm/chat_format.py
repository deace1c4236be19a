r"""Chat formatting with Spark expressions only (operator 7).

Template: every run of adjacent turns of one role is a block `<turn:ROLE>TEXT</turn>\n`; the texts
of a run are parted by `<merge/>`. Inside texts and roles the backslash and the control strings are
replaced by two-character codes, so a reader gets every turn back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, MERGE = "<turn:", "</turn>", "<merge/>"
#: Code of each escaped string; the backslash is coded first and decoded last.
CODES = (("\\", "\\b"), (OPEN, "\\o"), (CLOSE, "\\c"), (MERGE, "\\m"), (">", "\\g"))


def escaped(text: Column, role: bool = False) -> Column:
    """Text without control strings. Roles end at `>`, so there it is coded as well."""
    for plain, code in CODES if role else CODES[:4]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(CODES if role else CODES[:4]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> one row per conversation: conv_id, formatted, segments.

    `segments` is the loss mask: array<struct<text, loss>> whose texts in order make up `formatted`;
    loss is true for the texts of role `learn_from`. Turns are sorted by (turn, role, text), null
    turns first; repeated rows stay. Null roles and texts count as empty. Rows with a null conv_id
    form one conversation. An empty table gives an empty table; other columns are ignored. A
    conversation is one output row, so it must fit into a task.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select("conv_id", F.struct(
        "turn", "role", "text", escaped(F.col("role"), role=True).alias("mark"), escaped(F.col("text")).alias("safe")).alias("t"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast(packed.schema["turns"].dataType.elementType)), F.slice("turns", 1, F.size("turns") - 1))

    def pieces(t: Column, prev: Column) -> Column:
        opening = F.concat(F.lit(OPEN), t["mark"], F.lit(">"))
        mark = (F.when(prev.isNull(), opening).when(prev["role"] == t["role"], F.lit(MERGE))
                .otherwise(F.concat(F.lit(CLOSE + "\n"), opening)))
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")),
                       F.struct(t["safe"].alias("text"), (t["role"] == learn_from).alias("loss")))

    end = F.array(F.struct(F.lit(CLOSE + "\n").alias("text"), F.lit(False).alias("loss")))
    out = packed.select("conv_id", F.concat(F.flatten(F.zip_with("turns", before, pieces)), end).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The original turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.split(formatted, CLOSE + "\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def of(block: Column) -> Column:
        head = F.substring_index(block, ">", 1)
        role = unescaped(F.substring(head, len(OPEN) + 1, 1 << 30), role=True)
        body = F.substring(block, F.length(head) + 2, F.lit(1 << 30))
        return F.transform(F.split(body, MERGE, -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, of))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what reading the output back gives."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
