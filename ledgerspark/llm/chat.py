"""Chat formatting that reads back exactly, in DataFrame functions only.

Grammar: a conversation is turns; a turn is ``### role: body`` and a line
``</turn>``. Control strings are the turn's end and any head; one that a backslash
precedes is text, and reading takes one backslash off. Each turn is rendered, read
again and compared to its source; where they differ, its text gets one backslash
before every control string and is read again. A turn that still differs would be
an error, never a silent change. As turns are read independently of their
neighbours, a conversation reads back if its turns do. One escape is enough: it
leaves no control string without a backslash and adds exactly the one that reading
takes off, so a second round could change nothing.

Roles are percent-encoded in heads, so that any string can be one. Null roles and
texts count as empty. Turns are in order of turn, role and text (null turns
first); repeated rows are repeated turns. Rows without conv_id are one
conversation, the null one. An empty table gives no rows. Very long texts are formatted
whole; a conversation is one string, so its turns are gathered in one row. Other
columns are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
HEAD = r"### [A-Za-z0-9.*_+%-]*:"
CONTROL = rf"(?:{END}|{HEAD})"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def head(role: Column) -> Column:
    return F.concat(F.lit("### "), F.url_encode(role), F.lit(": "))


def rendered(role: Column, body: Column) -> Column:
    return F.concat(head(role), body, F.lit(f"\n{END}\n"))


def segments(formatted: Column) -> Column:
    """What stands before each end of a turn."""
    parts = F.split(formatted, rf"(?<!\\){END}\n?")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def turn_of(segment: Column) -> Column:
    """Role and text of one segment; null if it isn't one head and a body."""
    role = F.regexp_extract(segment, r"(?s)^### ([A-Za-z0-9.*_+%-]*): .*\n$", 1)
    body = F.regexp_extract(segment, r"(?s)^### [A-Za-z0-9.*_+%-]*: (.*)\n$", 1)
    sound = segment.rlike(r"(?s)^### [A-Za-z0-9.*_+%-]*: .*\n$") & ~body.rlike(rf"(?<!\\){HEAD}")
    return F.when(sound, F.struct(F.url_decode(role).alias("role"), unescaped(body).alias("text")))


def turns_of(formatted: Column) -> Column:
    return F.transform(segments(formatted), turn_of)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, and loss_mask, a list
    of (turn, start, length): the stretch of that turn's segment, in code points."""
    source = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    same = lambda piece: turns_of(piece) == F.array(F.struct("role", "text"))
    plain = rendered(F.col("role"), F.col("text"))
    tried = source.withColumn("body", F.when(F.coalesce(same(plain), F.lit(False)), F.col("text")).otherwise(escaped(F.col("text"))))
    checked = tried.withColumn("piece", rendered(F.col("role"), F.col("body"))).withColumn(
        "piece", F.when(F.coalesce(same(F.col("piece")), F.lit(False)), F.col("piece")).otherwise(F.raise_error(F.lit("a turn doesn't read back")))
    )
    row = F.struct("turn", "role", "text", "piece", F.length(head(F.col("role"))).alias("start"), F.length("body").alias("length"))
    gathered = checked.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    masked = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t.start.alias("start"), t.length.alias("length"), t.role.isin(*LEARNED).alias("learned"))),
        lambda t: t.learned,
    )
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        F.transform(masked, lambda t: t.dropFields("learned")).alias("loss_mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and learned texts, from the formatted text and the mask alone."""
    parts = chats.withColumn("parts", segments(F.col("formatted")))
    return parts.select(
        "conv_id",
        F.transform("parts", turn_of).alias("turns"),
        F.transform("loss_mask", lambda m: unescaped(F.substring(F.get("parts", m.turn), m.start + 1, m.length))).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
