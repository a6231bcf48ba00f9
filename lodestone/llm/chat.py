r"""Chat formatting with a grammar round trip, with DataFrame operations only.

A conversation is written as

    <|chat:L|>                                   L is the escape level, 0 or 1
    <|turn|>role<|text|>text<|end|>              for each turn

without anything between.  At level 0 roles and texts stand as they are; at level 1 a backslash goes before each
backslash and inside each `<|`, so that no role or text holds a control string.

The parser is deterministic and strict: the control strings of the whole must be the head and then turn, text, end for
each turn, with nothing between the head, an end and what follows.  A control string inside a role or text breaks that
order or, where a field spells out whole turns, makes other turns.  Conversations are rendered at level 0 and parsed
again; where the parser refuses them, or recovers other turns than the source's, or a field holds a control string, they
are rendered at level 1.  The last round trip is part of the result: `identical` is true for every conversation.

Turns are ordered by turn, then role, then text, nulls first; null roles and texts are empty; repeated rows are turns of
their own; each row with a null conv_id is a conversation of one turn, since nothing says that two of them belong
together; an empty table gives no rows.  A conversation is one value by its nature; what is gathered for it is its own
turns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, page_range, pages, running

HEAD, TURN, TEXT, END = "<|chat:{}|>", "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"<\|(?:chat:[0-9]+|turn|text|end)\|>"
LEVELS = 2
ROLE = "assistant"


def escaped(c: Column, level: int) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|")) if level else c


def unescaped(c: Column, level: Column) -> Column:
    return F.when(level == 0, c).otherwise(F.regexp_replace(c, r"(?s)\\(.)", "$1"))


def rendered(turns: Column, level: int) -> Column:
    """turns: array of (role, text)."""
    one = lambda t: F.concat(F.lit(TURN), escaped(t["role"], level), F.lit(TEXT), escaped(t["text"], level), F.lit(END))
    return F.concat(F.lit(HEAD.format(level)), F.array_join(F.transform(turns, one), ""))


def level_of(formatted: Column) -> Column:
    return F.substring(formatted, len(HEAD.format(0)) - 2, 1).cast("int")


def segments(formatted: Column) -> Column:
    """(role, text) of each turn, still escaped; null if the string is not of the grammar."""
    marks = F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0))

    def read(pieces: Column) -> Column:
        n = F.floor((F.size(pieces) - 2) / 3).cast("int")  # a piece before the head, one after it, three a turn
        heads = F.lit(HEAD.format(0)), F.lit(HEAD.format(1))
        order = F.repeat(F.lit(TURN + TEXT + END), n)
        ordered = let(F.array_join(marks, ""), lambda m: (m == F.concat(heads[0], order)) | (m == F.concat(heads[1], order)))
        number = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        bare = (F.get(pieces, 0) == "") & (F.get(pieces, 1) == "") & F.forall(number, lambda i: F.get(pieces, i * 3 + 1) == "")
        turns = F.transform(number, lambda i: F.struct(F.get(pieces, i * 3 - 1).alias("role"), F.get(pieces, i * 3).alias("text")))
        return F.when((F.size(pieces) == n * 3 + 2) & bare & ordered, turns)

    return let(F.split(formatted, CONTROL, -1), read)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text); null if it isn't of the grammar."""
    level = level_of(formatted)
    return F.transform(segments(formatted), lambda t: F.struct(unescaped(t["role"], level).alias("role"), unescaped(t["text"], level).alias("text")))


def with_spans(raw: Column) -> Column:
    """(role, start, length) in code points of each turn's escaped text in the formatted string."""
    marks = len(TURN) + len(TEXT) + len(END)
    sizes = F.transform(raw, lambda t: (F.length(t["role"]) + F.length(t["text"]) + marks).cast("long"))
    first = len(HEAD.format(0)) + len(TURN) + len(TEXT)

    def span(t: Column, before: Column) -> Column:
        return F.struct(t["role"].alias("role"), (before + first + F.length(t["role"])).alias("start"), F.length(t["text"]).cast("long").alias("length"))

    return F.zip_with(raw, running(sizes), span)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", role: str = ROLE) -> DataFrame:
    """conv_id, formatted, level, identical, and loss_spans: (start, length) of the escaped texts under the loss mask."""
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    number = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    named = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"), number.alias("alone"))
    source = named.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    source = source.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    tried = source.select("*", *[rendered(F.col("turns"), level).alias(f"try{level}") for level in range(LEVELS)])
    tried = tried.select("*", segments(F.col("try0")).alias("raw0"))
    plain = F.coalesce(F.col("raw0") == F.col("turns"), F.lit(False))
    made = tried.select("conv_id", "turns", F.when(plain, F.col("try0")).otherwise(F.col("try1")).alias("formatted"))
    made = made.select("*", segments(F.col("formatted")).alias("raw"), level_of(F.col("formatted")).alias("level"))
    back = F.transform("raw", lambda t: F.struct(unescaped(t["role"], F.col("level")).alias("role"), unescaped(t["text"], F.col("level")).alias("text")))
    wanted = F.filter(with_spans(F.col("raw")), lambda s: unescaped(s["role"], F.col("level")) == role)
    loss = F.transform(wanted, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return made.select("conv_id", "formatted", "level", F.coalesce(back == F.col("turns"), F.lit(False)).alias("identical"), loss.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold, from the strings and their loss spans alone."""
    text, level = F.col("formatted"), F.col("level")
    masked = let(pages(text), lambda cut: F.transform("loss_spans", lambda s: unescaped(page_range(cut, s["start"], s["start"] + s["length"]), level)))
    turns, loss = fresh(formatted.columns, "turns", "loss")
    read = formatted.select("conv_id", "identical", F.length(text).cast("long").alias("formatted_chars"), parsed(text).alias(turns), F.array_join(masked, "").alias(loss))
    line = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.col(loss).cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "identical",
    )
