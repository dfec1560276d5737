"""Chat formatting checked by a grammar round trip. DataFrame functions only.

Grammar of a rendered conversation: turns one after another, each ``<|im_start|>`` role newline text
``<|im_end|>`` newline. The parser is deterministic: it cuts at start markers, then at the first newline and the
first end marker, and undoes escapes. A conversation is first rendered as it is, parsed back and compared with its
source turns. Turns that do not come back identical (their text or role holds control strings, or something
that reads like an escape) are rendered again with those strings escaped, and the conversation is parsed and
compared once more; a difference that remains stops the job. Ordinary text is thus never touched.

Escapes: a backslash goes in after the ``<`` of a marker (and of a marker that already has some, so undoing one
level restores any source). In a role, ``%``, line breaks and ``<`` become ``%25``, ``%0A`` and ``%3C``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_MARKER = r"<(\\*)\|(im_start|im_end)\|>"
_ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"
TURNS = "array<struct<role:string,text:string>>"
BLOCK = 256  # turns whose offsets are summed together
PIECE = 512  # characters of a piece when a mask is read; neither changes a result


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _MARKER, r"<\\$1|$2|>")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|$2|>")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def _raw_turns(formatted: Column) -> Column:
    """Array of struct<role, text> still escaped. The text before the first start marker is empty."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(
        F.substring_index(F.substring_index(p, "\n", 1), END, 1).alias("role"),
        F.substring_index(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2), END, 1).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of struct<role, text>, escapes undone."""
    return F.transform(_raw_turns(formatted), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape_text(t["text"]).alias("text")))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def loss_spans(formatted: Column, trained: str = "assistant") -> Column:
    """The loss mask: array of struct<start, end>, character offsets of the texts of ``trained`` turns.

    Offsets are summed inside blocks of ``BLOCK`` turns and then over the blocks, so that no array is copied once
    a turn.
    """
    fixed = len(START) + 1 + len(END) + 1
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def in_block(turns: Column) -> Column:
        return F.aggregate(
            turns, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
            lambda acc, t: F.struct(
                (acc["at"] + t["r"] + t["n"] + fixed).alias("at"),
                F.when(t["role"] == F.lit(trained), F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + len(START) + t["r"] + 1).cast("long").alias("start"),
                    (acc["at"] + len(START) + t["r"] + 1 + t["n"]).cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans")))

    def blocks(turns: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int")),
                           lambda b: in_block(F.slice(turns, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(done: Column) -> Column:
        starts = F.aggregate(done, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.flatten(F.transform(F.arrays_zip(done.alias("done"), starts.alias("at")), lambda z: F.coalesce(F.transform(
            z["done"]["spans"], lambda s: F.struct((s["start"] + z["at"]).alias("start"), (s["end"] + z["at"]).alias("end"))), none)))

    turns = F.transform(_raw_turns(formatted), lambda t: F.struct(
        t["role"].alias("role"), F.length(t["role"]).alias("r"), F.length(t["text"]).alias("n")))
    return _with(turns, lambda t: F.when(F.size(t) > 0, _with(blocks(t), joined)).otherwise(none))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under a loss mask, in order.

    The string is cut once into pieces of ``PIECE`` characters; a span joins the pieces it touches and trims both ends,
    so the work grows with the string and the spans, not with the spans' distance from the start.
    """
    def cut(both: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / PIECE).cast("int")
            last = F.floor((s["end"] - 1) / PIECE).cast("int")
            touched = F.array_join(F.slice(both["pieces"], first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return unescape_text(F.substr(touched, (s["start"] - first * PIECE + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        return F.transform(both["spans"], one)

    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _with(F.struct(pieces.alias("pieces"), spans.alias("spans")), cut)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 trained: str = "assistant") -> DataFrame:
    """One row per conversation: the id, ``formatted`` (string), ``loss_mask`` (array of struct<start, end>), ``n_escaped`` (turns).

    Turns are ordered by ``turn_col`` (nulls first), then role and text, so equal turn numbers have a defined
    order and repeated rows stay as turns of their own. A null role or text is empty; a null id is a conversation;
    other columns are ignored; no turns give no rows. A conversation is one output value, so its turns meet in
    one task, gathered map-side first.
    """
    col = lambda c: F.col(f"`{c}`")
    none = F.lit("")
    one = F.struct(col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), none).alias("role"),
                   F.coalesce(col(text_col).cast("string"), none).alias("text"))
    grouped = turns.groupBy(col(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(one)).alias("_all"))
    grouped = grouped.select(conv_col, F.transform("_all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("_source"))

    # round 1: every turn as it is; a turn alone is parsed like a conversation of one turn
    checked = grouped.withColumn("_turns", F.transform("_source", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"),
        F.coalesce(parse(render_turn(t["role"], t["text"])) == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False)).alias("same"))))
    # round 2: what did not come back is escaped, and the whole conversation is parsed again
    rendered = checked.withColumn("formatted", F.array_join(F.transform("_turns", lambda t: F.when(
        t["same"], render_turn(t["role"], t["text"])).otherwise(render_turn(escape_role(t["role"]), escape_text(t["text"])))), ""))
    same = parse(F.col("formatted")) == F.col("_source")
    rendered = rendered.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not come back from its rendered form"))))
    return rendered.select(conv_col, "formatted", loss_spans(F.col("formatted"), trained).alias("loss_mask"),
                           F.size(F.filter("_turns", lambda t: ~t["same"])).alias("n_escaped"))
