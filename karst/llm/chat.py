"""Chat formatting on DataFrame functions alone.

A visitor walks each turn's typed content parts and flattens them, in order:
text stays text (escaped), an image, audio or document part becomes a
placeholder and leaves an attachment record with its reference and the number
of tokens its placeholder stands for.  Turns are then laid out by a template:

    <|im_start|>ROLE<|im_sep|>BODY<|im_end|>\\n

Control strings all look like ``<`` any number of backslashes ``|``.  Inside
roles and texts one more backslash goes between, so no text can spell a control
string, and taking one away restores every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: The placeholder of each kind of part; a kind not listed gets the last one and counts no tokens.
PLACES = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", None: "<|unknown|>"}
#: Side of the image square that one token stands for, tokens for a second of audio and for a page.
IMAGE_SIDE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def text_part(c: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text"))).cast("array<struct<type:string,text:string>>")


def _visit(part: Column) -> Column:
    """What one part writes into the body."""
    place = F.lit(PLACES[None])
    for kind, mark in PLACES.items():
        if kind:
            place = F.when(part["type"] == kind, mark).otherwise(place)
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(place)


def _tokens(part: Column) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / IMAGE_SIDE)
    image = side(part["width"]) * side(part["height"])
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)
    pages = F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages).otherwise(0).cast("long")


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, parts).

    parts is an array of structs with ``type`` and ``text``, and with ref, width,
    height, seconds and pages where there are attachments (see ``PART``).
    Returned: conv_id, n_turns, formatted, segments (for each turn where its body
    starts and stops in formatted, in code points, and whether it bears loss), attachments (turn ordinal, part ordinal, type, ref, n_tokens) and
    n_attachment_tokens.

    Turns go by turn, then role, then body, nulls first; repeated rows stay.
    Null role and null text are empty, a null or empty list of parts is an empty
    body; rows of null conv_id are one conversation.  Other columns are left out.
    One shuffle by conv_id; offsets are running sums, so no step is quadratic in
    the turns of a conversation.
    """
    rich = "ref" in turns.schema["parts"].dataType.elementType.fieldNames()
    parts = F.coalesce(F.col("parts"), F.array().cast(turns.schema["parts"].dataType))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visit), "").alias("body"),
        (F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("n_tokens"))), lambda a: F.coalesce(a["type"], F.lit("")) != "text") if rich else F.array().cast("array<struct<part:int,type:string,ref:string,n_tokens:bigint>>")).alias("found"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("until", F.sum(F.length("head") + F.length("body") + len(END)).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    stop = F.col("until") - len(END)
    one = F.struct("n", "head", "body", (stop - F.length("body")).alias("start"), stop.alias("stop"), F.col("role").isin(*loss_roles).alias("loss"), "found")
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: F.transform(x["found"], lambda a: F.struct(x["n"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["loss"].alias("loss"))).alias("segments"),
        attachments.alias("attachments"),
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))


def _pieces(formatted: Column) -> Column:
    """What stands after each start of a turn."""
    quoted = START.replace("|", r"\|")
    return F.filter(F.split(formatted, quoted, -1), lambda p, i: i > 0)


def _body(piece: Column) -> Column:
    return F.substring_index(F.substring_index(piece, SEP, -1), END, 1)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, body), unescaped; placeholders stay as they are."""
    return F.transform(_pieces(formatted), lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(_body(p)).alias("text")))


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text of ``formatted`` under the loss mask, unescaped, nothing between.

    Bodies are cut out of the text itself, all in one pass; one that has not the length
    of its segment is an error.
    """
    wrong = F.raise_error(F.lit("a segment doesn't fit the formatted text"))
    cut = F.zip_with(F.transform(_pieces(formatted), _body), segments, lambda b, s: F.struct(b.alias("body"), s["loss"].alias("loss"), (F.length(b) == s["stop"] - s["start"]).alias("fits")))
    return F.array_join(F.transform(F.filter(cut, lambda x: x["loss"]), lambda x: F.when(x["fits"], unescape(x["body"])).otherwise(wrong)), "")
