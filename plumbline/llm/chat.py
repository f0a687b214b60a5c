"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (type, text, ref, units). A visitor over the array gives each part its text in the output:
text is escaped; an image, audio or document part becomes a placeholder with its number among the conversation's
attachments, and records its reference and the tokens the placeholder expands to. Numbers and places in the conversation are
running sums over its turns, in a window that streams; the turns' texts are then joined once, so time grows with the length of a
conversation, not its square. The ranges of the loss mask (assistant content) stand beside the text.

Template. A turn is ``<|turn:ROLE|>CONTENT<|end|>`` and a line end. Control strings begin with ``<|``, which escaping keeps out
of roles and texts: a backslash becomes two, and ``<|`` becomes ``<\\|`` (in roles ``|>`` also becomes ``|\\>``, and a part that begins with ``|`` gets a backslash before it). Dropping each backslash that stands before a character
undoes both. Placeholders are ``<|image:N|>``, ``<|audio:N|>`` and ``<|document:N|>``, N counting a conversation's attachments from 1.

Defined results: a null text or role is empty; turns go by (turn, role, text), nulls first, so ties have one order and repeated
rows stay; rows of a null conversation id form one conversation; a turn without parts is empty; a part of another type counts
as text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

PART = "struct<type:string,text:string,ref:string,units:bigint>"
#: Tokens that an attachment expands to, for each unit (an image's tiles, seconds of audio, pages of a document) and once.
EXPANSION = {"image": (256, 2), "audio": (25, 2), "document": (768, 2)}
END = "<|end|>\n"
#: Stands for an attachment's number until it is known; escaping keeps it out of texts, as all that begins with ``<|``.
MARK = "<|#"
#: Code points of the blocks that ranges are read from.
BLOCK = 1 << 14


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _part_text(part: Column) -> Column:
    """A part's text, escaped; a bar at its start too, which would end a control string's opening after a part that ends in ``<``."""
    text = F.coalesce(part["text"], F.lit(""))
    return F.concat(F.when(F.startswith(text, F.lit("|")), F.lit("\\")).otherwise(F.lit("")), escaped(text))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A text as an array of one part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("units")))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*EXPANSION), F.lit(False))


def _tokens(part: Column) -> Column:
    cost = F.lit(0).cast("bigint")
    for kind, (each, once) in EXPANSION.items():
        cost = F.when(part["type"] == kind, F.coalesce(part["units"], F.lit(1)) * each + once).otherwise(cost)
    return cost


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str | None = None, text: str = "text") -> DataFrame:
    """One row for each conversation: conv, ``formatted``, ``loss`` (ranges of code points, end exclusive, in order),
    ``attachments`` (number, type, ref, tokens, in order) and ``expanded_tokens`` (their sum).

    ``parts`` names a column of content parts; without it, ``text`` is each turn's only part. A conversation is one row of the
    result, so it must fit one task's memory as its formatted text does.
    """
    key = free_name(turns, "key")
    content = F.coalesce(F.col(f"`{parts}`").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")) if parts else text_part(F.col(f"`{text}`"))
    rows = turns.select(F.col(f"`{conv}`").alias(key), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    order = Window.partitionBy(key).orderBy("turn", "role", "parts")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # The visitor: each part's text, a placeholder with a mark where its number goes.
    def visited(part: Column) -> Column:
        return F.when(_is_attachment(part), F.concat(F.lit("<|"), part["type"], F.lit(":" + MARK + "|>"))).otherwise(_part_text(part))

    rows = rows.withColumn("refs", F.filter("parts", _is_attachment))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("before", F.sum(F.size("refs")).over(upto) - F.size("refs"))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", visited), ""))
    # Numbers go in where the text is cut at the marks: the k-th piece but the first follows the k-th number.
    numbered = F.array_join(F.transform(F.split("body", re.escape(MARK), -1), lambda x, k: F.when(k == 0, x).otherwise(F.concat((F.col("before") + k).cast("string"), x))), "")
    rows = rows.select(
        key,
        "place",
        (F.col("role") == "assistant").alias("learnt"),
        F.concat(F.lit("<|turn:"), F.replace(escaped(F.col("role")), F.lit("|>"), F.lit("|\\>")), F.lit("|>")).alias("head"),
        F.when(F.size("refs") > 0, numbered).otherwise(F.col("body")).alias("body"),
        F.transform("refs", lambda p, k: F.struct((F.col("before") + k + 1).cast("int").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("seen"),
    )
    chars = F.char_length("head") + F.char_length("body")
    ended = F.sum(chars + len(END)).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("ended", (ended - len(END)).cast("int"))
    one = F.struct("place", F.concat("head", "body", F.lit(END)).alias("text"), F.when(F.col("learnt"), F.struct((F.col("ended") - F.char_length("body")).alias("start"), F.col("ended").alias("end"))).alias("loss"), "seen")
    made = rows.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("turns")).select(
        F.col(key).alias(conv),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]).alias("loss"),
        F.flatten(F.transform("turns", lambda t: t["seen"])).alias("attachments"),
    )
    return made.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text), unescaped; attachments keep their placeholders."""
    pieces = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|turn:(.*?)\|>(?:.*?)<\|end\|>\n"), F.lit(0))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, r"(?s)^<\|turn:(.*?)\|>", 1)).alias("role"),
            unescaped(F.regexp_extract(p, r"(?s)^<\|turn:.*?\|>(.*)<\|end\|>\n$", 1)).alias("text"),
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, in order, with nothing between.

    Places count code points, which only a scan from a text's start finds: ranges are read from blocks, not from the whole text.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(formatted) - 1, F.lit(0)), F.lit(BLOCK))
    cut = F.transform(starts, lambda at: F.substr(formatted, at + 1, F.lit(BLOCK)))

    def piece(blocks: Column, s: Column) -> Column:
        first = F.floor(s["start"] / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(s["end"] / BLOCK).cast("int") - first + 1), "")
        return unescaped(F.substr(near, s["start"] - first * BLOCK + 1, s["end"] - s["start"]))

    # The blocks are an argument of a lambda, so that they are made once.
    return F.get(F.transform(F.array(cut), lambda blocks: F.array_join(F.transform(loss, lambda s: piece(blocks, s)), "")), 0)
