"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is a list of typed parts; `typed_parts` reads them from a plain text, whose references of the form
![name](place) become image, audio or document parts by the place's ending. The visitor renders each part: text is
escaped, an image, audio or document part becomes a placeholder numbered by its place, and its reference and
expanded token count go to the attachment list in the same order. Turns are wrapped as

    <turn ROLE>\\nCONTENT</turn>\\n

Escapes (\\\\ for a backslash, \\l for <, and in roles \\g for > and \\n for a line feed) leave no `<` in a
text, so no text can contain a turn mark or a placeholder; `read_turns` undoes them and puts the attachments'
references back.

Edge cases: null and empty texts, roles, parts and references are empty; turns are ordered by (turn, role, text as
it was) with nulls first, so ties and repeated rows have one order; a row with a null conv_id is a conversation of
its own; a conversation is one row of the output, so it must fit in memory, and a very long text is one turn;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks of the template.
OPEN, SHUT, END = "<turn ", ">\n", "</turn>\n"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,millis:int,pages:int>"

#: Expanded tokens: an image has one for each patch of this many pixels a side, audio one each so many ms, a document so many a page.
PATCH, AUDIO_MS, PAGE_TOKENS = 28, 40, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Escaped backslashes are found from left to right; what stands between them has no other backslash pair."""

    def plain(x):
        return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n"))

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")).otherwise(text)


#: References in plain texts, and the endings of images and audio; anything else is a document.
REFERENCE = r"!\[[^\]\n]*\]\([^()\s]+\)"
IMAGE, AUDIO = r"(?i)\.(png|jpe?g|gif|webp|bmp)\)$", r"(?i)\.(wav|mp3|flac|ogg|m4a)\)$"
PLACEHOLDER = r"<\|[a-z]+ [0-9]+\|>"


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "int"), ("pages", "int"))))


def reference_part(ref: Column) -> Column:
    """An attachment of a plain text; its size is not known."""
    kind = F.when(ref.rlike(IMAGE), "image").when(ref.rlike(AUDIO), "audio").otherwise("document")
    return F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), *(F.lit(None).cast("int").alias(n) for n in ("width", "height", "millis", "pages")))


def typed_parts(text: Column) -> Column:
    """A plain text as its stretches of text and the references between them, in order."""
    stretches = F.transform(F.split(text, REFERENCE, -1), text_part)
    refs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 0), reference_part)
    both = F.flatten(F.zip_with(stretches, refs, lambda t, r: F.when(r.isNull(), F.array(t)).otherwise(F.array(t, r))))
    return F.when(F.contains(text, F.lit("](")), both).otherwise(F.array(text_part(text)))


def part_tokens(p: Column) -> Column:
    """Tokens that a placeholder expands to; one at least."""
    none = F.lit(0)
    image = F.ceil(F.coalesce(p["width"], none) / PATCH) * F.ceil(F.coalesce(p["height"], none) / PATCH)
    audio = F.ceil(F.coalesce(p["millis"], none) / AUDIO_MS)
    return F.greatest(F.lit(1), F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).otherwise(F.coalesce(p["pages"], none) * PAGE_TOKENS)).cast("long")


def visit(parts: Column) -> tuple[Column, Column]:
    """The rendered content and the attachments (place, kind, ref, tokens) of a list of parts; unknown types are read as documents."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    kind = lambda p: F.when(p["type"].isin("image", "audio"), p["type"]).otherwise(F.lit("document"))

    content = F.array_join(F.transform(parts, lambda p, i: F.when(is_text(p), escape(p["text"])).otherwise(F.concat(F.lit("<|"), kind(p), F.lit(" "), i.cast("string"), F.lit("|>")))), "")
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("place"), kind(p).alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), part_tokens(p).alias("tokens"), is_text(p).alias("plain")))
    attached = F.transform(F.filter(numbered, lambda a: ~a["plain"]), lambda a: F.struct(a["place"], a["kind"], a["ref"], a["tokens"]))
    return content, attached


def raw_text(parts: Column) -> Column:
    """What a list of parts was before it was rendered: texts as they are, attachments as their references."""
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(F.when(F.coalesce(p["type"], F.lit("text")) == "text", p["text"]).otherwise(p["ref"]), F.lit(""))), "")


def format_chats(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """conv_id, formatted, loss (turn, start and length in code points of each assistant content), attachments and expanded_tokens.

    turns has conv_id, turn, role and a column of typed parts."""
    content, attached = visit(F.col(parts))
    rows = turns.select("conv_id", "turn", "role", raw_text(F.col(parts)).alias("raw"), content.alias("content"), attached.alias("attached"))
    line = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(SHUT), F.col("content"), F.lit(END))
    rows = rows.withColumn("line", line).withColumn("chars", F.length("content").cast("long")).drop("content")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "raw")
    named = rows.where(F.col("conv_id").isNotNull()).withColumns({
        "place": F.row_number().over(order),
        "shut": F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    alone = rows.where(F.col("conv_id").isNull()).withColumns({"place": F.lit(1), "shut": F.length("line").cast("long")})
    start = F.col("shut") - len(END) - F.col("chars")
    loss = F.when(F.col("role") == "assistant", F.struct(F.col("place").alias("turn"), start.alias("start"), F.col("chars").alias("length")))
    turn = F.struct("place", "line", loss.alias("loss"), "attached")
    whole = named.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).unionAll(alone.select("conv_id", F.array(turn).alias("t")))
    attachments = F.flatten(F.transform("t", lambda t: F.transform(t["attached"], lambda a: F.struct(t["place"].alias("turn"), a["place"], a["kind"], a["ref"], a["tokens"]))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["line"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def restored(content: Column, turn: Column, attachments: Column | None) -> Column:
    """A rendered content as it was: unescaped, and the turn's references in place of the placeholders."""
    if attachments is None:
        return unescape(content)
    refs = F.transform(F.filter(attachments, lambda a: a["turn"] == turn), lambda a: a["ref"])
    pieces = F.split(content, PLACEHOLDER, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, refs, lambda p, r: F.array(unescape(F.coalesce(p, F.lit(""))), F.coalesce(r, F.lit(""))))), "")
    return F.when(F.contains(content, F.lit("<|")), whole).otherwise(unescape(content))


def read_turns(formatted: Column, attachments: Column | None = None) -> Column:
    """(role, text) of each turn, read from a formatted chat; without the attachments, placeholders stay as they are."""
    lines = F.split(formatted, F.lit(END), -1)

    return F.transform(
        F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda s, i: F.struct(
            unescape(F.substring(F.substring_index(s, SHUT, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            restored(F.regexp_replace(s, r"^[^>]*>\n", ""), i + 1, attachments).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss: Column, attachments: Column | None = None) -> Column:
    """All text under the loss mask, as it was, with nothing between."""
    return F.array_join(F.transform(loss, lambda x: restored(formatted.substr((x["start"] + 1).cast("int"), x["length"].cast("int")), x["turn"], attachments)), "")
