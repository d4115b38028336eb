"""Chat formatting of typed content parts, in DataFrame functions only.

A conversation's turns hold ordered parts: text, image, audio or document. A
visitor turns each part into a segment: text is escaped and written out, the
others become a placeholder such as ``<image:0>``, and the attachment's
reference and the number of tokens that it expands to are recorded in order.
The template is ``<turn:ROLE>`` + segments + ``</turn>`` + newline. Inside texts
and roles ``\\``, ``<`` and ``>`` are written ``\\\\``, ``\\l`` and ``\\g``, so a
control string can stand in a text without ever being read as one, and the text
comes back exactly. The loss mask covers what the assistant says: it is a list
of runs of characters, alternately without and with loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: Tokens that an attachment expands to: an image by patches of 28 x 28, audio
#: by 25 a second, a document by page; never less than one.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 600


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``. Neither < nor > is in an escaped text, so
    <0 to <2 can stand for the three marks in between."""
    for mark, code in (("\\\\", "<0"), ("\\l", "<1"), ("\\g", "<2")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    for code, plain in (("<2", ">"), ("<0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return F.replace(text, F.lit("<1"), F.lit("<"))


def visited(part: Column, place: Column) -> Column:
    """The segment of a part: written, attachment (null for text), tokens."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    one = F.lit(1).cast("long")
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    tokens = (
        F.when(kind == "image", F.greatest(one, F.coalesce(patches, one)))
        .when(kind == "audio", F.greatest(one, F.coalesce(F.ceil(part["seconds"] * AUDIO_RATE), one)))
        .when(kind == "document", F.greatest(one, F.coalesce(part["pages"] * F.lit(PAGE_TOKENS), one).cast("long")))
    )
    other = tokens.isNotNull()
    return F.struct(
        F.when(other, F.concat(F.lit("<"), kind, F.lit(":"), place.cast("string"), F.lit(">")))
        .otherwise(escaped(F.coalesce(part["text"], F.lit(""))))
        .alias("written"),
        F.when(other, F.struct(kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))).alias("attachment"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, parts) rows, one row out per conversation:
    conv_id, n_turns, formatted, loss_runs, attachments, attachment_tokens.

    Turns stand in order of ``turn``; ties by role and then text. Null role,
    parts or text count as empty, a part of unknown kind as its text. Rows with
    a null conv_id form one conversation. Placeholders are numbered through the
    conversation. Attachments keep that order. An empty table gives no rows.
    """
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    is_text = lambda p: ~F.coalesce(p["kind"], F.lit("text")).isin("image", "audio", "document")
    count = lambda t: F.size(F.filter(t["parts"], lambda p: ~is_text(p)))
    rows = rows.withColumn("counts", F.transform("turns", count))
    rows = rows.withColumn("many", F.exists("counts", lambda n: n > 0))
    # how many attachments stand before each turn; nothing to add up without any
    before = F.transform(
        "turns", lambda t, i: F.when(F.col("many"), F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0), lambda a, b: a + b)).otherwise(0)
    )
    rows = rows.withColumn("before", before)

    def segment(t: Column, i: Column) -> Column:
        place = lambda p, k: F.get("before", i) + F.size(F.filter(F.slice(t["parts"], F.lit(1), k), lambda x: ~is_text(x)))
        return F.struct(
            F.concat(F.lit("<turn:"), escaped(t["role"]), F.lit(">")).alias("head"),
            F.transform(t["parts"], lambda p, k: visited(p, place(p, k))).alias("segments"),
            (t["role"] == "assistant").alias("loss"),
        )

    rows = rows.withColumn("told", F.transform("turns", segment))
    rows = rows.withColumn(
        "told",
        F.transform(
            "told",
            lambda t: F.struct(
                t["head"].alias("head"),
                F.array_join(F.transform(t["segments"], lambda s: s["written"]), "").alias("body"),
                F.filter(F.transform(t["segments"], lambda s: s["attachment"]), lambda a: a.isNotNull()).alias("attachments"),
                t["loss"].alias("loss"),
            ),
        ),
    )
    runs = F.flatten(
        F.transform(
            "told",
            lambda t: F.array(
                F.char_length(t["head"]) + F.when(t["loss"], 0).otherwise(F.char_length(t["body"]) + len(END)),
                F.when(t["loss"], F.char_length(t["body"])).otherwise(0),
                F.when(t["loss"], len(END)).otherwise(0),
                F.lit(0),
            ),
        )
    )
    attachments = F.flatten(F.transform("told", lambda t: t["attachments"]))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("told", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        runs.alias("loss_runs"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def text_parts(text: Column) -> Column:
    """One text part."""
    fields = [F.lit("text"), text, *(F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int"))]
    names = ("kind", "text", "ref", "width", "height", "seconds", "pages")
    return F.array(F.struct(*(f.alias(n) for f, n in zip(fields, names, strict=True))))


def read_turns(formatted: Column) -> Column:
    """Role and unescaped text of each turn, read from a formatted conversation."""
    told = F.slice(F.split(formatted, "</turn>\n", -1), F.lit(1), F.size(F.split(formatted, "</turn>\n", -1)) - 1)
    return F.transform(
        told,
        lambda t: F.struct(
            unescaped(F.substring_index(F.substring(t, 7, 2**31 - 8), ">", 1)).alias("role"),
            unescaped(F.substring(t, F.locate(">", t) + 1, F.char_length(t))).alias("text"),
        ),
    )


def masked_texts(formatted: Column, loss_runs: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    Runs come in fours of one turn: without, with, without loss, and none.
    """
    ends = F.aggregate(
        loss_runs,
        F.array(F.lit(0)),
        lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)),
    )
    spans = F.arrays_zip(loss_runs.alias("n"), F.slice(ends, F.lit(1), F.size(loss_runs)).alias("at"))
    masked = F.filter(spans, lambda s, i: (i % 2 == 1) & (s["n"] > 0))
    return F.transform(masked, lambda s: unescaped(F.substring(formatted, s["at"] + 1, s["n"])))
