r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts. A visitor flattens the parts in order: text, joined with the
text parts that follow it, is escaped and written as it is; an image, audio or document part becomes a placeholder (``<|image|>``,
``<|audio|>``, ``<|document|>``, ``<|attachment|>`` for any other type) and is recorded as an
attachment with its turn, part, reference and the number of tokens that it expands to.

Template: ``<s>[INST]role[/INST]content</s>`` per turn. Escaping is by stuffing: where ``<`` or
``[`` with any number of backslashes comes before the rest of a control string (``s>``, ``/s>``,
``|``, ``INST]``, ``/INST]``), one backslash is added; unescaping takes one away. So texts cannot
contain a control string, everything else stays as it is, and the texts can be read back exactly.

The loss mask is a list of spans of code points that cover the content of assistant turns.

Edge cases: null texts, roles and parts are empty; null parts of an array are skipped; turns are
ordered by turn (nulls first), then role and content, so repeated rows are turns of their own; a
null conv_id is a conversation; extra columns are left out; an empty table gives no rows. A
conversation is one string, so all its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TAIL = r"(?=/?s>|\||/?INST\])"
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + TAIL, "$1$2")


def expanded_tokens(part: Column, patch: int = 28, audio_rate: int = 25, page_tokens: int = 256) -> Column:
    """Tokens of an attachment: patches of an image, frames of audio, pages of a document, else 1."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / patch)
    return (
        F.when(part["type"] == "image", F.greatest(patches, F.lit(1)))
        .when(part["type"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate), F.lit(1)))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)) * page_tokens, F.lit(1)))
        .otherwise(F.lit(1))
        .cast("long")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(parts: Column) -> Column:
    """An array of parts as they stand in the formatted text.

    Neighbouring text parts are escaped as one text, so that a control string may not arise from
    two of them. (Before and after a placeholder none can: no tail begins with ``<``, and no head
    ends in ``>``.)
    """

    def shown(x: Column, first: Column, end: Column) -> Column:
        part = F.get(x, first)
        other = F.concat(F.lit("<|"), F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise("attachment"), F.lit("|>"))
        text = F.array_join(F.transform(F.slice(x, first + 1, end - first), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        return F.when(is_text(part), escape(text)).otherwise(other)

    def joined(x: Column) -> Column:
        place = F.transform(x, lambda p, i: F.struct(i.alias("i"), is_text(p).alias("t")))
        firsts = F.transform(F.filter(place, lambda p: ~(p["t"] & F.coalesce(F.get(place, p["i"] - 1)["t"], F.lit(False)))), lambda p: p["i"])
        return let(firsts, lambda f: F.array_join(F.transform(f, lambda a, k: shown(x, a, F.coalesce(F.get(f, k + 1), F.size(x)))), ""))

    return F.when(F.size(parts) == 0, "").otherwise(let(F.transform(parts, lambda p: p), joined))


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    fields = [F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")]
    return F.array(F.struct(*fields))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans, attachments of turns (conv_id, turn, role, parts).

    loss_spans: array of (turn number from 1, start, end), in code points of formatted.
    attachments: array of (turn number, part number from 1, type, ref, tokens), in order.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    shown = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    files = F.filter(F.transform("parts", lambda p, i: F.struct((i + 1).alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))), lambda x: F.coalesce(x["type"], F.lit("text")) != "text")
    shown = shown.select("conv_id", "turn", "role", visit(F.col("parts")).alias("body"), files.alias("files"))
    shown = shown.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    placed = shown.select(
        "conv_id",
        "files",
        F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
        (F.col("role") == "assistant").alias("loss"),
        F.row_number().over(order).alias("n"),
        F.length("body").cast("long").alias("size"),
        (F.sum((F.length("head") + F.length("body") + len(CLOSE)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("body") - len(CLOSE)).alias("start"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "segment", "loss", "start", "size", "files"))).alias("t"))
    return whole.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["n"].alias("turn"), x["start"].alias("start"), (x["start"] + x["size"]).alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: F.transform(x["files"], lambda f: F.struct(x["n"].alias("turn"), f["part"].alias("part"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text) and loss_text, parsed from the formatted string and the mask.

    A turn's piece is cut out of the formatted string at CLOSE, and a span, by its offsets, out of
    the piece: so a long conversation is not walked from its start for every span.
    """
    whole = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"
    pieces = formatted.withColumn("pieces", F.split("formatted", CLOSE))
    pieces = pieces.withColumn("pieces", F.slice("pieces", F.lit(1), F.size("pieces") - 1))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + len(CLOSE)).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    pieces = pieces.withColumn("starts", F.aggregate("pieces", begin, step, lambda a: a["out"]))
    turns = F.transform("pieces", lambda p: F.struct(unescape(F.regexp_extract(p, whole, 1)).alias("role"), unescape(F.regexp_extract(p, whole, 2)).alias("text")))
    cut_out = lambda s: F.substring(F.get("pieces", s["turn"] - 1), (s["start"] - F.get("starts", s["turn"] - 1) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    masked = F.transform("loss_spans", lambda s: unescape(cut_out(s)))
    return pieces.select(*formatted.columns, turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the contract, all from what was read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
