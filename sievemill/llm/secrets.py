r"""Secret scan in DataFrame functions only: patterns, and sliding-window entropy of candidates.

Base spans (contract): assign, access and hex matches, leftmost and non-overlapping per kind.
The method adds spans of kind ``entropy``: runs of at least ``WINDOW`` characters of
``[A-Za-z0-9+/_-]`` (and closing ``=``) whose Shannon entropy, over some window of ``WINDOW``
characters, reaches the threshold of the run's character class (hex, letters only, mixed). The
entropy of each next window follows from the last by the counts of the character that enters and
the one that leaves. Runs on the allow-list are not reported: digits only, words joined by
separators, UUIDs, placeholders; nor are runs that overlap a base span.

Positions come from split() around the same matches: a match starts after all pieces and matches
before it. Running sums and extremes of arrays are made in blocks (``running``), so that a text of
many matches costs little more than in proportion; counts of a window are five bits each in six
longs. Only texts that a plain search finds worthwhile are taken apart.

Edge cases: a null or empty text has no spans; repeated rows are scanned alike; a null doc_id is
kept; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# fixed values of the contract
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Least entropy in bits of a window of 20 (at most 4.32; 4.0 for hex digits).
THRESHOLDS = {"hex": 3.0, "letters": 4.1, "mixed": 3.7}
ALLOWED = r"(?i)^[0-9]+$|^[a-z]+([-_/+][a-z]+)+=*$|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|placeholder|x{8}|^(.)\2+$"


def running(x: Column, op, block: int = 128) -> Column:
    """The running op (associative) of an array, first element included: within blocks, then over the blocks' last values."""

    def plain(v: Column) -> Column:
        return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1), lambda a, e: F.array_append(a, op(F.element_at(a, -1), e)))

    def joined(parts: Column) -> Column:
        before = plain(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(before, lambda t: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: op(F.get(t, i - 1), v))))))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: plain(F.slice(v, i * block + 1, F.lit(block))))
    return F.when(F.size(x) == 0, x).otherwise(let(x, lambda v: let(blocks(v), joined)))


def spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans (start, rank, end) of the pattern's matches that keep(match, its group 2 or itself) accepts."""
    group = 2 if kind == "assign" else 0
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"), F.split(text, pattern).alias("p"))
    rank = F.lit(KINDS.index(kind))

    def placed(f: Column) -> Column:
        ends = running(F.transform(f["m"], lambda m, k: F.length(F.get(f["p"], k)) + F.length(m)), lambda a, b: a + b)
        one = lambda e, k: F.struct((e - F.length(F.get(f["m"], k))).alias("start"), rank.alias("rank"), e.alias("end"), keep(F.get(f["m"], k), F.get(f["v"], k)).alias("keep"))
        return F.transform(F.filter(F.transform(ends, one), lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.coalesce(let(found, lambda f: F.when(F.size(f["m"]) > 0, placed(f)).otherwise(none)), none)


#: By ASCII code of the characters of CANDIDATE: which long holds the count, and at which bit.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
LONGS = 6
PLACE = [(ALPHABET.index(chr(c)) // 12, ALPHABET.index(chr(c)) % 12 * 5) if chr(c) in ALPHABET else (0, 0) for c in range(128)]


def window_entropy(text: Column) -> Column:
    """The highest Shannon entropy of a window of WINDOW characters of a CANDIDATE; 0 if it is shorter."""
    xlog = F.array(*[F.lit(n * math.log2(n) if n > 1 else 0.0) for n in range(WINDOW + 2)])
    field, shift = (F.array(*[F.lit(p[k]) for p in PLACE]) for k in (0, 1))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["s"])

    def step(acc: Column, k: Column, chars: Column) -> Column:
        enters, leaves = F.get(chars, k), F.get(chars, k - WINDOW)
        full, same = k >= WINDOW, F.coalesce(F.get(chars, k) == F.get(chars, k - WINDOW), F.lit(False))
        count = lambda x: F.call_function("shiftright", F.get(acc["counts"], x["f"]), x["s"]).bitwiseAND(F.lit(31)).cast("int")
        gained = F.get(xlog, count(enters) + 1) - F.get(xlog, count(enters))
        lost = F.when(full, F.get(xlog, count(leaves) - 1) - F.get(xlog, count(leaves))).otherwise(0.0)
        total = acc["s"] + F.when(same, 0.0).otherwise(gained + lost)
        moved = F.transform(acc["counts"], lambda n, i: n + F.when(i == enters["f"], one(enters)).otherwise(0) - F.when(full & (i == leaves["f"]), one(leaves)).otherwise(0))
        best = F.when(k >= WINDOW - 1, F.greatest(acc["best"], F.lit(math.log2(WINDOW)) - total / WINDOW)).otherwise(acc["best"])
        return F.struct(F.when(same, acc["counts"]).otherwise(moved).alias("counts"), total.alias("s"), best.alias("best"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    chars = F.transform(F.split(text, ""), lambda c: F.struct(F.get(field, F.ascii(c)).alias("f"), F.get(shift, F.ascii(c)).alias("s")))
    return F.when(F.length(text) < WINDOW, 0.0).otherwise(let(chars, lambda c: F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), start, lambda a, k: step(a, k, c), lambda a: a["best"])))


def apart(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span; both sorted by start."""

    def sifted(all_: Column) -> Column:
        """all_: (start, kind, end, rank) in order; kind 0: base."""
        ended = running(F.transform(all_, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        begun = running(F.transform(F.reverse(all_), lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(1 << 30)), lambda a, b: F.least(a, b))
        free = lambda e: F.filter(F.transform(all_, lambda x, i: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), ((x["kind"] == 1) & (F.get(e["ended"], i) <= x["start"]) & (F.get(e["begun"], F.size(all_) - 1 - i) >= x["end"])).alias("free"))), lambda x: x["free"])
        return let(F.struct(ended.alias("ended"), begun.alias("begun")), lambda e: F.transform(free(e), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))))

    marked = lambda x, kind: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["rank"].alias("rank")))
    return F.when((F.size(candidates) == 0) | (F.size(base) == 0), candidates).otherwise(let(F.array_sort(F.concat(marked(base, 0), marked(candidates, 1))), sifted))


def suspicious(run: Column) -> Column:
    threshold = F.when(run.rlike("^[0-9a-fA-F]+=*$"), THRESHOLDS["hex"]).when(run.rlike("^[A-Za-z]+=*$"), THRESHOLDS["letters"]).otherwise(THRESHOLDS["mixed"])
    return F.when(run.rlike(ALLOWED), False).otherwise(window_entropy(run) >= threshold)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (start, rank, end), in order; rank is the kind's place in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    guarded = lambda test, value: F.when(test, value).otherwise(none)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = docs.select(
        "doc_id",
        guarded(F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)"), spans(F.col("text"), ASSIGN, "assign", lambda m, v: F.length(v) >= 8)).alias("assign"),
        guarded(F.contains("text", F.lit("AKIA")), spans(F.col("text"), ACCESS, "access", lambda m, v: F.length(m) >= 16)).alias("access"),
        # runs are maximal either way, so the length may be a part of the pattern
        guarded(F.col("text").rlike(r"[0-9a-f]{32}"), spans(F.col("text"), r"[0-9a-f]{32,}", "hex", lambda m, v: F.lit(True))).alias("hex"),
        guarded(F.col("text").rlike(r"[A-Za-z0-9+/_-]{20}"), spans(F.col("text"), CANDIDATE, "entropy", lambda m, v: suspicious(m))).alias("candidates"),
    )
    base = parts.select("doc_id", "assign", "access", "hex", "candidates", F.concat("assign", "access", "hex").alias("base"))
    extra = apart(F.col("candidates"), F.col("base"))
    return base.select("doc_id", "assign", "access", "hex", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", extra)).alias("found"))


def written(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """The columns of the contract, and n_entropy."""
    size = lambda c: F.size(c).cast("long")
    return find_secrets(docs).select(
        "doc_id",
        size("assign").alias("n_assign"),
        size("access").alias("n_access"),
        size("hex").alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_entropy"),
    )
