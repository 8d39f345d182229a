"""Text expressions; all are JVM-side Columns and null-safe (a null text is empty)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where lambdas use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(safe(c), r"(?U)^\s+|\s+$", "")


def compact(c: Column) -> Column:
    """Runs of white space as one space, stripped."""
    return F.btrim(F.regexp_replace(safe(c), r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(safe(c), F.lit(r"\S+"))


def tokens(c: Column) -> Column:
    """ASCII alphanumeric tokens, lower-cased."""
    return F.regexp_extract_all(F.lower(safe(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def token_ngrams(c: Column, size: int) -> Column:
    """Distinct token n-grams; none for shorter texts."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, F.lit(size)), " ")))
    return let(tokens(c), lambda t: F.when(F.size(t) >= size, grams(t)).otherwise(F.array().cast("array<string>")))


def window_hashes(c: Column, size: int) -> Column:
    """64-bit hashes of all token n-grams, in order, repeats included; none for shorter texts."""
    hashed = lambda t: F.transform(t, lambda x: F.xxhash64(x))
    rolled = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    return let(hashed(tokens(c)), lambda h: F.when(F.size(h) >= size, rolled(h)).otherwise(F.array().cast("array<bigint>")))


def containment(part: Column, whole: Column) -> Column:
    """Share of the part's n-grams that are in the whole; null for an empty part."""
    return F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0))


#: N-grams that are looked up in a text one by one; for more of them the text's own n-grams are formed.
FEW_GRAMS = 64


def gram_containment(part: Column, whole: Column, size: int) -> Column:
    """containment() of the token n-grams of two texts; those of the whole are formed only where the part has many."""
    spaced = F.concat(F.lit(" "), F.array_join(tokens(whole), " "), F.lit(" "))
    held = lambda g: let(spaced, lambda t: F.size(F.filter(g, lambda x: t.contains(F.concat(F.lit(" "), x, F.lit(" "))))))
    share = lambda g: F.when(F.size(g) <= FEW_GRAMS, held(g)).otherwise(F.size(F.array_intersect(g, token_ngrams(whole, size)))) / F.nullif(F.size(g), F.lit(0))
    return let(token_ngrams(part, size), share)


def split_facts(c: Column) -> Column:
    """Lines stripped of ' \\t-*', blank ones and a leading 'facts:' dropped, numbered F1, F2, ..."""
    lines = F.filter(F.transform(F.split(safe(c), r"\R"), lambda x: F.btrim(x, F.lit(" \t-*"))), lambda x: (x != "") & (F.lower(x) != "facts:"))
    return F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("F"), (i + 1).cast("string")).alias("fact_id"), x.alias("text")))


def normalize_answer(c: Column) -> Column:
    out = F.lower(compact(c))
    out = F.regexp_replace(out, "^final answer:", "")
    out = F.regexp_replace(F.btrim(out), "^answer:", "")
    return F.btrim(out, F.lit(" ."))


def split_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(safe(c), r"[\n;]+"), lambda x: F.btrim(x, F.lit(" -\t"))), lambda x: x != "")


def fact_count(c: Column) -> Column:
    """Distinct F-numbers, else sentences."""
    marks = F.array_distinct(F.regexp_extract_all(safe(c), F.lit(r"\b(F\d+)\b"), F.lit(1)))
    sentences = F.filter(F.split(safe(c), r"(?<=[.!?])\s+"), lambda x: F.btrim(x) != "")
    return F.when(F.size(marks) > 0, F.size(marks)).otherwise(F.size(sentences))


def tag_families(c: Column, families: Sequence[tuple[str, str]], default: str) -> Column:
    """Names whose pattern matches, in the order given; [default] if none does."""
    hits = F.array_compact(F.array(*[F.when(F.lower(safe(c)).rlike(p), F.lit(n)) for n, p in families]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def first_match(c: Column, ladder: Sequence[tuple[str, str]], default: str) -> Column:
    """The first name of a ladder whose pattern matches."""
    out = None
    for name, pattern in ladder:
        hit = F.lower(safe(c)).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def lookup_term(c: Column) -> Column:
    """Lower case, others than alphanumerics as one '_', a final 's' dropped from terms over four characters."""
    t = F.btrim(F.regexp_replace(F.lower(safe(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when((F.length(t) > 4) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


# fixed values: what is replaced in texts, in this order
PLACEHOLDERS = ((r"\bF[0-9]+\b", "[fact]"), (r"\bcase-[0-9]+\b", "[case]"), (r"[$€£] ?[0-9][0-9,.]*", "[amount]"), (r"[0-9]+(\.[0-9]+)? ?%", "[percent]"), (r"\b[0-9]{3,}\b", "[number]"))


def sanitize(c: Column, forbidden: Sequence[str] = (), patterns: Sequence[tuple[str, str]] = PLACEHOLDERS) -> Column:
    """Placeholders for forbidden terms, then for fact ids, case ids, money, percentages and long numbers, in this order."""
    out = safe(c)
    for term in forbidden:
        out = F.regexp_replace(out, rf"(?i)\Q{term}\E", "[entity]")
    for pattern, placeholder in patterns:
        out = F.regexp_replace(out, pattern, placeholder)
    return compact(out)


def truncate_words(c: Column, words: int = 180, chars: int = 1800) -> Column:
    """struct(text, truncated): the first words, then the first characters."""
    whole = F.btrim(F.regexp_replace(safe(c), r"\s+", " "))
    cut = F.rtrim(F.substring(F.array_join(F.slice(F.split(whole, " "), 1, words), " "), 1, chars))
    return F.struct(cut.alias("text"), (cut != whole).alias("truncated"))


def head_tail(c: Column, limit: int, head_only: bool = False, marker: str = "\n[...]\n") -> Column:
    """At most limit characters: the head, or three quarters head and one quarter tail around a marker."""
    t = safe(c)
    if head_only:
        return F.when(F.length(t) <= limit, t).otherwise(F.substring(t, 1, limit))
    room = limit - len(marker)
    head = room * 3 // 4
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(marker), F.right(t, F.lit(room - head))))


def snippet(c: Column, pattern: str, width: int) -> Column:
    """Text around the first match of a pattern; empty without a match."""
    t = compact(c)
    at = F.regexp_instr(t, F.lit(pattern))
    return F.when(at > 0, F.substring(t, F.greatest(at - width // 2, F.lit(1)), F.lit(width))).otherwise("")


def canonical_hash(*parts: Column) -> Column:
    """sha256 of the parts as a JSON list of strings and nulls, so that different parts never look alike."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def binary_label(c: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """'accepted' or 'rejected'; any other value raises."""
    v = F.lower(strip(c.cast("string")))
    return F.when(v.isin(*positive), "accepted").when(v.isin(*negative), "rejected").otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(v, F.lit("null")))))


def trailing_number(c: Column) -> Column:
    """The integer at the end of an id; 10**18 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(safe(c), r"(\d+)$", 1), F.lit("")).try_cast("long"), F.lit(10**18))


def fixed_bin(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins named '(a, b]', the first with its lower edge; 'nan' outside."""
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = ((c >= a) if k == 0 else (c > a)) & (c <= b)
        name = f"({a}, {b}]"
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("nan")
