r"""How five filters act together: what each removes in every order of application.

The filters (letters are those of the contract): A short, B repetitive, C shouting, D marked up, E
a copy of an earlier document. Words are counted relationally: texts are dealt by their row's
identity, exploded to words, aggregated by (row, word) and then by row for totals and
distincts; as both aggregations group by what the rows are dealt by, nothing but the texts is
shuffled. The other flags come from a second scan and are outer-joined, so that texts without a
word are there too.

Rows are then aggregated by text digest, source and labels before anything else, so a text with
any number of copies is a few rows: the least doc_id of a text, and which of its rows are not
copies, are found between those. What is left of a part (a source) are the counts of its 32
combinations of failed filters (conditional counts, combined in the tasks first): every order and
step follows from them by arithmetic.

Digests are md5 (128 bits) of the text. Edge cases: null texts are empty, null sources are the
empty string; equal rows (doc_id, source and text) each count, and none of them is a copy of
another, as their doc_ids are equal; a null doc_id has no label, is no copy and makes no other one;
of several label rows of a document any 1 counts; extra columns are left out; an empty table gives
no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the contract
FILTERS = "ABCDE"
SPACE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
MASKS = range(1 << len(FILTERS))
KEY = ["doc_id", "part", "digest"]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and text: the first three tell rows apart that are not equal."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """KEY, words, distinct_words of rows with a word; equal rows are counted together."""
    words = rows.repartition(*KEY).select(*KEY, F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    by_word = words.groupBy(*KEY, "word").agg(F.count(F.lit(1)).alias("times"))
    return by_word.groupBy(*KEY).agg(F.sum("times").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def failures(docs: DataFrame) -> DataFrame:
    """KEY, copies (equal rows) and the flags A to D."""
    rows = identified(docs)
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = rows.select(*KEY, (100 * upper > MAX_UPPER * F.length("text")).alias("C"), F.col("text").rlike(MARKS).alias("D"))
    flags = flags.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("C").alias("C"), F.first("D").alias("D"))
    words = word_counts(rows).withColumnsRenamed({c: f"w_{c}" for c in KEY})
    same = [flags[c].eqNullSafe(words[f"w_{c}"]) for c in KEY]
    n = F.coalesce(F.expr("words div copies"), F.lit(0))
    distinct = F.coalesce("distinct_words", F.lit(0))
    return flags.join(words, same, "left").select(*KEY, "copies", (n < MIN_WORDS).alias("A"), (100 * distinct < MIN_DISTINCT * n).alias("B"), "C", "D")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1)."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    # rows without an id match nothing; their digests deal them over the tasks
    rows = rows.withColumn("lone", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    marked = rows.join(marks.withColumn("lone", F.lit(0).cast("long")), ["doc_id", "lone"], "left").drop("lone")
    return marked.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, of its documents, the arrays n, good and toxic: counts by combination of failed filters (bit i: FILTERS[i])."""
    bits = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS[:4])), F.lit(0))
    rows = labelled(failures(docs), labels).withColumn("bits", bits)
    # copies of a text are few rows from here on: a row a part and label, with the rows of its least doc_id
    texts = rows.groupBy("digest", "part", "good", "toxic", "bits", F.col("doc_id").isNull().alias("lone")).agg(F.sum("copies").alias("n"), F.min(F.struct("doc_id", "copies")).alias("first"))
    least = texts.where("not lone").groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    passes = F.when(F.col("lone"), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.copies")).otherwise(0)
    halves = F.array(F.struct(F.col("bits").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("bits") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    cells = texts.join(least, "digest", "left").withColumn("passes", passes).select("part", "good", "toxic", F.inline(halves))
    value = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    counts = [F.sum(F.when(F.col("mask") == m, v).otherwise(0)).alias(f"{k}{m}") for k, v in value.items() for m in MASKS]
    return cells.groupBy("part").agg(*counts).select("part", *[F.array(*[F.col(f"{k}{m}") for m in MASKS]).alias(k) for k in value])


def total(counts: Column, of) -> Column:
    """The sum over masks m of counts[m] * of(m)."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS[-1])), F.lit(0).cast("long"), lambda t, m: t + F.get(counts, m) * of(m))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of the contract, for all orders and steps."""
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    rows = combinations(docs, labels).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    letters = F.split(F.substring("filter_order", 1, F.col("step") - 1), "")
    before = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda t, x: t + bit(x))
    rows = rows.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)
    own, before = F.col("own"), F.col("before")
    fails = lambda m, of: m.bitwiseAND(of) != 0
    one = lambda test: F.when(test, 1).otherwise(0)
    here = lambda m: one(fails(m, own) & ~fails(m, before))
    # a failing filter comes first among the |m| that fail in one of |m| orders
    turns = len(list(itertools.permutations(FILTERS)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(F.col("n"), lambda m: one(~fails(m, own + before))).alias("kept"),
        total(F.col("n"), here).alias("removed"),
        total(F.col("n"), lambda m: one(fails(m, own) & fails(m, before))).alias("redundant"),
        total(F.col("n"), lambda m: one(m == own)).alias("unique_fails"),
        total(F.col("good"), here).alias("good_lost"),
        total(F.col("toxic"), here).alias("toxic_lost"),
        total(F.col("n"), lambda m: F.when(fails(m, own), (F.lit(turns) / F.bit_count(m)).cast("int")).otherwise(0)).alias("shapley"),
    )
