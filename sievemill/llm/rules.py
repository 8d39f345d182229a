r"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words are ``[^\x20\x09-\x0D]+``, case kept. Unigrams and bigrams are hashed to ``buckets`` (a power
of two); two multinomials are counted over them, one over all documents, one over the trusted
ones (labelled good and not toxic). Counting is one aggregation to at most ``buckets`` rows; the
counts are literal arrays of that size (a fixed bound).

Every document is judged by the others: its own n-grams are taken off the counts that it is part
of (leave one out), so that a labelled document is not judged by its own label. The trusted side
is smoothed towards the raw one, ``prior`` raw counts a bucket on both: with t and r the others'
counts of a bucket and s their trusted share of all n-grams, the log ratio of a bucket is
log((t + prior * s) / (s * (r + prior))), 0 where the others know nothing. A document's ratio is the mean
over its n-grams. It is kept if it has not failed a base rule and its ratio reaches a bound that the
trusted documents that have not failed set, who are judged by the others too: their median less
``margin`` times its distance to their quantile ``lowest``. Both are exact, of ratios rounded to four digits,
so that the aggregation holds few values at any size.

Word windows are compared by 64-bit hashes of their eight words. Edge cases: a null or empty
text has no words, ratio 0, and fails; repeated rows are counted and judged as often as they stand
there; null doc_ids have no label; without other trusted documents ratios are 0; extra columns are
left out; without trusted documents the bound is 0; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

SPACE = r"[\x20\x09-\x0D]+"
RUN = 8
BUCKETS = 1 << 14
#: Raw counts that both sides have of every bucket beforehand. At 10 the bias against rare words is under 0.01 nats.
PRIOR = 10
#: The bound lies MARGIN times as far below the median ratio of the trusted documents that pass the base rules as their
#: quantile LOWEST does: the lowest of a sample is not the lowest of all, the less so the smaller the sample.
LOWEST, MARGIN = 0.003, 1.25


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def hashed(w: Column) -> Column:
    """32-bit hashes of an array's words."""
    return F.transform(w, lambda x: F.hash(x))


def ngrams(h: Column) -> Column:
    """Hashes of the unigrams and bigrams of hashed words."""
    return F.concat(h, F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.hash(x, F.get(h, i + 1))))


def repeated_words(w: Column, h: Column) -> Column:
    """Words in windows of RUN words that the array has twice or more; h: hashed(w).

    A window that is found again repeats RUN - 3 runs of four words, so texts in which fewer are
    repeated have none, and only the others' windows are looked at.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(starts)), F.lit(0), lambda a, i: a + F.coalesce(F.least(F.get(starts, i) - F.get(starts, i - 1), F.lit(RUN)), F.lit(RUN)))

    def repeats(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        starts = let(order, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(starts, covered))

    fours = F.transform(h, lambda x, i: F.hash(x, *[F.get(h, i + k) for k in (1, 2, 3)]))
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - RUN + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(RUN))))
    some = let(fours, lambda f: F.size(f) - F.size(F.array_distinct(f)) >= RUN - 3)
    return F.when(F.size(w) <= RUN, 0).when(some, let(hashes, repeats)).otherwise(0)


def bucket(ngram: Column, buckets: int) -> Column:
    """buckets: a power of two."""
    return ngram.bitwiseAND(F.lit(buckets - 1))


def marked(docs: DataFrame, labels: DataFrame, max_broadcast_labels: int = 1 << 22) -> DataFrame:
    """doc_id, text (null: empty), trusted of docs."""
    good = labels.where("quality = 1 and (toxic is null or toxic = 0) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = F.broadcast(good) if good.count() <= max_broadcast_labels else good
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(good.withColumn("trusted", F.lit(1)), "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(0)).alias("trusted"))


def counted(rows: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Raw and trusted counts by bucket."""
    grams = rows.select("trusted", F.explode(let(let(words(F.col("text")), hashed), ngrams)).alias("ngram")).select("trusted", bucket(F.col("ngram"), buckets).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("trusted"))
    raw, trusted = [0] * buckets, [0] * buckets
    for r in counts.collect():  # at most one row a bucket
        raw[r["b"]], trusted[r["b"]] = r["raw"], r["trusted"]
    return raw, trusted


def ratio(g: Column, own_trusted: Column, raw: list[int], trusted: list[int], prior: float) -> Column:
    """Mean log ratio of sorted buckets g of a text that is (own_trusted: 1) among the trusted ones or not (0)."""
    n_raw, n_trusted = sum(raw), sum(trusted)
    raw_of, trusted_of = (F.from_json(F.lit(json.dumps(x)), "array<bigint>") for x in (raw, trusted))  # folded to literals once
    n = F.size(g).cast("double")
    share = (F.lit(n_trusted) - n * own_trusted) / (F.lit(n_raw) - n)

    def summed(first: Column, share: Column) -> Column:
        def step(total: Column, k: Column) -> Column:
            b = F.get(g, F.get(first, k))
            own = F.coalesce(F.get(first, k + 1), F.size(g)) - F.get(first, k)
            return total + own * (F.log(F.get(trusted_of, b) - own * own_trusted + F.lit(prior) * share) - F.log(F.get(raw_of, b) - own + F.lit(prior)))

        return F.aggregate(F.sequence(F.lit(0), F.size(first) - 1), F.lit(0.0), step)

    firsts = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))
    known = (F.size(g) > 0) & (n < n_raw) & (n * own_trusted < n_trusted)
    return F.when(known, let(F.struct(firsts.alias("f"), share.alias("s")), lambda x: summed(x["f"], x["s"]) / n - F.log(x["s"]))).otherwise(0.0)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, lowest: float = LOWEST, margin: float = MARGIN) -> DataFrame:
    """The columns of the contract, and ratio and least_ratio."""
    rows = marked(docs, labels)
    raw, trusted = counted(rows, buckets)
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    # one expression: were the arrays columns, a filter on the result would be pushed below them and make them anew for every element
    def measured(w: Column, h: Column) -> Column:
        grams = F.sort_array(F.transform(ngrams(h), lambda x: bucket(x, buckets)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w, h).cast("long").alias("n_repeat_words"),
            let(grams, lambda g: ratio(g, F.col("trusted"), raw, trusted, prior)).alias("ratio"),
        )

    rows = rows.select(
        "doc_id",
        "trusted",
        let(words(F.col("text")), lambda w: let(hashed(w), lambda h: measured(w, h))).alias("m"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "trusted", "m.*", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # written, as the bound needs all ratios before any verdict
    rows = cut(rows.withColumn("base_failed", failed))
    low, middle = rows.where("trusted = 1 and not base_failed").agg(*[F.percentile(F.round("ratio", 4), F.lit(q)) for q in (lowest, 0.5)]).first()
    rows = rows.withColumn("least_ratio", F.lit(0.0 if low is None else middle - margin * (middle - low)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.col("least_ratio")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "least_ratio")
