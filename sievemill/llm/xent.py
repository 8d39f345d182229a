"""LM scoring by cross-entropy difference of matched target and background n-gram models.

Both models are interpolated n-gram models of order ``N`` over one vocabulary, the 256 byte
values of UTF-8 (ASCII-lower-cased) with a start symbol, so every text is covered and no token
is unknown. The background counts all documents, the target the labelled good ones. They are
matched: the background's counts are scaled to the target's size, and both lend the same mass to
the shorter context, as many counts as the context has followers in the corpus (Witten-Bell's
number, shared). A document's score is the mean over its bytes of log2 p_target -
log2 p_background (the loss under the background less the loss under the target): higher is more
like the target.

No document is scored by counts of its own: documents are dealt to ``FOLDS`` folds by a hash of
doc_id, and a fold is scored by the counts of all others. So a document of the target has no
advantage over one that was not labelled, and one whose text stands elsewhere too is known to the
background (if in another fold).

Counting is one pass: tasks count the packed n-grams (an int64 holds them exactly, there are no
hash collisions) of their own documents by fold, an aggregation adds them up, and the conditional
probabilities follow by joins of the n-grams with their contexts and suffixes. Every n-gram of a
document has been counted, so scoring looks up one table of score differences by n-gram and fold. It is
broadcast while it has at most ``broadcast_ngrams`` rows (24 bytes each); beyond that, documents
are joined with it by their distinct n-grams.

Edge cases: null and empty texts have no tokens and score 0.0; repeated rows count and score as
often as they stand there; without a target document in the other folds scores are 0.0; a null doc_id has no
label; labels may repeat; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, release
from .textvec import LOWER, buffers, chunks

N = 5
FOLDS = 4
#: Distinct n-grams a task gathers before it passes them on.
FLUSH = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The packed n-gram that ends at each byte: bytes + 1, nine bits each, 0 before a text's start."""
    x = LOWER[data].astype(np.int64) + 1
    out = x.copy()
    since = np.arange(len(x)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, N):
        back = np.zeros_like(x)
        back[k:] = x[:-k]
        back[since < k] = 0
        out |= back << (9 * k)
    return out


def count_ngrams(docs: DataFrame) -> DataFrame:
    """g and, by fold, background_f, target_f: occurrences of each n-gram in docs (text, fold, trusted)."""
    bits = 9 * N

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

        def batch(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k & ((1 << bits) - 1)), pa.array(k >> bits), pa.array(n)], ["g", "part", "n"])

        for b in batches:
            data, offsets = buffers(b.column(0))
            part = 2 * b.column(1).to_numpy() + b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, x, o in chunks(data, offsets):
                if not len(x):
                    continue
                u, n = np.unique(grams(x, o) | np.repeat(part[i:j], np.diff(o)) << bits, return_counts=True)
                keys.append(u)
                counts.append(n)
                held += len(u)
                if held > FLUSH:
                    k, n = merged()
                    if len(k) > FLUSH // 2:
                        yield batch(k, n)
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [n], len(k)
        if keys:
            yield batch(*merged())

    found = map_arrow(docs.select("text", F.col("fold").cast("long"), "trusted"), run, "g long, part long, n long")
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return found.groupBy("g").agg(*[of(F.expr(f"part div 2 = {f}")).alias(f"background_{f}") for f in range(FOLDS)], *[of(F.col("part") == 2 * f + 1).alias(f"target_{f}") for f in range(FOLDS)])


def model(counts: DataFrame, shares: list[float]) -> DataFrame:
    """g and, by fold, diff_f: log2 p_target - log2 p_background of every n-gram's last byte, by the counts of the other folds.

    p(c | h) = (w * count(hc) + types(h) * p(c | h')) / (w * count(h) + types(h)), for both alike: types
    are those of the background, w is 1 for the target and shares[f], the target's size by the
    background's, for the background.
    """
    sides = [f"{side}_{f}" for side in ("background", "target") for f in range(FOLDS)]
    total = {side: sum((F.col(f"{side}_{f}") for f in range(FOLDS)), F.lit(0)) for side in ("background", "target")}
    counts = counts.select("g", *[(total[c.split("_")[0]] - F.col(c)).alias(c) for c in sides])
    # p of order 0 is uniform; order k is made from that of order k - 1, keyed by the suffix of k bytes
    known = None
    for k in range(1, N + 1):
        mask = (1 << (9 * k)) - 1
        own = counts.groupBy(F.col("g").bitwiseAND(F.lit(mask)).alias("s")).agg(*[F.sum(c).alias(c) for c in sides]) if k < N else counts.withColumnRenamed("g", "s")
        context = own.groupBy(F.shiftrightunsigned("s", 9).alias("h")).agg(*[F.sum(c).alias(f"n_{c}") for c in sides], *[F.count_if(F.col(f"background_{f}") > 0).alias(f"t_{f}") for f in range(FOLDS)])
        own = own.withColumn("h", F.shiftrightunsigned("s", 9)).join(context, "h")
        if known is None:
            own = own.withColumns({f"q_{c}": F.lit(1 / 257) for c in sides})
        else:
            shorter = known.select(F.col("s").alias("r"), *[F.col(f"p_{c}").alias(f"q_{c}") for c in sides])
            own = own.withColumn("r", F.col("s").bitwiseAND(F.lit((1 << (9 * (k - 1))) - 1))).join(shorter, "r")

        def p(c: str) -> Column:
            side, f = c.split("_")
            w, types = F.lit(shares[int(f)] if side == "background" else 1.0), F.col(f"t_{f}")
            return F.when(types > 0, (w * F.col(c) + types * F.col(f"q_{c}")) / (w * F.col(f"n_{c}") + types)).otherwise(F.col(f"q_{c}"))

        known = own.select("s", *[p(c).alias(f"p_{c}") for c in sides])
    diffs = [(F.log2(f"p_target_{f}") - F.log2(f"p_background_{f}") if shares[f] else F.lit(0.0)).cast("float").alias(f"diff_{f}") for f in range(FOLDS)]
    return known.select(F.col("s").alias("g"), *diffs)


def scores(docs: DataFrame, labels: DataFrame, broadcast_ngrams: int = 4 << 20, max_broadcast_labels: int = 1 << 22) -> DataFrame:
    """doc_id, n_tokens, score of every row of docs."""
    good = labels.where("quality = 1 and (toxic is null or toxic = 0) and doc_id is not null").select("doc_id").distinct()
    good = F.broadcast(good) if good.count() <= max_broadcast_labels else good
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("long")), F.lit(FOLDS)).alias("fold"))
    marked = docs.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").select("text", "fold", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = cut(count_ngrams(marked))
    total = counts.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"{side}_{f}"), F.lit(0)).alias(f"{side}_{f}") for side in ("background", "target") for f in range(FOLDS)]).first()
    sizes = {side: [sum(total[f"{side}_{g}"] for g in range(FOLDS) if g != f) for f in range(FOLDS)] for side in ("background", "target")}
    shares = [t / b if b else 0.0 for t, b in zip(sizes["target"], sizes["background"])]
    diffs = cut(model(counts, shares))
    release(counts)
    if total["n"] > broadcast_ngrams:
        return joined_scores(docs, diffs)
    rows = diffs.orderBy("g").toArrow()
    release(diffs)
    shared = docs.sparkSession.sparkContext.broadcast((rows.column("g").to_numpy(), np.column_stack([rows.column(f"diff_{f}").to_numpy() for f in range(FOLDS)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table_g, table_d = shared.value
            data, offsets = buffers(b.column(1))
            fold = b.column(2).to_numpy()
            n, total = np.diff(offsets), np.zeros(len(offsets) - 1)
            for i, j, x, o in chunks(data, offsets):
                if len(x):
                    u, at = np.unique(grams(x, o), return_inverse=True)
                    found = table_d[np.searchsorted(table_g, u)][at, np.repeat(fold[i:j], np.diff(o))]
                    sums = np.concatenate([[0.0], np.cumsum(found, dtype=np.float64)])
                    total[i:j] = sums[o[1:]] - sums[o[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_tokens", "score"])

    return map_arrow(docs, run, "doc_id long, n_tokens long, score double")


def joined_scores(docs: DataFrame, diffs: DataFrame) -> DataFrame:
    """The same by a join of each document's distinct n-grams with the table; texts aren't shuffled."""
    docs = docs.withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            for i, j, x, o in chunks(data, offsets):
                g = grams(x, o) if len(x) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(i, j), np.diff(o))
                order = np.lexsort((g, doc))
                g, doc = g[order], doc[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                # a row with no n-gram keeps documents without tokens
                none = np.setdiff1d(np.arange(i, j), doc)
                at = pa.array(np.concatenate([doc[first], none]))
                times = np.concatenate([np.diff(np.append(first, len(g))), np.zeros(len(none), np.int64)])
                keys = np.concatenate([g[first], np.full(len(none), -1)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), b.column(3).take(at), pa.array(keys), pa.array(times)], ["doc_id", "row", "fold", "g", "n"])

    used = map_arrow(docs.select("doc_id", "text", "row", "fold"), run, "doc_id long, row long, fold long, g long, n long")
    diff = F.get(F.array(*[f"diff_{f}" for f in range(FOLDS)]), F.col("fold").cast("int"))
    found = used.join(diffs, "g", "left").groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.coalesce(diff, F.lit(0.0))).alias("total"))
    return found.select("doc_id", "n_tokens", (F.col("total") / F.greatest("n_tokens", F.lit(1))).alias("score"))
