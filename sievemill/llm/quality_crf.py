"""Quality classifier: a linear-chain CRF labels every line good or bad.

Each line has numeric features of its own and those of its neighbours; a two-state chain with
learned transitions joins the lines of a document. The marginals of the forward-backward pass,
weighted by line length, are averaged into the document's score.

Training is one executor task, on at most ``max_train_docs`` labelled documents, whole texts (a
bounded sample: the lowest by a hash of doc_id; the only cap in this module, and only of
training). Every line of a training document takes the document's label. Scoring is a map
without a shuffle over whole texts.

Edge cases: a null or empty text is one empty line and gets a score like any other; repeated
rows are scored alike; extra columns are left out; labels that are null, doc_ids that are null,
and doc_ids whose labels disagree are not used for training; without any training row, or with
one class only, the score is that class's smoothed rate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textvec import BASE, U64, buffers, chunks, doc_slices, prefix, runs, span_hash

CLASSES = {
    "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "sentence": b".,;:?",
    "bang": b"!",
    "pipe": b"|",
    "symbols": b"#$%&*<>@^_~=+\\/{}[]",
    "quotes": b"\"'()-",
}
N_FEATURES = len(CLASSES) + 10
#: Bytes of text that are taken apart together.
PIECE = 1 << 19


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (one row a line), document and byte length of every line of a chunk."""
    n_docs = len(offsets) - 1
    # a line starts at each document's first byte and after each \n
    breaks = np.flatnonzero(data == 10)
    doc_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n_docs), doc_of_break])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends = np.empty_like(starts)
    ends[~last] = starts[1:][~last[:-1]] - 1
    ends[last] = offsets[1:][doc[last]]
    length = (ends - starts).astype(np.float64)
    full = np.maximum(length, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]) / full

    f = np.zeros((len(starts), N_FEATURES))
    for k, members in enumerate(CLASSES.values()):
        table = np.zeros(256, bool)
        table[list(members)] = True
        f[:, k] = share(table[data])
    k = len(CLASSES)
    # words are separated by white space here: attached symbols belong to them
    gap = np.zeros(256, bool)
    gap[9:14] = gap[32] = True
    a, b = runs(~gap[data], offsets)
    h = span_hash(prefix(data), a, b)
    line = np.searchsorted(starts, a, side="right") - 1
    at = doc_slices(line, len(starts))
    n_words = np.diff(at)
    some = np.maximum(n_words, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return (total[at[1:]] - total[at[:-1]]) / some

    same = np.zeros(len(a))
    if len(a) > 1:
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    width = (b - a).astype(np.float64)
    f[:, k] = mean(same)
    f[:, k + 1] = np.minimum(mean(width), 40) / 10
    f[:, k + 2] = mean(width <= 3)
    f[:, k + 3] = mean(width >= 16)
    # words seen before on the line
    by_word = np.lexsort((h, line))
    new = np.ones(len(a), bool)
    if len(a) > 1:
        new[by_word[1:]] = (h[by_word][1:] != h[by_word][:-1]) | (line[by_word][1:] != line[by_word][:-1])
    f[:, k + 4] = mean(~new) * np.minimum(n_words, 30) / 30
    f[:, k + 5] = np.log1p(length) / 8
    f[:, k + 6] = n_words == 0
    # lines that the document has twice or more
    lh = span_hash(prefix(data), starts, ends) * U64(BASE) + doc.astype(U64)
    _, inverse, count = np.unique(lh, return_inverse=True, return_counts=True)
    f[:, k + 7] = (count[inverse] > 1) & (length > 0)
    f[:, k + 8] = np.log1p(n_words) / 6
    tail = np.zeros(len(a))
    word = np.zeros(256, bool)
    word[list(CLASSES["letters"] + CLASSES["digits"] + CLASSES["sentence"] + CLASSES["quotes"])] = True
    tail[:] = ~word[data[b - 1]] if len(a) else 0
    f[:, k + 9] = mean(tail)
    return f, doc, length


def with_neighbours(f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the borders), and a bias."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    if len(f) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:] = f[:-1] * same
        after[:-1] = f[1:] * same
    return np.hstack([f, before, after, np.ones((len(f), 1))])


def marginals(emit: np.ndarray, doc: np.ndarray, n_docs: int, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, expected transition counts by document pair, log partition by document.

    Documents advance together, longest first, so each step is one vector operation.
    """
    at = doc_slices(doc, n_docs)
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    first, longest = at[:-1][order], int(sizes.max(initial=0))
    active = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")  # documents with a line t
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(longest):
        rows = first[: active[t]] + t
        if t:
            s = alpha[rows - 1][:, :, None] + trans
            alpha[rows] = emit[rows] + np.logaddexp(s[:, 0], s[:, 1])
        else:
            alpha[rows] = emit[rows]
    pair = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        rows = first[: active[t + 1]] + t
        s = trans + (emit[rows + 1] + beta[rows + 1])[:, None, :]
        beta[rows] = np.logaddexp(s[:, :, 0], s[:, :, 1])
    lines_of = np.repeat(np.arange(n_docs), sizes)
    log_z = np.zeros(n_docs)
    some = sizes > 0
    log_z[some] = np.logaddexp(alpha[at[1:][some] - 1][:, 0], alpha[at[1:][some] - 1][:, 1])
    good = np.exp(alpha[:, 1] + beta[:, 1] - log_z[lines_of])
    if len(emit) > 1:
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        s = alpha[inner][:, :, None] + trans + (emit[inner + 1] + beta[inner + 1])[:, None, :] - log_z[doc[inner]][:, None, None]
        pair = np.exp(s).sum(0)
    return np.clip(good, 0, 1), pair, log_z


def train(texts: list[str], labels: list[int], steps: int = 150, l2: float = 1.0) -> dict:
    """Weights of the CRF by full-batch Adam on the regularised log-likelihood."""
    rate = (sum(labels) + 1) / (len(labels) + 2)
    if len(set(labels)) < 2:
        return {"rate": rate}
    data, offsets = buffers(pa.array(texts, pa.string()))
    parts = [(line_features(x, o)[:2], i) for i, _, x, o in chunks(data, offsets, PIECE)]
    f = np.vstack([p[0][0] for p in parts])
    doc = np.concatenate([p[0][1] + p[1] for p in parts])
    mean, std = f.mean(0), f.std(0) + 1e-3
    x = with_neighbours((f - mean) / std, doc)
    y = np.asarray(labels)
    # both classes weigh alike in the line features, the prior of documents sets the bias
    gold = y[doc]
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    inner = doc[1:] == doc[:-1]
    gold_pair = np.zeros((2, 2))
    np.add.at(gold_pair, (gold[:-1][inner], gold[1:][inner]), 1)
    onehot = np.eye(2)[gold]
    m, v = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        good, pair, _ = marginals(x @ w, doc, len(y), trans)
        gw = x.T @ (np.column_stack([1 - good, good]) - onehot) + l2 * w
        gt = pair - gold_pair + l2 * trans
        for k, (p, g) in enumerate(((w, gw / len(y)), (trans, gt / len(y)))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {"rate": rate, "mean": mean, "std": std, "w": w, "trans": trans}


def score_chunk(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if "w" not in model:
        return np.full(n, model["rate"])
    f, doc, length = line_features(data, offsets)
    x = with_neighbours((f - model["mean"]) / model["std"], doc)
    good, _, _ = marginals(x @ model["w"], doc, n, model["trans"])
    weight = length + 1
    return np.clip(np.bincount(doc, good * weight, n) / np.bincount(doc, weight, n), 0, 1)


def score_batch(model: dict, column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    out = np.zeros(len(offsets) - 1)
    for i, j, x, o in chunks(data, offsets, PIECE):
        out[i:j] = score_chunk(model, x, o)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = 3000, seed: str = "crf") -> dict:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    # at most max_train_docs rows, so they can be broadcast
    known = F.broadcast(known.select("doc_id", "quality", F.xxhash64(F.lit(seed), "doc_id").alias("h")).orderBy("h", "doc_id").limit(max_train_docs))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("h", "doc_id", "text", "quality")
    # a doc_id may stand for many rows
    rows = rows.orderBy("h", "doc_id", "text").limit(max_train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted({row for b in batches for row in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t, _ in texts], [q for _, _, q in texts]))], pa.binary())], ["model"])

    found = map_arrow(rows.coalesce(1), run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], [])


def quality_scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_batch(shared.value, b.column(1)), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least threshold, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_batch(shared.value, b.column(at)) >= threshold))

    return map_arrow(docs, run, docs.schema)
