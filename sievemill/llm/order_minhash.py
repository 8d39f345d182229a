"""Near duplicates by Order MinHash, verified by banded alignment.

A document's k-mers are its shingles of five words (lower-cased, punctuation aside), each
labelled with its occurrence number, so that a repeated passage counts as often as it stands in
the text. Each of ``bands * rows`` hash functions samples the ``ELL`` k-mers with the smallest
values and keeps them in the order of the text; the hash of this ordered sample is one
signature. Two texts agree in a signature only if they share the k-mers and their order, which
makes collisions follow the edit similarity. ``rows`` signatures make a band. Every text has them.

A pair is confirmed by its plain shingles, of which repetitions and their labels say little, so
buckets are formed by the samples of first occurrences without regard to order, and the ordered
bands tell the members of a bucket apart: those of one ordered band meet first, and only the best of
each order meets the best of the bucket. The set of first occurrences is the plain shingle set, and in it two texts of
Jaccard similarity 0.8 miss all of 20 buckets of 2 with a probability of 3e-5 (computed for large
sets; 1.3e-4 for 4 shingles shared of 5), whatever repeats or moves. Where no shingle repeats, the
ordered band of a bucket is the Order MinHash band itself; texts with repetitions have the ordered
bands of all their labelled k-mers as buckets besides.

1. Texts with equal word sequences are one node (128-bit key); copies are never paired.
2. Nodes with an equal key meet in a bucket. A bucket is never expanded into pairs: members are
   compared once with the best of their ordered band, and the best of each ordered band with
   the bucket's top (best: the one that meets most others over all its buckets). The links make classes.
3. A bucket whose members are of one class is settled: all its pairs are of that class; so is one
   whose members but for the top are, if all were compared with the top. The members of the rest,
   each once, however many buckets it is in, go to an exact search
   across classes (``rest``): the rarest shingles of a text, so many that no similar text can
   lack them all, are its keys, and the texts of different classes under one key are compared
   in blocks of centres until none is left.
4. A pair is confirmed if the Jaccard similarity of its five-word shingles is at least
   ``threshold`` and the word-level edit similarity, by alignment within the band of diagonals
   that the threshold allows, is at least ``threshold`` too. Comparisons read 64-bit hashes of
   the words, which are made once a node.
5. Confirmed links make classes: tasks turn the links they hold into stars, large-star and
   small-star steps join these across tasks, until they fit together.

Nothing is collected but counts, a table of shingle counts of fixed size, and Bloom filters of
bounded size, which only spare texts a shuffle. Hot buckets and centres are joined by
sort-merge joins that adaptive execution splits. Lineage is cut by tables in the shared folder.

Edge cases: null and empty texts have no words and are copies of each other; a text of fewer
than five words has one shingle; a repeated row is a copy, and of rows with one doc_id and
different texts each is in its own text's class; a null doc_id gets the class of its text and
never names one (class_id is null if no other member has an id); extra columns are left out
(near_duplicates) or kept (keep_one); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, map_arrow, release
from .components import classes
from .textvec import LOWER, U64, buffers, chunks, doc_slices, mix, prefix, shingles, span_hash, words

K, ELL = 5, 2
TOP = U64(0xFFFFFFFFFFFFFFFF)
SLOTS, BLOCK = 1 << 20, 4096
#: Bytes of text that are taken apart together.
PIECE = 1 << 19
SEEDS = mix(np.arange(1, 4097).astype(U64))
#: The label of a first occurrence.
FIRST = mix(np.zeros(1, U64) + U64(77))


def labelled(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Shingle hashes combined with their occurrence number within the document."""
    if not len(h):
        return h
    order = np.lexsort((h, d))
    hs, ds = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    times = np.empty(len(h), np.int64)
    times[order] = np.arange(len(h)) - start
    return mix(h ^ mix(times.astype(U64) + U64(77)))


def samples(lab: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Of n hash functions, some at a time: the places of the ELL k-mers with the smallest values, a row each."""
    a, b = SEEDS[:n], SEEDS[n : 2 * n] | U64(1)
    step = max(1, (1 << 20) // max(1, len(lab)))
    for i in range(0, n, step):
        v = (lab[None, :] ^ a[i : i + step, None]) * b[i : i + step, None]
        rows = np.arange(len(v))
        picks = []
        for _ in range(min(ELL, len(lab))):
            at = v.argmin(axis=1)
            picks.append(at)
            v[rows, at] = TOP
        yield slice(i, i + step), np.stack(picks)


def folded(lab: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = np.zeros(at.shape[1], U64)
    for p in at:
        s = mix(s * U64(3) + lab[p])
    return s


def signatures(lab: np.ndarray, n: int) -> np.ndarray:
    """n Order MinHash signatures of the labelled k-mers of one text, given in text order."""
    return np.concatenate([folded(lab, np.sort(at, axis=0)) for _, at in samples(lab, n)])


def banded(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = s.reshape(bands, rows)
    out = np.arange(bands).astype(U64)
    for r in range(rows):
        out = mix(out * U64(5) + s[:, r])
    return out.view(np.int64)


def all_bands(lab: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a text's buckets, and the ordered keys that tell members of a bucket apart.

    The buckets are those of the samples of first occurrences, whatever their order; each with the
    ordered key of the same sample, which is the Order MinHash band of a text without repetitions.
    Where a shingle repeats, the Order MinHash bands of all labelled k-mers are buckets besides.
    """
    one = lab[first]
    found = [(folded(one, at), folded(one, np.sort(at, axis=0))) for _, at in samples(one, bands * rows)]
    keys, orders = (banded(np.concatenate(x), bands, rows) for x in zip(*found))
    if first.all():
        return keys, orders
    own = banded(signatures(lab, bands * rows), bands, rows)
    return np.concatenate([keys, own]), np.concatenate([orders, own])


def text_key(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """128 bits of a text's word sequence; a, b: starts and ends of its words in lower-cased data."""
    if not len(a):
        return bytes(16)
    # words with one space between them
    inside = np.zeros(b[-1] - a[0] + 1, np.int8)
    np.add.at(inside, a - a[0], 1)
    np.add.at(inside, b - a[0], -1)
    keep = np.cumsum(inside)[:-1].astype(bool)
    keep[(b - a[0])[:-1]] = True
    flat = np.where(np.cumsum(inside)[:-1] > 0, data[a[0] : b[-1]], 32)[keep]
    return xxhash.xxh3_128_digest(flat.tobytes())


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, rid, key, bands, orders of every row; bands and orders are null where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            keys, found = [], []
            for i, j, x, o in chunks(data, offsets, PIECE):
                s, e, doc, wh = words(x, o)
                h, d, _ = shingles(wh, doc, j - i, K)
                lab = labelled(h, d)
                first = lab == mix(h ^ FIRST)
                at, word_at, low = doc_slices(d, j - i), doc_slices(doc, j - i), LOWER[x]
                for n in range(j - i):
                    keys.append(text_key(low, s[word_at[n] : word_at[n + 1]], e[word_at[n] : word_at[n + 1]]))
                    found.append(all_bands(lab[at[n] : at[n + 1]], first[at[n] : at[n + 1]], bands, rows) if at[n + 1] > at[n] else (None, None))
            both = [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), *both], ["doc_id", "rid", "key", "bands", "orders"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_id().alias("rid")), run, "doc_id long, rid long, key binary, bands array<long>, orders array<long>")


def common_prefix(ha: np.ndarray, hb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common extensions from a[i] and b[j], by binary search on prefix hashes."""
    lo, hi = np.zeros(len(i), np.int64), np.minimum(len(ha) - 1 - i, len(hb) - 1 - j)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = span_hash(ha, i, i + mid) == span_hash(hb, j, j + mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Levenshtein distance of two hash sequences, or limit + 1 beyond the limit.

    Furthest-reaching points by number of edits on the diagonals -limit..limit.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    same = min(n, m)
    differ = np.flatnonzero(a[:same] != b[:same])
    skip = int(differ[0]) if len(differ) else same
    a, b = a[skip:], b[skip:]
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    skip = int(differ[0]) if len(differ) else same
    a, b = a[: len(a) - skip], b[: len(b) - skip]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m if n + m <= limit else limit + 1
    ha, hb = prefix(a), prefix(b)
    # reach[k]: furthest i on diagonal k = j - i, shifted by one for the borders
    far = -(1 << 40)
    reach = np.array([far, 0, far], np.int64)
    reach[1] = common_prefix(ha, hb, np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for d in range(limit + 1):
        if d:
            k = np.arange(-d, d + 1)
            old = np.full(2 * d + 3, far, np.int64)  # diagonals -d-1..d+1
            old[2 : 2 * d + 1] = reach[1:-1]
            i = np.maximum(np.maximum(old[1:-1] + 1, old[2:] + 1), old[:-2])
            i = np.minimum(i, np.minimum(n, m - k))
            ok = (i >= 0) & (i + k >= 0)
            at = np.where(ok, i, 0)
            at_j = np.where(ok, i + k, 0)
            i = np.where(ok, at + common_prefix(ha, hb, at, at_j), far)
            reach = np.concatenate([[far], i, [far]])
        if abs(m - n) <= d and reach[1 + d + (m - n)] >= n:
            return d
    return limit + 1


class Text:
    """A text's words, as hashes in order, and its distinct shingles."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.words = hashes
        h, _, _ = shingles(hashes, np.zeros(len(hashes), np.int64), 1, K)
        self.shingles = np.unique(h)

    @classmethod
    def of(cls, text: str | None) -> Text:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        return cls(words(data, np.array([0, len(data)]))[3])

    @classmethod
    def packed(cls, value: bytes) -> Text:
        return cls(np.frombuffer(value, U64))


def similar(a: Text, b: Text, threshold: float) -> bool:
    x, y = len(a.shingles), len(b.shingles)
    if min(x, y) < threshold * max(x, y):
        return False
    common = len(np.intersect1d(a.shingles, b.shingles, assume_unique=True))
    if common < threshold * (x + y - common):
        return False
    n = max(len(a.words), len(b.words))
    limit = int((1 - threshold) * n + 1e-9)
    return edit_distance(a.words, b.words, limit) <= limit


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (key, centre) that the alignment confirms; texts: key, words."""
    joined = pairs.join(texts, "key").join(texts.select(F.col("key").alias("centre"), F.col("words").alias("centre_words")), "centre").select("key", "centre", "words", "centre_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, Text | None] = (b"", None)
        for b in batches:
            centres = b.column(1).to_pylist()
            keep = np.zeros(b.num_rows, bool)
            for n in range(b.num_rows):
                if held[0] != centres[n]:
                    held = (centres[n], Text.packed(b.column(3)[n].as_py()))
                keep[n] = similar(Text.packed(b.column(2)[n].as_py()), held[1], threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["key", "centre"]).filter(pa.array(keep))

    return map_arrow(joined, run, "key binary, centre binary")


def row_id() -> Column:
    """64 bits of a row's doc_id and text; equal rows share them."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def maybe_in(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of whether a row id may be among ids (one long column), with no false negatives.

    It only spares rows a shuffle; a join decides, so a fuller filter costs time and changes no result.
    """
    shared = bloom.filter_of(ids)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.maybe(shared.value, h.to_numpy()))

    return test


def word_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, words (64-bit hashes, packed) of nodes (key, rid), each once; only rows that may be asked for are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(0))
            for i, j, x, o in chunks(data, offsets, PIECE):
                s, e, doc, wh = words(x, o)
                at, low = doc_slices(doc, j - i), LOWER[x]
                own = [slice(at[n], at[n + 1]) for n in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array([text_key(low, s[w], e[w]) for w in own], pa.binary()), pa.array([wh[w].tobytes() for w in own], pa.binary())], ["key", "words"])

    asked = maybe_in(nodes.select("rid"))
    rows = docs.select("text", row_id().alias("rid")).where(asked("rid")).select("text")
    return map_arrow(rows, run, "key binary, words binary").dropDuplicates(["key"]).join(nodes.select("key"), "key", "left_semi")


def links(nodes: DataFrame, docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (key, centre) between nodes (key, rid, bands, orders): as classes (key, label) of those found by buckets, and the others; nodes is deleted."""
    both = F.posexplode(F.arrays_zip("bands", "orders")).alias("n", "x")
    rows = nodes.where("bands is not null").select("key", "rid", both).select(F.xxhash64("n", "x.bands").alias("b"), F.col("x.orders").alias("o"), "key", "rid")
    shared = cut(rows.join(rows.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "b"), shuffled=True)
    release(nodes)
    # how many others a node meets, over all its buckets: the higher, the better a centre
    rank = cut(shared.groupBy("key").agg(F.sum("c").alias("met"), F.min("rid").alias("rid")), shuffled=True)
    texts = cut(word_table(docs, rank), shuffled=True)
    rows = cut(shared.select("b", "o", "key").join(rank.select("key", "met"), "key"), shuffled=True)
    release(shared)
    # members of one order meet the best of them, and the best of each order the best of the bucket
    near = cut(rows.groupBy("b", "o").agg(F.max(F.struct("met", "key")).alias("near")), shuffled=True)
    tops = near.groupBy("b").agg(F.max("near").alias("top"))
    centres = near.join(tops, "b").select("b", "o", F.col("near.key").alias("near"), F.col("top.key").alias("top"))
    centre = F.when(F.col("key") == F.col("near"), F.col("top")).otherwise(F.col("near"))
    met = rows.join(centres, ["b", "o"]).where("key <> top").select("b", "key", centre.alias("centre"), "top")
    met = cut(met, shuffled=True)
    release(rows, rank, near)
    tested = cut(met.select("key", "centre").distinct(), shuffled=True)
    found = cut(verify(tested, texts, threshold), shuffled=True)
    label = classes(found)
    release(found)
    left = unsettled(met, label)
    release(met)
    more = rest(left, tested, texts, threshold)
    release(left, tested, texts)
    return label, more


def unsettled(met: DataFrame, label: DataFrame) -> DataFrame:
    """key, label of the members of buckets with a pair across classes that was never compared.

    met: b, key, centre, top: a bucket's members but for its top, each compared with its centre. Where
    that is the top for all of them, the pairs never compared are those among them, and all are
    within a class if the members have one label; elsewhere the top is one of the members too.
    """
    members = met.select("b", "key").unionAll(met.where("centre <> top").select("b", F.col("top").alias("key")).distinct())
    members = members.join(label, "key", "left").select("b", "key", F.coalesce("label", "key").alias("label"))
    buckets = members.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("b")
    return cut(members.join(buckets, "b", "left_semi").select("key", "label").distinct(), shuffled=True)


def rare_first(texts: DataFrame, threshold: float) -> DataFrame:
    """key, label, size, h, at: of each text the shingles h, rarest first, that no similar text lacks altogether; at: h's place in the order.

    Any one order of all shingles is exact; ours is by counts of ``SLOTS`` hash slots, a table of
    fixed size, so that the shingles of common passages come last. A slot counted once holds no
    shared shingle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for value in b.column(2):
                np.add.at(n, (Text.packed(value.as_py()).shingles & U64(SLOTS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(n[at[i : i + (1 << 16)]])], ["slot", "n"])

    counted = map_arrow(texts, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS, np.int64)
    total[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of = shared.value
        for b in batches:
            for i in range(b.num_rows):
                h = Text.packed(b.column(2)[i].as_py()).shingles
                n = n_of[(h & U64(SLOTS - 1)).astype(np.int64)]
                # one more for rounding, which only adds keys
                first = np.lexsort((h, n))[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1]
                at = np.flatnonzero(n[first] > 1)
                keys = h[first[at]].view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(keys), pa.int32())), b.column(1).take(pa.array([i] * len(keys), pa.int32())), pa.array([len(h)] * len(keys), pa.int64()), pa.array(keys), pa.array(at)], ["key", "label", "size", "h", "at"])

    return cut(map_arrow(texts, run, "key binary, label binary, size long, h long, at long"))


def rest(nodes: DataFrame, tested: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """All links (key, centre) across the classes of nodes (key, label) that tested lacks."""
    if nodes.isEmpty():
        return texts.sparkSession.createDataFrame([], "key binary, centre binary")
    found = cut(texts.sparkSession.createDataFrame([], "key binary, centre binary"))
    own = cut(nodes.join(texts, "key").select("key", "label", "words"), shuffled=True)
    keyed = rare_first(own, threshold)
    groups = keyed.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
    # under each key, all members but those of the largest class are centres in turn
    rows = cut(keyed.join(groups.where("labels > 1").select("h", F.col("most.label").alias("largest")), "h"), shuffled=True)
    release(keyed)
    todo = rows.where("label <> largest").select("h", "key", "label", "size", "at")
    # at the first key that two similar texts share, what both have left must hold all they share
    enough = F.least(F.col("size") - F.col("at"), F.col("long") - F.col("place")) >= threshold / (1 + threshold) * (F.col("size") + F.col("long")) - 1e-6
    pair = [F.least("key", "centre").alias("key"), F.greatest("key", "centre").alias("centre")]
    tested = cut(tested.select(*pair).distinct(), shuffled=True)
    turn = 0
    while not todo.isEmpty():
        best = F.min(F.struct("key", "label", "size", "at")).alias("best")
        centres = cut(todo.groupBy("h", F.pmod(F.xxhash64("key"), F.lit(BLOCK)).alias("part")).agg(best).select("h", F.col("best.key").alias("centre"), F.col("best.label").alias("of"), F.col("best.size").alias("long"), F.col("best.at").alias("place")), shuffled=True)
        met = rows.join(centres, "h").where((F.col("label") != F.col("of")) & enough)
        pairs = cut(met.select(*pair).distinct().join(tested, ["key", "centre"], "left_anti"), shuffled=True)
        new = cut(verify(pairs, own.select("key", "words"), threshold), shuffled=True)
        # one table of links and one of tested pairs, whatever the number of turns
        parts, found = (found, new), cut(found.unionAll(new))
        release(*parts)
        parts, tested = (tested, pairs), cut(tested.unionAll(pairs))
        release(*parts)
        old, todo = todo, cut(todo.join(centres.select("h", F.col("centre").alias("key")), ["h", "key"], "left_anti"), shuffled=True)
        release(centres, *([old] if turn else []))
        turn += 1
    release(rows, own, tested, *([todo] if turn else []))
    return found


def grouped(docs: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 2) -> DataFrame:
    """doc_id, rid, key of its text, label of its class, class_id, class_size of every row of docs."""
    sketched = cut(sketch(docs, bands, rows))
    named = cut(sketched.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("orders").alias("orders")), shuffled=True)
    # the bands are most of these tables, and only the first step of links reads them
    base = cut(sketched.select("doc_id", "rid", "key"))
    release(sketched)
    nodes = cut(named.select("key", "rep", "copies"))
    label, more = links(named, docs, threshold)
    if not more.isEmpty():
        label = classes(label.unionAll(more))
    nodes = nodes.select("key", "rep", "copies").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    # a label's members are summed before they are joined, so a large class is no large task
    whole = nodes.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    named = nodes.select("key", "label").join(whole, "label")
    return base.select("doc_id", "rid", "key").join(named, "key").select("doc_id", "rid", "key", "label", "class_id", "class_size")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size of every row of docs."""
    return grouped(docs, **options).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row of each class with the smallest doc_id, columns as they are; rows without an id stay.

    Where a doc_id stands for several texts, its rows are told apart by the keys of their texts: of
    the class's rows with that id the smallest key stays, and of its rows the smallest text. Only
    rows of classes of several rows are shuffled (and the few that the filter takes for such).
    """
    groups = cut(grouped(docs, **options).where("doc_id is not null").select("doc_id", "rid", "key", "label"), shuffled=True)
    first = cut(groups.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("rows")), shuffled=True)
    asked = maybe_in(groups.join(first.where("rows > 1"), "label", "left_semi").select("rid"))
    chosen = groups.join(first, "label").where("doc_id = first.doc_id and key = first.key").select(F.col("doc_id").alias("id"), "rid", "label").distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), row_id().alias("rid"))
    kept = rows.where("id is not null").where(asked("rid")).join(chosen, ["id", "rid"])
    kept = kept.groupBy("label").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row"))
    return rows.where(F.col("id").isNull() | ~asked("rid")).select("row.*").unionAll(kept.select("row.*"))
