"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

Test items are short and documents long, so a symmetric similarity is useless and MinHash is
used one-sidedly, as a containment test: under each of ``n_hashes`` hash functions the item's
minimum shingle is looked up among the document's shingles. If a share c of an item's shingles
is in the document, each lookup succeeds with probability c, whatever the document's length.
Items are partitioned by size (powers of two of their distinct shingles); every partition has
its own index, number of hash functions, least number of successes and least document size
(a document with fewer shingles than threshold x the partition's smallest item cannot contain
any of them and skips the partition). Candidates are verified by exact shingle containment on
the words themselves, so results have no false positives; a true item is missed with
probability below 1e-6.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, ASCII-lower-cased; an
item shorter than ``k`` words is one shingle of all its words, and is looked up among the
document's shingles of that many words. The documents are read in one map without a shuffle. Items are broadcast in
blocks of about ``block_bytes`` of text (an index takes about seven times that in a task); more
items mean more passes, not a larger broadcast, and a block's result is written before the next is read.

Edge cases: null and empty texts, of documents or items, contain nothing and are contained
nowhere; repeated document rows give a row each; items with equal item_id are separate rows
that give a row each; extra columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, release
from .textvec import LOWER, U64, buffers, chunks, doc_slices, mix, shingles, words

K = 5
SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


class Partition:
    """The index of the items of one size class; sets: each item's distinct shingles."""

    def __init__(self, members: np.ndarray, sets: list[np.ndarray], threshold: float, n_hashes: int) -> None:
        self.least_doc = int(np.ceil(threshold * min(map(len, sets))))
        # the binomial tail below a quarter of the lookups is under 1e-6 at containment 0.8 and 24 lookups
        self.least_hits = max(1, n_hashes // 4)
        seeds = mix(np.arange(1, n_hashes + 1).astype(U64))
        least = np.stack([s[mix(s[None, :] ^ seeds[:, None]).argmin(axis=1)] for s in sets])
        key, item = least.ravel(), np.repeat(members, n_hashes)
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])))
        self.key, self.item, self.times = key[new], item[new], np.diff(np.append(new, len(key)))
        self.keys, self.first = np.unique(self.key, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.key)))

    def candidates(self, h: np.ndarray, d: np.ndarray, doc_sizes: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and items with enough successful lookups; h, d: shingles and their documents."""
        slot = np.searchsorted(self.keys, h)
        slot[slot == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[slot] == h)
        hit = hit[doc_sizes[d[hit]] >= self.least_doc]
        # repeats of a shingle in a document only repeat its lookups
        hit = hit[np.unique(d[hit] * len(self.keys) + slot[hit], return_index=True)[1]]
        slot, doc = slot[hit], d[hit]
        n = self.count[slot]
        rows = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        pair, where = np.unique(np.repeat(doc, n) * n_items + self.item[rows], return_inverse=True)
        hits = np.bincount(where, self.times[rows], len(pair)) if len(pair) else np.zeros(0)
        pair = pair[hits >= self.least_hits]
        return pair // n_items, pair % n_items


class Index:
    """Items in their size partitions; shared with all tasks.

    The items' words lie in one buffer; a shingle is a hash and the place of its words there.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, n_hashes: int, k: int = K) -> None:
        self.threshold = threshold
        data, offsets = buffers(pa.array([t for _, t in items], pa.string()))
        s, e, doc, wh = words(data, offsets)
        low = LOWER[data]
        self.words = b" ".join(low[a:b].tobytes() for a, b in zip(s, e))
        begin = np.concatenate([[0], np.cumsum(e - s + 1)])  # of each word in self.words
        n_words = np.bincount(doc, minlength=len(items))
        self.ids, sets, places, lengths = [], [], [], []
        at = doc_slices(doc, len(items))
        for i in np.flatnonzero(n_words):
            m = min(k, int(n_words[i]))
            own = slice(at[i], at[i + 1])
            h, _, w = shingles(wh[own], np.zeros(n_words[i], np.int64), 1, m)
            h, first = np.unique(h, return_index=True)
            w = w[first] + at[i]
            self.ids.append(items[i][0])
            sets.append(h)
            places.append(np.column_stack([begin[w], begin[w + m] - 1]))
            lengths.append(m)
        self.at = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int64)
        self.shingles = np.concatenate([*sets, np.zeros(0, U64)])
        self.places = np.concatenate([*places, np.zeros((0, 2), np.int64)]).astype(np.int64)
        sizes = defaultdict(list)
        for j, m in enumerate(lengths):
            sizes[m, len(sets[j]).bit_length()].append(j)
        self.partitions = [(m, Partition(np.array(own), [sets[j] for j in own], threshold, n_hashes)) for (m, _), own in sorted(sizes.items())]

    def shared(self, j: int, h: np.ndarray, text) -> int:
        """How many of item j's shingles a document holds; h: its shingles, text(x): the words of the x-th."""
        own = self.shingles[self.at[j] : self.at[j + 1]]
        slot = np.minimum(np.searchsorted(own, h), len(own) - 1)
        there = np.flatnonzero(own[slot] == h)
        if len(np.unique(slot[there])) < self.threshold * len(own):
            return 0
        equal = set()
        for x, n in zip(there.tolist(), slot[there].tolist()):
            if n not in equal:
                a, b = self.places[self.at[j] + n]
                if text(x) == self.words[a:b]:
                    equal.add(n)
        return len(equal)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, its shingles, those in the document) of the verified pairs of a chunk."""
        n = len(offsets) - 1
        s, e, doc, wh = words(data, offsets)
        found, made = [], {}
        for m, partition in self.partitions:
            if m not in made:
                h, d, w = shingles(wh, doc, n, m)
                made = {m: (h, d, w, np.bincount(d, minlength=n), doc_slices(d, n))}
            h, d, w, sizes, at = made[m]
            for i, j in zip(*partition.candidates(h, d, sizes, max(1, len(self.ids)))):
                first, last = at[i], at[i + 1]
                text = lambda x, first=first, m=m: b" ".join(LOWER[data[s[y] : e[y]]].tobytes() for y in range(w[first + x], w[first + x] + m) if y < len(s) and doc[y] == doc[w[first + x]])
                size, common = int(self.at[j + 1] - self.at[j]), self.shared(int(j), h[first:last], text)
                if common >= self.threshold * size:
                    found.append((int(i), int(j), size, common))
        return found


def indexes(items: DataFrame, threshold: float, n_hashes: int, block_bytes: int) -> Iterator[tuple[Index, bool]]:
    """Indexes of blocks of items, each block's text of about block_bytes, and whether there are several blocks."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index([(r["item_id"], r["text"]) for r in block.collect()], threshold, n_hashes), n > 1


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n_hashes: int = 24, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of all pairs with at least threshold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for index, several in indexes(items, threshold, n_hashes, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = buffers(b.column(1))
                for i, _, x, o in chunks(data, offsets):
                    found = shared.value.find(x, o)
                    if found:
                        doc, item, size, common = (np.array(c) for c in zip(*found))
                        ids = pa.array([shared.value.ids[j] for j in item], pa.int64())
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + i)), ids, pa.array(size), pa.array(common), pa.array(common / size)], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        found = map_arrow(docs, run, SCHEMA)
        if several:
            found = cut(found)
            shared.destroy()
        parts.append(found)
    return reduce(DataFrame.unionAll, parts)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n_hashes: int = 24, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that contain no item, columns as they are."""
    at = docs.columns.index("text")
    for index, several in indexes(items, threshold, n_hashes, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = buffers(b.column(at))
                keep = np.ones(b.num_rows, bool)
                for i, _, x, o in chunks(data, offsets):
                    keep[[i + f[0] for f in shared.value.find(x, o)]] = False
                yield b.filter(pa.array(keep))

        before, docs = docs, map_arrow(docs, run, docs.schema)
        if several:
            docs = cut(docs)
            shared.destroy()
            if hasattr(before, "cut_folder"):
                release(before)
    return docs
