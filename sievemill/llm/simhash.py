r"""Near duplicates by SimHash: a self-join of the binary trie of fingerprints.

Words are ``[^\x20\x09-\x0D]+``, lower-cased in A-Z; a text's shingles are its runs of three words
(all words, if fewer), each as often as it stands there, joined by spaces and hashed by XXH64 with
seed 42. A bit of the fingerprint is 1 if it is set in over half the hashes; a text without words
has fingerprint zero. Fingerprints that differ in at most ``budget`` bits are linked.

The trie holds each distinct fingerprint once, so copies are never paired. Two of its nodes are
traversed together: their four pairs of children follow, a pair whose prefixes differ in a
further bit spends one of the budget, and a pair beyond the budget is dropped with all below it.

On the cluster the trie is cut into blocks, the highest nodes with at most ``leaf`` fingerprints.
Only their prefixes and counts come to the driver (at most about 2**19 of them: leaf grows with the
table). Every fingerprint descends the trie of blocks on its own, within its budget, and visits the
blocks that it reaches and that lie deeper than its own (or as deep, and after it). So a block
meets its visitors once from either side, and a deep, crowded part of the trie does not send its
fingerprints to a shallow block next to it: a block of depth d has at most
leaf * (1 + d + d * (d - 1) / 2) visitors. A task holds the block and reads its visitors batch by
batch. A fingerprint has at most 2,080 neighbours, whatever the table; links are turned into stars
where they are found, and the stars of all tasks into components.

Edge cases: null and empty texts have fingerprint zero, linked like any other; repeated rows are
copies; a row without a doc_id gets the component of its text and names none (component_id is null
if no other member has an id); rows with one doc_id and different texts are each in their own text's
component; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, release
from .components import classes, stars
from .textvec import LOWER, SPACE, U64, buffers, chunks, doc_slices, runs

# fixed values of the contract
K, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Least size of a block, and the power of two of blocks that a table has at most, about.
LEAF, MOST_BLOCKS = 4096, 18
#: Bits that the first count of prefixes looks at, and each later one.
FIRST_BITS, STEP_BITS = 12, 4
#: Pairs of nodes with fewer pairs of fingerprints are compared at once.
SMALL = 64
#: Pairs of nodes, or fingerprints, that are looked at together.
FRONTIER = 1 << 16


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a chunk of texts, and the document of each."""
    low = LOWER[data]
    inside = ~SPACE[low]
    a, b = runs(inside, offsets)
    doc = np.searchsorted(offsets, a, side="right") - 1
    # all words with one space after each
    ends = np.cumsum(b - a + 1) - 1
    starts = ends - (b - a)
    flat = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    letters = np.ones(len(flat), bool)
    letters[ends] = False
    flat[letters] = low[inside]
    whole = np.flatnonzero(doc[: max(0, len(doc) - K + 1)] == doc[K - 1 :])
    at = doc_slices(doc, len(offsets) - 1)
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < K))
    first, last = np.concatenate([whole, at[short]]), np.concatenate([whole + K - 1, at[short + 1] - 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(starts[first].tolist(), ends[last].tolist())), U64, len(first))
    return h, doc[first]


def majority(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of n documents."""
    out = np.zeros(n, U64)
    at = doc_slices(doc, n)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > np.diff(at)[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            found = [majority(*shingle_hashes(x, o), j - i) for i, j, x, o in chunks(data, offsets)]
            fp = np.concatenate(found) if found else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def high(depth: int) -> np.uint64:
    """The mask of the first depth bits."""
    return U64(((1 << depth) - 1) << (BITS - depth))


def blocks(nodes: DataFrame, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes (in order, as the smallest fingerprint) and depths of the highest trie nodes with at most leaf fingerprints of nodes (fp)."""
    found: list[tuple[int, int]] = []
    depth, crowded = 0, None
    while crowded is None or len(crowded):
        old, depth = depth, min(BITS, depth + (STEP_BITS if depth else FIRST_BITS))
        rows = nodes
        if old:
            hot = nodes.sparkSession.createDataFrame(pa.table({"hot": crowded.view(np.int64)}))
            rows = nodes.join(F.broadcast(hot), F.col("fp").bitwiseAND(F.lit(int(high(old).view(np.int64)))) == F.col("hot"), "left_semi")
        counted = rows.groupBy(F.col("fp").bitwiseAND(F.lit(int(high(depth).view(np.int64)))).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        prefix, n = counted["prefix"].to_numpy().view(U64), counted["n"].to_numpy()
        order = np.argsort(prefix)
        prefix, n = prefix[order], n[order]
        for d in range(old, depth + 1):
            at = np.flatnonzero(np.append(True, (prefix[1:] & high(d)) != (prefix[:-1] & high(d)))) if len(prefix) else np.zeros(0, np.int64)
            sums = np.add.reduceat(n, at) if len(at) else n
            ready = sums <= leaf
            found += [(int(p), d) for p in prefix[at[ready]] & high(d)]
            rest = np.repeat(~ready, np.diff(np.append(at, len(prefix))))
            prefix, n = prefix[rest], n[rest]
        crowded = prefix
    found.sort()
    return np.array([p for p, _ in found], U64), np.array([d for _, d in found], np.int64)


def reached(fp: np.ndarray, starts: np.ndarray, depths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in fp, block): all blocks with a prefix that differs from the fingerprint's in at most budget bits."""
    q, lo, hi, diff = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.full(len(fp), len(starts)), np.zeros(len(fp), np.int64)
    base = np.zeros(len(fp), U64)
    out = []
    for d in range(BITS + 1):
        done = (hi - lo == 1) & (depths[np.minimum(lo, len(starts) - 1)] <= d)
        out.append((q[done], lo[done]))
        q, lo, hi, diff, base = (x[~done] for x in (q, lo, hi, diff, base))
        if not len(q):
            break
        bit = U64(1 << (BITS - 1 - d))
        mid = np.clip(np.searchsorted(starts, base | bit), lo, hi)
        one = (fp[q] & bit) != 0
        q, lo, hi = np.concatenate([q, q]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
        base, diff = np.concatenate([base, base | bit]), np.concatenate([diff + one, diff + ~one])
        keep = (lo < hi) & (diff <= budget)
        q, lo, hi, diff, base = (x[keep] for x in (q, lo, hi, diff, base))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def crossed(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with i in [alo, ahi) and j in [blo, bhi), of every pair of ranges."""
    width = bhi - blo
    sizes = (ahi - alo) * width
    of = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return alo[of] + k // width[of], blo[of] + k % width[of]


def close_pairs(a: np.ndarray, b: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all values of the sorted arrays a and b that differ in at most budget bits; a is b: i < j.

    Node pairs are ranges of a and of b at one depth. They are taken a frontier at a time, the
    newest first, so that few wait.
    """
    same = a is b
    if not len(a) or not len(b):
        return
    start = [np.array([x]) for x in (0, len(a), 0, len(b), 0)]
    todo = [(0, *start)]
    while todo:
        d, *state = todo.pop()
        if len(state[0]) > FRONTIER:
            cuts = range(0, len(state[0]), FRONTIER)
            todo += [(d, *(x[i : i + FRONTIER] for x in state)) for i in cuts]
            continue
        alo, ahi, blo, bhi, diff = state
        small = (ahi - alo) * (bhi - blo) <= SMALL
        i, j = crossed(alo[small], ahi[small], blo[small], bhi[small])
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        alo, ahi, blo, bhi, diff = (x[~small] for x in state)
        if not len(alo):
            continue
        bit, mask = U64(1 << (BITS - 1 - d)), high(d)
        am = np.clip(np.searchsorted(a, (a[alo] & mask) | bit), alo, ahi)
        bm = np.clip(np.searchsorted(b, (b[blo] & mask) | bit), blo, bhi)
        mirrored = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        children = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), tuple(x[~mirrored] for x in (am, ahi, blo, bm, diff + 1))]
        state = [np.concatenate(x) for x in zip(*children)]
        keep = (state[0] < state[1]) & (state[2] < state[3]) & (state[4] <= budget)
        if keep.any():
            todo.append((d + 1, *(x[keep] for x in state)))


def links(nodes: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """u, v: stars with the components of the links between the distinct fingerprints of nodes (fp)."""
    leaf = leaf or max(LEAF, nodes.count() >> MOST_BLOCKS)
    starts, depths = blocks(nodes, leaf)
    rank = np.empty(len(starts), np.int64)
    rank[np.lexsort((starts, depths))] = np.arange(len(starts))
    shared = nodes.sparkSession.sparkContext.broadcast((starts, depths, rank))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, depths, rank = shared.value
        for fp in arrays(batches):
            q, block = reached(fp, starts, depths, budget)
            home = np.searchsorted(starts, fp, side="right")[q] - 1
            keep = rank[block] >= rank[home]
            q, block, home = q[keep], block[keep], home[keep]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(block != home), pa.array(fp[q].view(np.int64))], ["block", "visitor", "fp"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(x: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, j in close_pairs(x, own, budget):
                yield stars(pa.array(x[i].view(np.int64)), pa.array(own[j].view(np.int64)))

        held, own, now = [], None, -1
        for b in batches:
            block, visitor, fp = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy().view(U64)
            cuts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (visitor[1:] != visitor[:-1])))
            for i, j in zip(cuts, np.append(cuts[1:], len(block))):
                if block[i] != now:
                    if held:
                        own = np.sort(np.concatenate(held))
                        yield from found(own, own)
                    held, own, now = [], None, block[i]
                if not visitor[i]:
                    held.append(fp[i:j])
                    continue
                if own is None:
                    own, held = np.sort(np.concatenate(held)), []
                    yield from found(own, own)
                yield from found(np.sort(fp[i:j]), own)
        if held:
            own = np.sort(np.concatenate(held))
            yield from found(own, own)

    visited = map_arrow(nodes.select("fp"), visits, "block long, visitor boolean, fp long")
    return map_arrow(visited.repartition("block").sortWithinPartitions("block", "visitor"), pairs, "u long, v long")


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of one column, many at a time."""
    held: list[np.ndarray] = []
    for b in batches:
        held.append(b.column(0).to_numpy().view(U64))
        if sum(map(len, held)) >= FRONTIER:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def near_duplicates(docs: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id (smallest doc_id) of every row of docs."""
    base = cut(fingerprints(docs))
    nodes = cut(base.groupBy("fp").agg(F.min("doc_id").alias("rep")), shuffled=True)
    label = classes(links(nodes, budget, leaf)).withColumnRenamed("key", "fp")
    named = nodes.join(label, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    # most fingerprints are of one row: the table by fingerprint is no smaller than that of rows
    return base.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
