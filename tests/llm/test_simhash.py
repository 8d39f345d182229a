"""SimHash against plain Python: fingerprints, links of the trie, components; blocks of any size."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sievemill.llm import simhash as s
from sievemill.llm.textvec import buffers, chunks

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(rows):
    """(doc_id, fingerprint, component) of (doc_id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], moved = label[j], True
    least = {c: min((r[0] for r, k in zip(rows, label) if k == c and r[0] is not None), default=None) for c in label}
    return [(r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label)]


def clustered(n, seed):
    """About n distinct fingerprints, many of them close."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, 20, dtype=np.uint64)[rng.integers(0, 20, n)]
    for _ in range(3):
        x = x ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(x)


TEXTS = [None, "", " \n", "One", "one", "two  words\n", "A\tb c D", "É é É", "x" * 30 + " y z " * 2000]


def test_fingerprints():
    data, offsets = buffers(pa.array(TEXTS, pa.string()))
    for limit in (1, 50, 1 << 21):
        got = [x for i, j, d, o in chunks(data, offsets, limit) for x in s.majority(*s.shingle_hashes(d, o), j - i).tolist()]
        assert got == [fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("n", [1, 3, 200, 1500])
def test_traversal(n, monkeypatch):
    monkeypatch.setattr(s, "FRONTIER", 100)
    a = clustered(n, n)
    b = np.setdiff1d(clustered(n, n + 1), a)
    near = lambda x, y: {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ y) <= 2).tolist()}
    flat = lambda found: [p for i, j in found for p in zip(i.tolist(), j.tolist())]
    got = flat(s.close_pairs(a, b))
    assert len(got) == len(set(got)) and set(got) == near(a, b)
    got = flat(s.close_pairs(a, a))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in near(a, a) if i < j}


@pytest.mark.parametrize("leaf", [1, 7, 100, 10_000])
def test_blocks_and_links(spark, leaf):
    x = np.unique(np.concatenate([clustered(400, 5), np.array([0, 1, 3, (1 << 64) - 1], np.uint64)]))
    nodes = spark.createDataFrame(pa.table({"fp": x.view(np.int64)}))
    starts, depths = s.blocks(nodes, leaf)
    home = np.searchsorted(starts, x, side="right") - 1
    assert all(int(v) >> (64 - int(d)) == int(p) >> (64 - int(d)) for v, p, d in zip(x, starts[home], depths[home]))
    assert np.bincount(home, minlength=len(starts)).max() <= leaf
    near = {(int(a), int(b)) for a in x for b in x if a < b and (int(a) ^ int(b)).bit_count() <= 2}
    got = {r.key: r.label for r in s.classes(s.links(nodes, leaf=leaf)).collect()}
    low = {int(v): int(v) for v in x.view(np.int64)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    moved = True
    while moved:
        moved = False
        for a, b in near:
            m = min(low[signed(a)], low[signed(b)])
            if low[signed(a)] != m or low[signed(b)] != m:
                low[signed(a)] = low[signed(b)] = m
                moved = True
    assert got == {k: v for k, v in low.items() if k != v}


def test_components(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(9, base), (3, base), (3, base), (3, "another text for the same id"), (None, base + " more"), (None, "nobody else has this"), (7, None), (5, ""), (None, None), (4, "One"), (8, "one "), (2, base.upper())]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, fp string, rep string, label string")
    out = [tuple(r) for r in s.near_duplicates(docs, leaf=2).collect()]
    assert sorted(out, key=str) == sorted(components(rows), key=str)
    assert s.near_duplicates(docs.limit(0)).collect() == []


def test_whole_table(spark):
    """The query's whole result on the smallest tables."""
    from sievemill.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_simhash_trie"](spark, SF).collect()) == sorted(components(rows))
