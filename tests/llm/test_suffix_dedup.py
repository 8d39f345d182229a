import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sievemill.llm import suffix_dedup as s


def brute(docs, length=400):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc_id, len(t), int(gone.sum()), int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [prose(rng.choice([399, 400, 401, 450, 700, 1500])) for _ in range(12)] + ["x" * 900, "ab" * 600]
    docs = [(i, prose(rng.randrange(0, 900))) for i in range(30)]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + "#" + p[at + rng.randrange(2) :]
            elif rng.random() < 0.3:
                p = p[rng.randrange(60) :]
            parts.append(p)
        docs.append((100 + i, prose(rng.randrange(0, 500)).join(["", *parts, ""])))
    copy = prose(2000)
    docs += [(300, copy), (301, copy), (301, copy), (302, copy[:1000] + "!" + copy[1000:]), (303, prose(3000) * 2), (304, "y" * 399), (305, "z" * 400), (306, "z" * 400)]
    return docs + [(400, None), (401, ""), (None, copy), (402, "w" * 401), (None, "short")]


@pytest.mark.parametrize("seed,group_runs,broadcast_bytes", [(1, 4096, 64 << 20), (2, 1, 64 << 20), (3, 4096, 0), (4, 2, 0)])
def test_equals_brute_force(spark, seed, group_runs, broadcast_bytes):
    docs = cases(seed)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, gram int, run string").repartition(4)
    got = sorted([tuple(r) for r in s.remove_repeats(df, group_runs, broadcast_bytes).collect()], key=str)
    want = brute(docs)
    assert got == want


def test_long_documents_in_pieces(spark, monkeypatch):
    docs = [(1, None)]
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    docs = [(1, long), (2, long[7000:9000]), (3, "q" + long[20_000:])]
    data, offsets = s.buffers(s.pa.array([t.encode() for _, t in docs], s.pa.binary()))
    starts = []
    for i, at, x, o in s.pieces(data, offsets, 1000):
        d, p, lo, hi, _, _ = s.anchor_runs(x, o)
        starts += [(int(i + a), int(at + b - o[a])) for a, f, l in zip(d, lo, hi) for b in range(f, l + 1)]
    assert sorted(starts) == [(n, a) for n, (_, t) in enumerate(docs) for a in range(len(t) - s.LENGTH + 1)]


def test_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 2000).astype(np.uint8)
    start = rng.integers(0, 1900, 300)
    size = rng.integers(0, 100, 300)
    group = np.sort(rng.integers(0, 20, 300))
    x = s.Suffixes(data, start, size, group)
    order, ext = x.sorted_with_extensions()
    text = lambda k: data[start[k] : start[k] + size[k]].tobytes()
    want = sorted(range(300), key=lambda k: (group[k], text(k)))
    assert [(group[k], text(k)) for k in order] == [(group[k], text(k)) for k in want]


def test_empty_table(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
