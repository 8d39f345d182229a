import hashlib
import random

import numpy as np
import pytest

from sievemill.llm import line_dedup as d

WS = " \t\n\v\f\r"


def brute(docs, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    holders = {}
    for n, (i, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), [])) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def cases():
    rng = random.Random(3)
    common = ["This line is repeated in very many documents ☃ " + "é" * n for n in range(0, 60, 3)] + ["x" * 39, "x" * 40, "é" * 39, "é" * 40]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(0, 12)):
            x = rng.choice(common) if rng.random() < 0.6 else f"line {rng.random()} " * 4
            lines.append(rng.choice(["", " ", "\t\r"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\v ", "\x1f"]))
        docs.append((i, "\n".join(lines)))
    return docs + [(500, None), (501, ""), (502, "\n\n"), (503, common[0] * 5000)]


@pytest.mark.parametrize("broadcast_keys", [1 << 21, 0])
def test_equals_brute_force(spark, broadcast_keys):
    docs = cases()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_lines int, h string").repartition(5)
    got = sorted(tuple(r) for r in d.dedup_digest(df, broadcast_keys=broadcast_keys, shard_keys=4).collect())
    assert got == brute(docs)
    kept = d.drop_lines(df, broadcast_keys=broadcast_keys)
    assert kept.columns == df.columns
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()} == {r[0]: r[3] for r in brute(docs)}


@pytest.mark.parametrize("broadcast_keys", [1 << 21, 0])
def test_repeats_nulls_and_empty_tables(spark, broadcast_keys):
    line = "A line that is long enough to count as a key of its own."
    df = spark.createDataFrame([(9, line)] * 4 + [(None, line), (3, "short\n" + line)], "doc_id long, text string")
    got = sorted([tuple(r)[:3] for r in d.dedup_digest(df, broadcast_keys=broadcast_keys).collect()], key=str)
    assert got == sorted([(9, 1, 0)] * 4 + [(None, 1, 1), (3, 2, 1)], key=str)
    assert d.dedup_digest(df.limit(0), broadcast_keys=broadcast_keys).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        mph = d.PerfectHash(keys)
        assert np.array_equal(np.sort(mph.index(keys)), np.arange(len(keys)))


def test_equal_index_hashes_stay_apart():
    h, check = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    shard = d.Shard(h, check, np.array([7, 8, 9, 6]), np.array([70, 80, 90, 60]))
    there, last = shard.probe(np.array([5, 5, 5, 5, 9, 9, 1], np.uint64), np.array([1, 2, 4, 3, 3, 1, 1], np.uint64))
    assert there.tolist() == [True, True, True, False, True, False, False] and last[there].tolist() == [70, 80, 60, 90]


def test_routed_probes_with_several_salts(spark, monkeypatch):
    monkeypatch.setattr(d, "TASK_PROBES", 3)
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in d.dedup_digest(df, broadcast_keys=0, shard_keys=8).collect()) == brute(docs)
