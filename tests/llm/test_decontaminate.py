import random
import re

import pytest

from sievemill.llm import decontaminate as d

DOCS = "doc_id long, text string, item_id int, extra string"
ITEMS = "item_id long, text string, doc_id int"


def shingle_set(text, k=5):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, items, threshold=0.8):
    out = []
    for i, t, *_ in docs:
        for j, u, *_ in items:
            m = min(5, len(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (u or "").lower())))
            a, b = shingle_set(t, m), shingle_set(u, m)
            if b and len(a & b) >= threshold * len(b):
                out.append((i, j, len(b), len(a & b)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 6, 15, 40, 60])), 0) for i in range(40)] + [(90, None, 0), (91, "", 0), (92, "two words", 0), (7, text(20), 0)]
    docs = [(i, text(rng.choice([0, 1, 4, 30, 900])), 0, "") for i in range(60)]
    for i in range(60, 110):
        _, t, _ = items[i % 40]
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "changed"
        docs.append((i, text(200) + "\n" + " ".join(w).upper() * (1 + i % 2) + ", " + text(3000), 0, ""))
    docs += [(200, None, 0, ""), (201, "", 0, ""), (202, "Two, words!", 0, ""), (203, text(50) + ", Two words; " + text(2000), 0, ""), (204, "two wordsandmore two", 0, ""), (None, items[0][1], 0, ""), (60, docs[60][1], 0, "")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [32 << 20, 4000])
def test_equals_brute_force(spark, block_bytes):
    docs, items = cases()
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = d.contaminations(a, b, block_bytes=block_bytes).collect()
    assert sorted([(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got], key=str) == brute([(i, re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""), 0) for i, t, *_ in docs], items)
    leaks = {r.doc_id for r in got}
    kept = d.keep_clean(a, b, block_bytes=block_bytes)
    assert kept.columns == a.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([i for i, *_ in docs if i not in leaks], key=str)


def test_empty_tables(spark):
    docs, items = cases()
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert d.contaminations(a.limit(0), b).count() == 0
    assert d.contaminations(a, b.limit(0)).count() == 0
    assert d.keep_clean(a, b.limit(0)).count() == len(docs)


def test_many_items_alike(spark):
    # items that share shingles, repeat words, and differ by a word
    items = [(i, "a b a b a b a b " + " ".join(f"x{j}" for j in range(i, i + 12)), 0) for i in range(30)]
    docs = [(i, "intro words " + items[i][1] + " b a b a " + items[(i + 1) % 30][1], 0, "") for i in range(30)] + [(100, "a b " * 5000, 0, "")]
    got = d.contaminations(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted([(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got], key=str) == brute(docs, items)
