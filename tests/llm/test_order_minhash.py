import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sievemill.llm import components
from sievemill.llm import order_minhash as o


def tokens(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(w, k=5):
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, rng.choice([2, 5, 50]), rng.integers(0, 30)).astype(np.uint64)
        b = a.copy() if rng.random() < 0.5 else rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
        for _ in range(rng.integers(0, 4)):
            if len(b):
                at = rng.integers(0, len(b))
                b = np.delete(b, at) if rng.random() < 0.5 else np.insert(b, at, rng.integers(0, 50))
        want = levenshtein(a.tolist(), b.tolist())
        for limit in (0, 1, 3, 60):
            assert o.edit_distance(a, b, limit) == (want if want <= limit else limit + 1)


def test_signatures_see_order_and_occurrences():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    zero = np.zeros(200, np.int64)
    a = o.signatures(o.labelled(h, zero), 64)
    b = o.signatures(o.labelled(h[::-1].copy(), zero), 64)
    assert (a == o.signatures(o.labelled(h.copy(), zero), 64)).all() and (a == b).mean() < 0.2
    twice = np.concatenate([h, h])
    assert (o.signatures(o.labelled(twice, np.zeros(400, np.int64)), 64) == a).mean() < 0.7


def brute(docs, threshold=0.8):
    words = [tokens(t) for _, t, *_ in docs]
    sets = [shingle_set(w) for w in words]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            n = max(len(words[i]), len(words[j]))
            if words[i] == words[j] or (a and b and len(a & b) >= threshold * len(a | b) and levenshtein(words[i], words[j]) <= (1 - threshold) * n + 1e-9):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [docs[i][0] for i in g if docs[i][0] is not None]
        out += [(docs[i][0], min(ids, default=None), len(g)) for i in g]
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)] + [f"é{i}" for i in range(50)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, passage = [], text(60)
    for g in range(12):
        base = text(rng.choice([120, 200, 400]))
        for c in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2]) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            sep = rng.choice([" ", ", ", "\n"])
            docs.append((len(docs), sep.join(w) if rng.random() < 0.7 else sep.join(w).upper()))
    docs += [(200 + i, " ".join(text(150) + passage + text(150))) for i in range(15)]  # a common passage is no near copy
    docs += [(300, None), (301, ""), (302, " .,\n"), (303, "one two"), (304, "One, two."), (305, "one two three"), (306, "x " * 20000), (0, docs[0][1]), (None, docs[3][1]), (None, "a text without an id"), (5, "the id of another text, six words")]
    df = spark.createDataFrame([(i, t, b"", 0) for i, t in docs], "doc_id long, text string, key binary, class_id int").repartition(4)
    got = sorted([tuple(r) for r in o.near_duplicates(df).collect()], key=str)
    assert got == brute(docs)
    kept = o.keep_one(df)
    assert kept.columns == df.columns
    n = Counter(r.doc_id for r in kept.collect())
    want = {i for i, c, _ in brute(docs) if i is not None and i == c}
    assert set(n) - {None} == want and all(v == 1 for k, v in n.items() if k is not None) and n[None] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert o.near_duplicates(df).count() == 0 and o.keep_one(df).count() == 0


def test_classes_of_chains_and_stars(spark):
    k = lambda i: i.to_bytes(2, "big")
    edges = [(k(i), k(i + 1)) for i in range(60)] + [(k(100), k(i)) for i in range(101, 140)] + [(k(200), k(200))]
    out = {r.key: r.label for r in o.classes(spark.createDataFrame(edges, "key binary, centre binary")).select(F.hex("key").alias("key"), F.hex("label").alias("label")).collect()}
    assert all(out[k(i).hex().upper()] == "0000" for i in range(1, 61))
    assert all(out[k(i).hex().upper()] == "0064" for i in range(101, 140))


def drifting(rng, groups, size, length=100):
    """Texts of groups in which each differs from the one before by a few words: far ends are not similar."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        w = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            out.append((len(out), " ".join(w)))
            w = list(w)
            at = rng.randrange(length - 3)
            w[at : at + 3] = [rng.choice(vocabulary) for _ in range(3)]
    return out


def test_chains_under_common_centres_lose_no_link(spark):
    docs = drifting(random.Random(3), 6, 14)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted([tuple(r) for r in o.near_duplicates(df).collect()], key=str) == brute(docs)


def test_exact_search_finds_all_links_across_classes(spark, monkeypatch):
    monkeypatch.setattr(o, "BLOCK", 2)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = drifting(rng, 3, 6) + [(100 + i, f"{passage} " + " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(60))) for i in range(12)]
    k = lambda i: i.to_bytes(2, "big")
    texts = o.cut(spark.createDataFrame([(k(i), o.Text.of(t).words.tobytes()) for i, t in docs], "key binary, words binary"))
    tested = spark.createDataFrame([(k(0), k(1))], "key binary, centre binary")
    got = {(int.from_bytes(r.key, "big"), int.from_bytes(r.centre, "big")) for r in o.rest(texts.select("key", F.col("key").alias("label")), tested, texts, 0.8).collect()}
    want = {(i, j) for i, t in docs for j, u in docs if i < j and o.similar(o.Text.of(t), o.Text.of(u), 0.8)} - {(0, 1)}
    assert got == want and len(want) > 10


def test_no_nodes_no_links(spark):
    none = spark.createDataFrame([], "key binary, label binary")
    assert o.rest(none, none.select("key", F.col("label").alias("centre")), spark.createDataFrame([], "key binary, words binary"), 0.8).count() == 0


def test_classes_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 7)
    rng = random.Random(6)
    k = lambda i: i.to_bytes(2, "big")
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(500 + i, 501 + i) for i in range(90)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = spark.createDataFrame([(k(a), k(b)) for a, b in edges], "key binary, centre binary").repartition(6)
    got = {(int.from_bytes(r.key, "big"), int.from_bytes(r.label, "big")) for r in o.classes(rows).collect()}
    assert got == {(i, find(i)) for i in {x for e in edges for x in e} if find(i) != i}


def test_filter_has_no_false_negatives(spark):
    ids = spark.range(5000).select(F.xxhash64("id").alias("rid"))
    test = o.maybe_in(ids)
    assert ids.where(test("rid")).count() == 5000
    assert spark.range(5000, 25000).select(F.xxhash64("id").alias("rid")).where(test("rid")).count() < 1000
    assert ids.where(o.maybe_in(ids.limit(0))("rid")).count() == 0


def test_edits_of_a_repeated_line_are_found(spark):
    rng = random.Random(5)
    docs = []
    for g in range(30):
        own, line = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60)], [f"l{g}x{rng.randrange(10**6)}" for _ in range(12)]
        docs.append((2 * g, " ".join(own + line * 20)))
        docs.append((2 * g + 1, " ".join(own + (line[:6] + ["changed"] + line[7:]) * 20)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert [r[2] for r in want] == [2] * 60
    assert sorted([tuple(r) for r in o.near_duplicates(df).collect()], key=str) == want


def test_bands_of_a_set_do_not_see_order_or_repetitions():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    bands = lambda h: o.all_bands(lab := o.labelled(h, np.zeros(len(h), np.int64)), lab == o.mix(h ^ o.FIRST), 20, 2)
    a, order = bands(h)
    b, other = bands(h[::-1].copy())
    assert len(a) == len(order) == 20 and (a == b).all() and (order == other).mean() < 0.2
    assert (order == o.banded(o.signatures(o.labelled(h, np.zeros(200, np.int64)), 40), 20, 2)).all()
    twice, labelled = bands(np.concatenate([h, h[:150]]))
    assert len(twice) == len(labelled) == 40 and (twice[:20] == a).all() and (twice[20:] == labelled[20:]).all()


def test_keep_one_keeps_a_text_of_every_class_where_ids_repeat(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    docs = [(7, a), (7, b), (3, b), (9, a + " more"), (4, c), (4, c), (4, c.upper()), (5, c), (7, text()), (8, text())]
    df = spark.createDataFrame([(t, i, {"k": t[:5]}) for i, t in docs], "text string, doc_id int, extra map<string,string>")
    for n in (1, 5):
        kept = o.keep_one(df.repartition(n))
        assert kept.schema.names == df.schema.names and kept.dtypes == df.dtypes
        rows = kept.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted([(7, a), (3, b), (4, min(c, c.upper())), docs[8], docs[9]])
        assert all(r.extra == {"k": r.text[:5]} for r in rows)
