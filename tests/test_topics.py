"""Topic families: terms, vocabulary and weights against plain Python, the SVD against a dense one, bisection."""

import math
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.operators import clusters
from sievemill.operators import topics as t

STOPS = ["the", "of", "and"]


def plain_terms(text):
    low = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    w = [x for x in re.findall(r"\w{2,}", low) if x not in STOPS]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def texts(n, seed=5):
    rng = random.Random(seed)
    themes = [[f"{p}{i}" for i in range(25)] for p in ("contract", "wage", "land", "ship")]
    common = [f"word{i}" for i in range(30)] + STOPS
    return [(i, " ".join(rng.choice(themes[i % 4] if rng.random() < 0.5 else common) for _ in range(40)) + ("." if i % 3 else " Été àgé")) for i in range(n)]


def plain_matrix(rows, min_df, max_df, most):
    tf = {i: Counter(plain_terms(x)) for i, x in rows}
    df, total = Counter(), Counter()
    for c in tf.values():
        df.update(c.keys())
        total.update(c)
    kept = sorted((w for w in df if min_df <= df[w] <= max_df * len(rows)), key=lambda w: (-total[w], w))[:most]
    words = sorted(kept)
    m = np.zeros((len(rows), len(words)))
    for k, (i, _) in enumerate(rows):
        for j, w in enumerate(words):
            if tf[i][w]:
                m[k, j] = (1 + math.log(tf[i][w])) * (math.log((1 + len(rows)) / (1 + df[w])) + 1)
    return words, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def test_terms(spark):
    odd = ["Été, ÉTÉ naïve co-op x yz", None, "", "a b c", "Straße 12 ŵave_1 été"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, x string").select("id", t.terms(F.col("x"), STOPS).alias("t")).orderBy("id").collect()]
    assert got == [plain_terms(x) for x in odd]


def test_svd_is_the_dense_one(spark):
    rows = texts(120)
    words, dense = plain_matrix(rows, 3, 0.9, 150)
    docs = spark.createDataFrame(rows, "id long, x string").repartition(3)
    counts = docs.select("id", F.explode(t.terms(F.col("x"), STOPS)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    vocabulary = t.vocabulary(counts, len(rows), 3, 0.9, 150)
    assert [r.term for r in vocabulary.orderBy("j").collect()] == words
    matrix = t.term_matrix(counts, vocabulary)
    got = np.zeros_like(dense)
    for r in matrix.collect():
        for e in r.row:
            got[r.id, e.j] = e.w
    assert np.allclose(got, dense, atol=1e-12)
    values, vectors = t.truncated_svd(matrix, len(words), 8, rounds=25)
    _, s, vt = np.linalg.svd(dense)
    assert np.abs(values - s[:8]).max() < 1e-6
    # the first four stand apart from the rest, so their vectors are determined
    for k in range(4):
        assert abs(abs(vectors[:, k] @ vt[k]) - 1) < 1e-6
    y = {r.id: np.array(r.vector) for r in t.projected(matrix, vectors).collect()}
    want = dense @ vectors
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert all(np.allclose(y[i], want[i], atol=1e-9) for i in y) and len(y) == len(rows)


def test_families_of_texts(spark):
    docs = spark.createDataFrame([*texts(120), (900, None), (None, "no id")], "id long, x string")
    families, profile = t.topic_families(docs, "id", "x", 4, min_df=3, max_df=0.9, components=6, stop_words=STOPS)
    by = {}
    for r in families.collect():
        by.setdefault(r.family, Counter())[r.id % 4] += 1
    assert len(by) == 4 and sum(c.most_common(1)[0][1] for c in by.values()) >= 115
    theme = {0: "contract", 1: "wage", 2: "land", 3: "ship"}
    for r in profile.collect():
        name = theme[by[r.family].most_common(1)[0][0]]
        assert sum(w.startswith(name) for w in r.top_terms) >= 8 and len(r.representatives) == 5
    with pytest.raises(ValueError):
        t.topic_families(docs.limit(2), "id", "x", 2)


def test_representatives(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), i, [float(v) for v in np.round(rng.normal(size=3), 1)]) for i, g in enumerate(rng.integers(0, 3, 60))] + [(7, 99, [0.0, 0.0, 0.0]), (7, 100, None)]
    got = [tuple(r) for r in t.representatives(spark.createDataFrame(rows, "g int, id long, v array<double>"), "g", "id", "v", 4).collect()]
    want = []
    for g in {r[0] for r in rows}:
        m = [(i, np.array(v)) for h, i, v in rows if h == g and v is not None]
        c = sum(v for _, v in m)
        score = [(-round(float(v @ c / (np.linalg.norm(v) * np.linalg.norm(c))) if v.any() and c.any() else 0.0, 6), i) for i, v in m]
        want += [(g, k + 1, i, -s) for k, (s, i) in enumerate(sorted(score)[:4])]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want)
    assert np.allclose([x[3] for x in sorted(got)], [x[3] for x in sorted(want)], atol=2e-6)


def test_norms_of_long_rows_are_formed_once(spark):
    counts = spark.range(30_000).select(F.lit(1).alias("id"), F.col("id").cast("string").alias("term"), F.lit(1).alias("tf"))
    words = counts.select("term", F.col("term").cast("long").alias("j"), F.lit(1.0).alias("idf"))
    start = time.time()
    row = t.term_matrix(counts, words).first()["row"]
    assert abs(sum(x["w"] ** 2 for x in row) - 1) < 1e-9
    vector = clusters.unit(spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda x: x.cast("double")).alias("vector"))).first()["vector"]
    assert abs(sum(x * x for x in vector) - 1) < 1e-9
    # a sum of squares for each of the 30,000 entries would take minutes
    assert time.time() - start < 30


def odd_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["a", "the", "Été", "été", "é"]
    made = [(i, " ".join(rng.choice(words[: 5 + i % 40]) for _ in range(rng.randrange(0, 60)))) for i in range(700)]
    return [*made, (900, None), (901, ""), (902, "a b c"), (903, "w1 " * 300), (904, "w1 x w2"), (None, "w1 w2")]


@pytest.mark.parametrize("most, pairs", [(25, 1 << 22), (60, 50), (5000, 1)])
def test_coded_texts_give_the_matrix_of_rows(spark, monkeypatch, most, pairs):
    monkeypatch.setattr(t, "PAIRS", pairs)
    rows = odd_texts()[:-1]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    words, dense = plain_matrix(rows, 4, 0.6, most)
    for made in (t.coded_matrix, t.term_rows):
        found, blocks = made(docs, len(rows), 4, 0.6, most, STOPS)
        assert found["term"].to_pylist() == words and found["j"].to_pylist() == list(range(len(words)))
        got = np.zeros((1000, len(words)))
        ids = []
        for r in blocks.collect():
            n, j, w = np.frombuffer(r.n, np.int64), np.frombuffer(r.j, np.int32), np.frombuffer(r.w)
            assert r.names == [str(i) for i in r.ids] and len(n) == len(r.ids) <= t.CHUNK and n.sum() == len(j) == len(w)
            got[np.repeat(r.ids, n), j] += w
            ids += r.ids
        assert np.allclose(got[[i for i, _ in rows]], dense, atol=1e-12)
        assert sorted(ids) == [i for k, (i, _) in enumerate(rows) if dense[k].any()]


def test_no_term_of_a_text_is_a_row(spark, monkeypatch):
    seen = []
    plain = t.cut
    monkeypatch.setattr(t, "cut", lambda df, **how: seen.append(plain(df, **how)) or seen[-1])
    monkeypatch.setattr(t, "release", lambda *tables: None)
    docs = texts(300)
    families, _ = t.topic_families(spark.createDataFrame(docs, "id long, x string"), "id", "x", 4, min_df=3, max_df=0.9, max_features=100, components=6, stop_words=STOPS)
    assert families.count() == 300
    words = {w for _, x in docs for w in plain_terms(x) if " " not in w}
    # the 300 texts have 19,000 different terms
    assert seen and sum(df.count() for df in seen) <= len(words) + 300


def test_ids_of_several_texts_and_words_beyond_the_bound(spark, monkeypatch):
    one = spark.createDataFrame(texts(120), "id long, x string")
    both = one.unionAll(one.where("id < 60"))
    ask = lambda docs: t.topic_families(docs, "id", "x", 4, min_df=3, max_df=0.9, components=6, stop_words=STOPS)
    families, profile = ask(both)
    assert sorted(r.id for r in families.collect()) == list(range(120)) and sum(r.n for r in profile.collect()) == 120
    want = [sorted(map(tuple, df.collect())) for df in ask(one)]
    monkeypatch.setattr(t, "WORDS", 3)
    assert [sorted(map(tuple, df.collect())) for df in ask(one)] == want


def test_sparse_chunks_are_dense_ones():
    rng = np.random.default_rng(4)
    for width in (8, 1000):
        n = np.array([3, 0, 5, 1])
        j = np.concatenate([np.sort(rng.choice(width, k, replace=False)) for k in n])
        w, right = rng.normal(size=9), rng.normal(size=(width, 3))
        want = np.zeros((4, width))
        want[np.repeat(np.arange(4), n), j] = w
        zeros, total = np.zeros((6, width)), np.ones((width, 3))
        got = t.Chunk(n, j, w, zeros)
        assert (got.dense is None) == (width == 1000)
        assert np.allclose(got.times(right), want @ right)
        got.add_transposed(want @ right, total)
        assert np.allclose(total, 1 + want.T @ want @ right)
        got.clear()
        assert not zeros.any()


def test_equal_texts_stay_one_family(spark):
    docs = spark.createDataFrame([(i, "one two three" if i < 50 else "four five six") for i in range(60)], "id long, x string")
    families, profile = t.topic_families(docs, "id", "x", 4, min_df=1, max_df=1.0, components=2)
    by = {}
    for r in families.collect():
        by.setdefault(r.family, set()).add(r.id < 50)
    assert sorted(map(sorted, by.values())) == [[False], [True]] and sorted(r.n for r in profile.collect()) == [10, 50]
