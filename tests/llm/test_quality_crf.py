import itertools

import numpy as np

from sievemill.llm import quality_crf as q
from sievemill.llm.textvec import buffers, doc_slices
import pyarrow as pa


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 1, 3, 3])
    emit, trans = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    good, pair, log_z = q.marginals(emit, doc, 4, trans)
    at = doc_slices(doc, 4)
    want_pair = np.zeros((2, 2))
    for d in range(4):
        e = emit[at[d] : at[d + 1]]
        if not len(e):
            continue
        paths = {p: np.exp(sum(e[i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product((0, 1), repeat=len(e))}
        z = sum(paths.values())
        assert np.isclose(log_z[d], np.log(z))
        for i in range(len(e)):
            assert np.isclose(good[at[d] + i], sum(v for p, v in paths.items() if p[i]) / z)
        for p, v in paths.items():
            for a, b in itertools.pairwise(p):
                want_pair[a, b] += v / z
    assert np.allclose(pair, want_pair)


def test_lines_of_texts():
    data, offsets = buffers(pa.array(["a b\n\nc", None, "", "x\n"]))
    f, doc, length = q.line_features(data, offsets)
    assert doc.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert length.tolist() == [3, 0, 1, 0, 0, 1, 0]
    assert np.isfinite(f).all()


def test_scores(spark):
    good = "The river rises early in spring, and the town keeps watch over it.\nBoats are tied up by the old mill."
    bad = "BUY!! NOW!! CHEAP!! DEALS!!\n| x | y | z | x | y"
    rows = [(i, good if i % 2 else bad, i) for i in range(60)] + [(100, None, 0), (101, "", 0), (102, "w " * 50_000, 0), (102, "w " * 50_000, 0), (None, good, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(100, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = q.quality_scores(docs, q.fit(docs, labels)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 60:
            assert r.predicted == r.doc_id % 2
    empty = docs.limit(0)
    assert q.quality_scores(empty, q.fit(empty, labels.limit(0))).count() == 0
    assert {r.doc_id for r in q.keep_good(docs, q.fit(docs, labels)).collect()} >= {1, 3, 5}


def test_held_out_labels_of_a_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in q.quality_scores(docs, q.fit(docs, labels)).collect()}
    held = [(out[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in out and out[r.doc_id].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.95 * len(held)
    # predictions do not say one thing only
    assert {y for _, y in held} == {p for p, _ in held} == {0, 1}


def test_labels_that_disagree_are_not_used(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i in range(30) for y in (0, 1)], "doc_id long, quality int, toxic int")
    assert q.fit(docs, labels) == {"rate": 0.5}
