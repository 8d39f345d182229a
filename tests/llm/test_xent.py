import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.llm import xent as x


def brute(docs, good, fold):
    lower = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    pad = lambda b: [None] * (x.N - 1) + list(b)

    def counted(texts):
        c, n, size = Counter(), Counter(), 0
        for b in texts:
            p = pad(b)
            size += len(b)
            for i in range(x.N - 1, len(p)):
                for k in range(1, x.N + 1):
                    g = tuple(p[i - k + 1 : i + 1])
                    c[g] += 1
                    n[g[:-1]] += 1
        return c, n, size

    out = []
    for f in range(x.FOLDS):
        background, target = counted(lower(t) for i, t in docs if fold[i] != f), counted(lower(t) for i, t in docs if fold[i] != f and i in good)
        types = Counter(g[:-1] for g in background[0])

        def p(model, g, w):
            q = p(model, g[1:], w) if len(g) > 1 else 1 / 257
            m = types[g[:-1]]
            return (w * model[0][g] + m * q) / (w * model[1][g[:-1]] + m) if m else q

        share = target[2] / background[2]
        for i, t in docs:
            if fold[i] == f:
                b = pad(lower(t))
                d = [math.log2(p(target, g, 1.0)) - math.log2(p(background, g, share)) for g in (tuple(b[j - x.N + 1 : j + 1]) for j in range(x.N - 1, len(b)))]
                out.append((i, len(d), sum(d) / max(1, len(d)) if share else 0.0))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_ngrams", [8 << 20, 0])
def test_equals_brute_force(spark, broadcast_ngrams):
    docs = [(i, f"The good text number {i} reads well, it does.") for i in range(20)] + [(20 + i, f"JUNK !!! | {i} | é ☃ buy") for i in range(20)]
    docs += [(90, None), (91, ""), (92, "a"), (3, docs[3][1]), (None, "The good text"), (93, "long " * 3000)]
    labels = [(i, 1, 0) for i in range(0, 20, 2)] + [(i, 0, 0) for i in range(20, 30)] + [(30, 1, 1), (2, 1, 0), (None, 1, 0), (31, None, None)]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted([tuple(r) for r in x.scores(d, lab, broadcast_ngrams=broadcast_ngrams).collect()], key=str)
    fold = {r.doc_id: r.fold for r in d.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(x.FOLDS)).alias("fold")).collect()}
    assert set(fold.values()) == set(range(x.FOLDS))
    want = brute(docs, {i for i in range(0, 20, 2)}, fold)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    got, want = ({(g[0], g[1], round(g[2], 4)) for g in y} for y in (got, want))
    assert all(any(g[:2] == w[:2] and abs(g[2] - w[2]) < 2e-4 for w in want) for g in got)
    assert x.scores(d, lab.limit(0)).where("score <> 0").count() == 0
    assert x.scores(d.limit(0), lab).count() == 0


def test_labelled_documents_have_no_advantage(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    # half of the labels are withheld: good documents score alike whether their label is known or not
    out = x.scores(docs, labels.where("doc_id % 2 = 0")).join(labels, "doc_id").where("n_tokens >= 200").collect()
    middle = lambda rows: sorted(rows)[len(rows) // 2]
    known, withheld = ([r.score for r in out if r.quality == 1 and not r.toxic and r.doc_id % 2 == k] for k in (0, 1))
    assert len(known) > 50 and len(withheld) > 50 and abs(middle(known) - middle(withheld)) < 0.03
    assert middle([r.score for r in out if r.quality == 0]) < middle(withheld)
