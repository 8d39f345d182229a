"""Grouped k-means against numpy from the same start, and rebalancing against the greedy rule run plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.operators import clusters as c


def greedy(labels, sims, least, most):
    """The rule of rebalance, one move at a time; labels: id -> cluster, sims: id -> cosines."""
    labels, k = dict(labels), len(next(iter(sims.values())))
    members = lambda x: [i for i in sorted(labels) if labels[i] == x]
    while over := [x for x in range(k) if len(members(x)) > most]:
        source = max(over, key=lambda x: len(members(x)))
        room = [x for x in range(k) if len(members(x)) < most]
        if not room:
            raise ValueError
        _, i, to = min((round(sims[i][source] - sims[i][d], 9), i, d) for i in members(source) for d in room)
        labels[i] = to
    while under := [x for x in range(k) if len(members(x)) < least]:
        to = min(under, key=lambda x: (len(members(x)), x))
        donors = [x for x in range(k) if len(members(x)) > least]
        if not donors:
            raise ValueError
        _, i, _ = min((round(sims[i][s] - sims[i][to], 9), i, s) for s in donors for i in members(s))
        labels[i] = to
    return labels


def members_of(spark, families):
    rows = [(f, i, int(labels[i]), [float(x) for x in sims[i]]) for f, (labels, sims) in families.items() for i in labels]
    return spark.createDataFrame(rows, "family string, id long, cluster long, sims array<double>")


def family(seed, n, k, spread, digits):
    rng = np.random.default_rng(seed)
    sims = {i: np.round(rng.uniform(-1, 1, k), digits).tolist() for i in range(n)}
    share = rng.dirichlet(np.full(k, spread))
    return {i: int(rng.choice(k, p=share)) for i in range(n)}, sims


def test_rebalance_is_the_greedy_rule(spark):
    # one decimal makes many ties; a small spread leaves clusters empty and others crowded
    families = {"a": family(1, 40, 4, 0.3, 1), "b": family(2, 60, 5, 0.2, 9), "c": family(3, 33, 3, 5, 0), "d": ({i: 0 for i in range(36)}, family(4, 36, 4, 1, 1)[1])}
    out = c.rebalance(members_of(spark, families), 6, 13).collect()
    for f, (labels, sims) in families.items():
        assert {r.id: r.cluster for r in out if r.family == f} == greedy(labels, sims, 6, 13), f


def test_rebalance_errors(spark):
    with pytest.raises(ValueError, match="none with room"):
        c.rebalance(members_of(spark, {"a": family(1, 30, 2, 1, 2)}), 2, 10)
    with pytest.raises(ValueError, match="none that can give"):
        c.rebalance(members_of(spark, {"a": family(1, 10, 4, 1, 2)}), 5, 10)


def lloyd(x, start, rounds):
    now = start
    for _ in range(rounds):
        at = np.argmin(np.round((now * now).sum(1)[None] - 2 * x @ now.T, 12), axis=1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else now[j] for j in range(len(now))])
        if np.abs(new - now).max() <= 1e-9:
            break
        now = new
    return np.argmin(np.round((now * now).sum(1)[None] - 2 * x @ now.T, 12), axis=1), now


def test_families_iterate_like_numpy(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = {f: rng.normal(size=(n, 6)) + 2 * rng.normal(size=(4, 6))[rng.integers(0, 4, n)] for f, n in (("x", 90), ("y", 50), ("z", 25))}
    rows = [(f, 1000 * k + i, [float(v) for v in x]) for k, (f, m) in enumerate(data.items()) for i, x in enumerate(m)]
    df = spark.createDataFrame([*rows, ("x", 9999, None), (None, 9998, [0.0] * 6)], "fam string, key long, vec array<double>").repartition(3)
    counts = spark.createDataFrame([("x", 90, 4), ("y", 50, 3), ("z", 25, 2)], "family string, n long, k long")
    unit = {f: m / np.linalg.norm(m, axis=1, keepdims=True) for f, m in data.items()}
    starts = spark.createDataFrame([(f, j, [float(v) for v in unit[f][j]]) for f, _, k in counts.collect() for j in range(k)], "family string, cluster long, vector array<double>")
    monkeypatch.setattr(c, "CENTRE_BYTES", 6 * 8 * 5)  # two blocks of families
    members, centres = c.family_kmeans(df, "fam", "key", "vec", counts, starts=starts, iterations=30)
    got = {r.id: r for r in members.collect()}
    for k, (f, m) in enumerate(unit.items()):
        want, final = lloyd(m, m[: {"x": 4, "y": 3, "z": 2}[f]], 30)
        assert [got[1000 * k + i].cluster for i in range(len(m))] == want.tolist()
        assert np.allclose(np.array([r.vector for r in centres.where(F.col("family") == f).orderBy("cluster").collect()]), final, atol=1e-9)
        assert np.allclose(np.array([got[1000 * k + i].sims for i in range(len(m))]), m @ c.normalised(final).T, atol=1e-8)
    assert len(got) == 165


def test_family_batches(spark):
    rng = np.random.default_rng(8)
    sizes = {"big": 61, "mid": 20, "small": 3}
    rows = [(f, 100 * k + i, [float(v) for v in rng.normal(size=5)]) for k, (f, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "fam string, key long, vec array<double>")
    out = c.family_batches(df, "fam", "key", "vec", 8, 12, 16)
    count = {(r.family, r.cluster): r["count"] for r in out.groupBy("family", "cluster").count().collect()}
    assert {f: sum(n for (g, _), n in count.items() if g == f) for f in sizes} == sizes
    assert all(8 <= n <= 16 for (f, _), n in count.items() if f != "small") and len({k for k in count if k[0] == "big"}) == 5
    again = c.family_batches(df.repartition(7), "fam", "key", "vec", 8, 12, 16)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        c.family_batches(df, "fam", "key", "vec", 15, 15, 16)
    coherence = c.batch_coherence(out, df, "key", "vec").collect()
    x = {r[1]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    batch = {}
    for r in out.collect():
        batch.setdefault((r.family, r.cluster), []).append(x[r.id])
    for r in coherence:
        m = np.array(batch[r.family, r.cluster])
        cos = m @ (m.mean(0) / np.linalg.norm(m.mean(0)))
        assert np.allclose([r.n, r.mean_cos, r.p10_cos, r.min_cos], [len(m), cos.mean(), np.quantile(cos, 0.1), cos.min()], atol=1e-8)


def test_ranks_in_parts(spark):
    df = spark.range(500).selectExpr("id % 3 as g", "hash(id) % 50 as v", "id")
    out = c.ranked_in_parts(df, ["g"], F.floor(F.col("v") / 7), [F.col("v"), F.col("id")], "rank").collect()
    for g in range(3):
        assert [r["rank"] for r in sorted((r for r in out if r.g == g), key=lambda r: (r.v, r.id))] == list(range(1, 1 + sum(r.g == g for r in out)))
