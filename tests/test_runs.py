"""The report of two runs against plain Python; a subset by three keys in its original order."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.operators import runs, sampling

SCHEMA = "dataset string, case_id long, status string, gold string, prediction string, correct boolean, steps array<string>, templates array<string>, artifacts array<string>, reviews array<struct<decision:string,steps:array<string>>>, calls int, similarities array<double>"


def record(i, seed):
    rng, base = random.Random(seed * 1000 + i), random.Random(i)
    same = lambda make, p=0.7: make(base if rng.random() < p else rng)
    words = lambda r, n=4: [r.choice("abc") for _ in range(r.randrange(n))]
    gold = base.choice(["support", "reject"])
    said = rng.choice(["support", "reject", gold, gold, None])
    reviews = same(lambda r: [(r.choice(["continue", "revise", "final_answer"]), words(r)) for _ in range(r.randrange(4))])
    return ("hk", i, rng.choice(["ok"] * 5 + ["error"]), gold, said, said == gold, same(words), same(words), same(words), reviews, rng.randrange(9), [round(rng.random(), 3) for _ in range(rng.randrange(3))])


def contexts(r, most=4):
    remaining, out = list(r[6]), []
    for i, (what, steps) in enumerate(r[9]):
        if i < len(r[8]):
            remaining = remaining[1:]
            shown, n = tuple(remaining), i + 1
        else:
            shown, n = (), len(r[8])
        out.append((what, (tuple(r[8][:n]), shown, i >= len(r[8]) or not shown or n >= most)))
        if what == "revise":
            remaining = list(steps)
    return out


def f1(pairs, side):
    total = 0
    for x in ("support", "reject"):
        true = sum(a[3] == x for a, _ in pairs)
        hit, said = sum(a[3] == x == p[side][4] for p in pairs for a in [p[0]]), sum(p[side][4] == x for p in pairs)
        total += true * (2 * hit / max(1, true + said))
    return total / max(1, sum(a[3] in ("support", "reject") for a, _ in pairs))


def plain(left, right):
    a, b = {r[1]: r for r in left}, {r[1]: r for r in right}
    pairs = [(a[i], b[i]) for i in a.keys() & b.keys() if a[i][2] == b[i][2] == "ok"]
    out = {("coverage", k): v for k, v in {"left_records": len(a), "right_records": len(b), "left_ok": sum(r[2] == "ok" for r in left), "right_ok": sum(r[2] == "ok" for r in right), "left_only": len(a.keys() - b.keys()), "right_only": len(b.keys() - a.keys()), "excluded_not_ok": len(a.keys() & b.keys()) - len(pairs)}.items()}
    counts = Counter()
    for x, y in pairs:
        bucket = {(True, True): "both_correct", (True, False): "left_only", (False, True): "right_only"}.get((x[5], y[5]), "both_wrong")
        cx, cy = contexts(x), contexts(y)
        last = lambda c: next((s for w, s in reversed(c) if w == "final_answer"), None)
        flags = {"plan_equal": x[6] == y[6], "templates_equal": x[7] == y[7], "first_artifact_equal": x[8][:1] == y[8][:1], "first_context_equal": (cx[0][1] if cx else None) == (cy[0][1] if cy else None), "artifacts_equal": x[8] == y[8], "final_context_equal": last(cx) == last(cy)}
        category = bucket
        if bucket in ("left_only", "right_only"):
            reason = next((n for f, n in (("final_context_equal", "same_final_review_context"), ("artifacts_equal", "same_artifacts"), ("first_context_equal", "same_first_review_context")) if flags[f]), "same_plan_and_templates" if flags["plan_equal"] and flags["templates_equal"] else "changed_trajectory")
            category = f"{reason}_{'regression' if bucket == 'left_only' else 'improvement'}"
        counts.update([("outcomes", bucket), ("categories", category), *[("agreement", f) for f, v in flags.items() if v]])
        if x[4] != y[4]:
            counts[("flips", f"{x[4] or 'none'}->{y[4] or 'none'}")] += 1
    out |= counts | {("agreement", f): counts[("agreement", f)] for f in runs.FLAGS}
    mean = lambda v: sum(v) / len(v) if v else None
    m = {"n": len(pairs)}
    for k, side in enumerate(("left", "right")):
        m |= {f"{side}_accuracy": mean([p[k][5] for p in pairs]), f"{side}_mean_calls": mean([p[k][10] for p in pairs]), f"{side}_mean_executed": mean([len(p[k][8]) for p in pairs]), f"{side}_mean_similarity": mean([mean(p[k][11]) for p in pairs if p[k][11]]), f"{side}_weighted_f1": f1(pairs, k)}
    m |= {f"{x}_delta": m[f"right_{x}"] - m[f"left_{x}"] for x in ("accuracy", "weighted_f1")}
    return out | {("metrics", k): v for k, v in m.items()}


def test_report(spark):
    left, right = [record(i, 1) for i in range(150)], [record(i, 2) for i in range(10, 170)]
    frames = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
    got = {(r.section, r["name"]): r.value for r in runs.report(*frames, ["dataset", "case_id"]).collect()}
    want = plain(left, right)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert sum(k[0] == "categories" for k in got) >= 6
    other = spark.createDataFrame([(*r[:3], "other", *r[4:]) for r in right], SCHEMA)
    with pytest.raises(Exception, match="gold differs: hk/"):
        runs.report(frames[0], other, ["dataset", "case_id"]).collect()
    twice = frames[0].unionAll(frames[0].limit(1))
    with pytest.raises(Exception, match="repeated"):
        runs.paired(twice, frames[1], ["dataset", "case_id"]).collect()


def test_subset_keeps_the_order(spark):
    rows = [(f"case-{i}", i, "support" if i % 2 else "reject", "procedure" if i % 3 else None, "laws_only" if i % 4 else "none") for i in range(40)]
    df = spark.createDataFrame(rows, "case_id string, at int, gold string, domain string, authority string")
    out = sampling.ordered_subset(df.repartition(5), ["gold", "domain", "authority"], "case_id", "at", 13, "dev")
    got = [tuple(r) for r in out.orderBy("place").select("case_id", "at", "place").collect()]
    assert len(got) == 13 and [g[1] for g in got] == sorted(g[1] for g in got) and [g[2] for g in got] == list(range(1, 14))
    strata = Counter((r[2], r[3] or "unknown", r[4]) for r in rows)
    chosen = Counter((r.gold, r.domain or "unknown", r.authority) for r in out.collect())
    assert all(abs(chosen[s] - 13 * n / 40) < 1 for s, n in strata.items())
    again = sampling.ordered_subset(df.orderBy(F.desc("at")), ["gold", "domain", "authority"], "case_id", "at", 13, "dev")
    assert {r.case_id for r in again.collect()} == {g[0] for g in got}
