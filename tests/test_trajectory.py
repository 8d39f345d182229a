"""The call loop against a plain simulation over scripted fakes; resumed runs; the vector store; replay of reviews; lineage."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievemill.operators import lineage, review, store, trajectory

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
ITEMS = [("i1", "alpha", ["t1", "t2"]), ("i2", "beta", ["t2"]), ("i3", "gamma", ["t3"]), ("i4", "delta", ["t1"]), ("i5", "omega", ["t9"])]
LABELS = ["support", "reject"]


def script(case):
    """What the fakes say for a case, by its number alone."""
    rng = random.Random(case)
    step = lambda: {"name": rng.choice(["alpha", "beta", "nothing", "gamma"]), "tags": rng.sample(["t1", "t2", "t3", "t4"], rng.randrange(3))}
    plan = [step() for _ in range(rng.randrange(6))]
    reviews = [rng.choice(["continue", "continue", "revise", "final_answer", "fail" if rng.random() < 0.3 else "continue"]) for _ in range(8)]
    return {"plan": plan, "plan_fails": rng.random() < 0.1, "exec_fails": rng.choice([None, None, None, 0, 1]), "reviews": reviews, "revised": [step() for _ in range(rng.randrange(4))], "label": rng.choice([*LABELS, "perhaps"]), "forced": rng.choice(["final_answer", "final_answer", "continue"])}


def planner(records):
    return [RuntimeError("no plan") if script(r["case"])["plan_fails"] else script(r["case"])["plan"] for r in records]


def executor(records):
    return [ValueError(f"step {len(r['artifacts'])}") if script(r["case"])["exec_fails"] == len(r["artifacts"]) else f"{r['step']['name']}:{r['item']}:{len(r['artifacts'])}" for r in records]


def reviewer(records):
    out = []
    for r in records:
        s, n = script(r["case"]), len(r["artifacts"])
        what = s["forced"] if r["force"] else s["reviews"][n]
        out.append(TimeoutError() if what == "fail" else {"decision": what, "answer": s["label"] if what == "final_answer" else None, "steps": s["revised"] if what == "revise" else None})
    return out


def retrieve(step, used):
    free = [i for i in ITEMS if i[0] not in used] or ITEMS
    named = [i for i in free if i[1] == step["name"]]
    tagged = [i for i in free if set(i[2]) & set(step["tags"])]
    score = lambda i: len(set(i[2]) & set(step["tags"])) / max(1, len(step["tags"]))
    pool, mode = (named, "name") if named else (tagged, "tag") if tagged else (free, "full_pool")
    if len(pool) == 1 and mode != "full_pool":
        return pool[0][0], "exact_name" if named else "exact_tag_unique"
    best = max(pool, key=lambda i: (score(i), -ITEMS.index(i)))
    return best[0], {"name": "ambiguous_name", "tag": "tag_overlap"}.get(mode, mode)


def simulate(case, max_steps=4, review_each=True):
    s = script(case)
    calls, reviews, repairs, artifacts = 1, [], [], []
    done = lambda status, answer=None, error=None: (case, status, answer, error, [(a["item"], a["result"]) for a in artifacts], reviews, repairs, calls)
    if s["plan_fails"]:
        return done("error", error="no plan")
    remaining = s["plan"][:max_steps]
    while remaining and len(artifacts) < max_steps:
        step = remaining.pop(0)
        item, mode = retrieve(step, {a["item"] for a in artifacts})
        calls += 1
        if s["exec_fails"] == len(artifacts):
            return done("error", error=f"step {len(artifacts)}")
        artifacts.append({"item": item, "mode": mode, "result": f"{step['name']}:{item}:{len(artifacts)}"})
        if not review_each:
            continue
        calls += 1
        force = not remaining or len(artifacts) >= max_steps
        what = s["forced"] if force else s["reviews"][len(artifacts)]
        if what == "fail":
            return done("error", error="TimeoutError")
        reviews.append(what)
        if what == "final_answer":
            if s["label"] in LABELS:
                return done("ok", s["label"])
            repairs.append("final_answer_missing_label_forced_retry")
            break
        if what == "revise":
            remaining = s["revised"][: max_steps - len(artifacts)]
            repairs.append("remaining_trajectory_revised")
    if artifacts:
        calls += 1
        reviews.append(s["forced"])
        if s["forced"] == "final_answer":
            return done("ok", s["label"])
    return done("error", error="ended without a final answer")


def tables(spark, n):
    cases = spark.createDataFrame([(i, f"text {i}") for i in range(n)], "case long, text string").repartition(3)
    items = spark.createDataFrame([(i, n, t, k) for k, (i, n, t) in enumerate(ITEMS)], "item string, name string, tags array<string>, position int")
    return cases, items


def rows(out):
    return sorted((r.case, r.status, r.answer, r.error, [(a["item"], a["result"]) for a in r.artifacts], r.reviews, r.repairs, r.calls) for r in out.collect())


def test_loop_is_the_simulation(spark, tmp_path):
    cases, items = tables(spark, 120)
    want = sorted(simulate(i) for i in range(120))
    assert rows(trajectory.trajectories(cases, items, executor, reviewer, LABELS, str(tmp_path / "a"), planner)) == want
    assert {w[1] for w in want} == {"ok", "error"} and any("remaining_trajectory_revised" in w[6] for w in want) and any("final_answer_missing_label_forced_retry" in w[6] for w in want)
    # fixed trajectories: no review but the last
    fixed = trajectory.trajectories(cases, items, executor, reviewer, LABELS, str(tmp_path / "b"), planner, review_each=False)
    assert rows(fixed) == sorted(simulate(i, review_each=False) for i in range(120))
    given = cases.where("case < 9").withColumn("steps", F.array(F.struct(F.lit("alpha").alias("name"), F.array(F.lit("t1")).alias("tags"))))
    out = trajectory.trajectories(given, items, lambda r: ["x"] * len(r), lambda r: [{"decision": "final_answer", "answer": "reject", "steps": None}] * len(r), LABELS, str(tmp_path / "c"))
    assert [(w[0], w[2], w[4], w[7]) for w in rows(out)] == [(i, "reject", [("i1", "x")], 2) for i in range(9)]
    assert trajectory.trajectories(cases.limit(0), items, executor, reviewer, LABELS, str(tmp_path / "d"), planner).count() == 0


def test_a_killed_run_repeats_no_call_of_a_complete_stage(spark, tmp_path):
    cases, items = tables(spark, 40)
    log, flag = str(tmp_path / "calls"), str(tmp_path / "broken")
    open(flag, "w").close()

    def counted(name, call):
        def run(records):
            if name == "review" and os.path.exists(flag) and any(len(r["artifacts"]) == 2 for r in records):
                os._exit(1)  # the worker dies
            with open(log, "a") as f:
                f.writelines(f"{name} {r['case']} {len(r.get('artifacts') or [])}\n" for r in records)
            return call(records)

        return run

    args = (cases, items, counted("execute", executor), counted("review", reviewer), LABELS, str(tmp_path / "run"), counted("plan", planner))
    with pytest.raises(Exception):
        trajectory.trajectories(*args)
    os.remove(flag)
    assert rows(trajectory.trajectories(*args)) == sorted(simulate(i) for i in range(40))
    lines = open(log).read().splitlines()
    complete = [x for x in lines if not x.startswith("review")]
    assert len(complete) == len(set(complete)) and sum(x.startswith("plan") for x in complete) == 40
    # cases that end before the stage that was cut short: as many calls as the simulation makes
    early = [i for i in range(40) if len(simulate(i)[4]) < 2 and script(i)["exec_fails"] != 1]
    assert len(early) > 5 and all(sum(x.split()[1] == str(i) for x in lines) == simulate(i)[7] for i in early)


def test_replayed_reviews(spark, tmp_path):
    cases, items = tables(spark, 60)
    first = trajectory.trajectories(cases, items, executor, reviewer, LABELS, str(tmp_path / "a"), planner)
    ledger = first.join(cases, "case").select("case", "text", "answer", "artifacts")

    def again(records):
        assert all(r["force"] and r["remaining"] == [] and r["artifacts"] for r in records)
        return [KeyError("gone") if r["case"] % 10 == 1 else {"decision": "continue" if r["case"] % 10 == 2 else "final_answer", "answer": ["reject", "support", "what"][r["case"] % 3], "steps": None} for r in records]

    want = {}
    for i, _, answer, _, artifacts, *_ in map(simulate, range(60)):
        if artifacts:
            new = ["reject", "support", "what"][i % 3]
            error = "'gone'" if i % 10 == 1 else "ended without a final answer" if i % 10 == 2 else "the answer is no label" if new == "what" else None
            want[i] = (answer, "error" if error else "ok", None if error else new, error, None if error else answer != new)
    got = {r.case: tuple(r)[1:] for r in trajectory.replayed_reviews(ledger, again, LABELS, str(tmp_path / "b")).collect()}
    assert got == want


def test_store_encodes_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def encoder(texts):
        with open(seen, "a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        return np.array([[len(t), 1.0, t.count("a")] for t in texts])

    path, settings = str(tmp_path / "store"), {"model": "m", "length": 128}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, "", "c\n"])], "id int, t string")
    s = store.VectorStore(spark, path, settings, buckets=4)
    assert s.fill(df.where("id < 2"), "t", encoder) == (0, 2)
    assert s.fill(df, "t", encoder) == (2, 2) and s.fill(df, "t", encoder) == (4, 0)
    assert sorted(open(seen).read().splitlines()) == sorted(map(repr, ["a", "b", "", "c\n"]))
    again = store.VectorStore(spark, path, settings, buckets=4)
    got = {r.id: list(r.vector) for r in again.vectors(df, "id", "t").collect()}
    assert got[0] == got[2] and got[3] == got[4] and np.allclose(np.linalg.norm(got[5]), 1) and len(got) == 6
    with pytest.raises(ValueError, match="other settings.*model"):
        store.VectorStore(spark, path, {**settings, "model": "other"}, buckets=4)
    # the store is not shuffled: one exchange of the asking side for its distinct texts
    plan = again.missing(df, "t")._jdf.queryExecution().executedPlan().toString()
    scans = plan[plan.index("FileScan") - 600 :]
    assert "SelectedBucketsCount: 4 out of 4" in plan or "Bucketed: true" in scans
    with pytest.raises(Exception, match="another shape"):
        again.fill(spark.createDataFrame([(1, "new")], "id int, t string"), "t", lambda x: np.zeros((len(x), 2)))
    assert store.VectorStore(spark, path, {"model": "other"}, buckets=4, force=True).fill(df, "t", encoder) == (0, 4)
    h = store.corpus_hash(df, "id", "t")
    assert h == store.corpus_hash(df.repartition(3), "id", "t") != store.corpus_hash(df.where("id <> 3"), "id", "t")


def contexts(steps, artifacts, reviews, most):
    remaining, out = list(steps), []
    for i, r in enumerate(reviews):
        if r is None:
            continue
        if i < len(artifacts):
            remaining = remaining[1:]
            shown, executed = list(remaining), i + 1
        else:
            shown, executed = [], len(artifacts)
        out.append((r[0], i >= len(artifacts) or not shown or executed >= most, executed, shown))
        if r[0] == "revise":
            remaining = list(r[1] or [])
    return out


def test_replay(spark):
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdef") for _ in range(rng.randrange(n))]
    cases = [(i, words(5), words(5), [None if rng.random() < 0.1 else (rng.choice(["continue", "revise", "final_answer", None]), rng.choice([None, words(4)])) for _ in range(rng.randrange(7))]) for i in range(200)]
    df = spark.createDataFrame(cases, "id int, steps array<string>, artifacts array<string>, reviews array<struct<decision:string,steps:array<string>>>")
    out = df.withColumn("c", review.review_contexts(F.col("steps"), F.col("artifacts"), F.col("reviews"), 3)).withColumn("final", review.final_context(F.col("c")))
    same = {}
    for r in out.collect():
        want = contexts(*cases[r.id][1:], 3)
        assert [(c.decision, c.force, c.executed, c.remaining) for c in r.c] == want
        finals = [c.signature for c in r.c if c.decision == "final_answer"]
        assert r.final == (finals[-1] if finals else None)
        for c in r.c:
            state = (tuple(cases[r.id][2][: c.executed]), tuple(c.remaining), c.force)
            assert same.setdefault(c.signature, state) == state
    assert len(set(same.values())) == len(same)


def test_lineage(spark):
    rng = random.Random(2)
    up = {f"n{i}": [f"n{rng.randrange(max(0, i - 9), i)}" for _ in range(rng.randrange(3))] if i else [] for i in range(150)}
    up |= {f"c{i}": [f"c{i - 1}"] for i in range(1, 70)}
    edges = spark.createDataFrame([(k, p) for k, ps in up.items() for p in ps], "id string, source string").repartition(3)

    def back(x):
        return {r for p in up[x] for r in back(p)} if up.get(x) else {x}

    got = {}
    for r in lineage.roots(edges).collect():
        got.setdefault(r.id, set()).add(r.root)
    assert got == {k: back(k) for k in up if up[k]}
    with pytest.raises(ValueError, match="cycle"):
        lineage.roots(edges.unionAll(spark.createDataFrame([("n0", "n149"), ("n149", "n0")], edges.schema)))
    library = spark.createDataFrame([(1, "x"), (12, "y")], "position int, id string")
    gaps = spark.createDataFrame([("gap_1",), ("g-2",)], "id string")
    refs = spark.createDataFrame([("a", "LF001"), ("b", "gap_1"), ("c", "LF012 + g-2+LF1")], "id string, ref string")
    assert sorted(map(tuple, lineage.resolved(refs, library, gaps).collect())) == [("a", "x"), ("b", "gap_1"), ("c", "g-2"), ("c", "x"), ("c", "y")]
    with pytest.raises(Exception, match="unknown reference: LF3"):
        lineage.resolved(spark.createDataFrame([("a", "LF3")], refs.schema), library, gaps).collect()
