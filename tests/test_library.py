import random

import pytest
from pyspark.sql import functions as F

from sievemill.functions import profile as P
from sievemill.operators import library, review, sampling, similarity


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def brute_cascade(step, items, scores, used=()):
    norm = lambda t: t[:-1] if len(t) > 4 and t.endswith("s") else t
    free = [i for i in items if i["item"] not in used] or items
    named = [i for i in free if norm(i["name"]) == norm(step["name"])]
    tagged = [] if named else [i for i in free if {norm(t) for t in i["tags"]} & {norm(t) for t in step["tags"]}]
    if len(named) == 1 or (not named and len(tagged) == 1):
        return ((named or tagged)[0]["item"], "exact_name" if named else "exact_tag_unique", 1.0)
    pool = named or tagged or free
    best = max(pool, key=lambda i: (scores.get((step["step"], i["item"]), 0.0), -i["position"]))
    return (best["item"], "ambiguous_name" if named else "tag_overlap" if tagged else "full_pool", scores.get((step["step"], best["item"]), 0.0))


def test_retrieval_in_turn_equals_brute_force(spark):
    rng = random.Random(2)
    names, tags = ["alpha", "betas", "beta", "gamma", "delta"], ["x", "y", "zebra", "zebras", "q"]
    items = [{"item": i, "name": rng.choice(names), "tags": rng.sample(tags[:3], rng.randrange(0, 3)), "position": i} for i in range(7)]
    steps = [{"plan": p, "step": p * 10 + k, "position": k, "name": rng.choice([*names, "omega", "psi"]), "tags": rng.sample(tags, rng.randrange(0, 3))} for p in range(25) for k in range(1, 5)]
    steps += [{"plan": 90, "step": 900 + k, "position": k, "name": "omega", "tags": []} for k in range(1, 5)]
    scores = {(s["step"], i["item"]): rng.randrange(1, 90) / 97 for s in steps for i in items if rng.random() < 0.5 and s["plan"] != 90}
    want = []
    for p in {s["plan"] for s in steps}:
        used = []
        for s in sorted((s for s in steps if s["plan"] == p), key=lambda s: s["position"]):
            got = brute_cascade(s, items, scores, used)
            used.append(got[0])
            want.append((s["step"], *got))
    i = spark.createDataFrame([(x["item"], x["name"], x["tags"], x["position"]) for x in items], "item int, name string, tags array<string>, position int")
    s = spark.createDataFrame([(x["plan"], x["step"], x["position"], x["name"], x["tags"]) for x in steps], "plan int, step int, position int, name string, tags array<string>")
    c = spark.createDataFrame([(a, b, v) for (a, b), v in scores.items()], "step int, item int, score double")
    assert rows(library.retrieve_in_turn(s, i, c), "step", "item", "mode", "score") == sorted(want)
    assert {m for _, _, m, _ in want} == {"exact_name", "exact_tag_unique", "ambiguous_name", "tag_overlap", "full_pool"}


def test_used_items_are_free_again_when_all_are_used(spark):
    i = spark.createDataFrame([(1, "a", ["t"], 0), (2, "b", ["u"], 1)], "item int, name string, tags array<string>, position int")
    s = spark.createDataFrame([(7, "a", ["u"])], "step int, name string, tags array<string>")
    none = spark.createDataFrame([], "step int, item int, score double")
    used = lambda *x: spark.createDataFrame([(7, k) for k in x], "step int, item int")
    assert rows(similarity.cascade(s, i, none, used(1)), "item", "mode") == [(2, "exact_tag_unique")]
    assert rows(similarity.cascade(s, i, none, used(1, 2)), "item", "mode") == [(1, "exact_name")]


def test_cycles_and_depth(spark):
    chain = spark.createDataFrame([(1, "I1", None, 0), (1, "I3", "I2", 1), (1, "I2", "I1", 2), (2, "A", "ROOT", 0)], "g int, node string, parent string, position int")
    assert rows(library.execution_order(chain, "g"), "g", "place", "node") == [(1, 1, "I3"), (1, 2, "I2"), (1, 3, "I1"), (2, 1, "A")]
    cycle = spark.createDataFrame([(1, "a", "b", 0), (1, "b", "a", 1)], "g int, node string, parent string, position int")
    with pytest.raises(Exception, match="cycle"):
        library.execution_order(cycle, "g").collect()


def test_gap_adjudication(spark):
    ids = lambda p, n: spark.createDataFrame([(f"{p}{i}", i) for i in range(1, n + 1)], "id string, position int")
    merges = spark.createDataFrame([(0, ["L1", "G1"])], "merge int, sources array<string>")
    out = library.adjudicated(ids("L", 2), ids("G", 3), ids("G", 3).where("position = 2"), merges).orderBy("part", "place").collect()
    assert [r.sources for r in out] == [["L1", "G1"], ["L2"], ["G2"]]


def test_recovery_moves_the_seed_and_stops(spark):
    slots = library.plan_slots(spark.createDataFrame([(1,), (2,)], "k int"), "k", 2, 7)
    present = spark.createDataFrame([(1, 0)], "k int, sample_index int")
    failures = spark.createDataFrame([(1, 1, "no planned_steps"), (2, 0, "timeout"), (2, 1, "planned_steps")] + [(2, 1, "planned_steps")] * 2, "k int, sample_index int, error string")
    assert rows(library.missing_slots(slots, present, failures, "k"), "k", "sample_index", "seed") == [(1, 1, 12)]


def test_evaluations(spark):
    df = spark.createDataFrame([("support", "support", None), ("none", "support", None), (None, "support", None), ("support", "support", "timeout")], "answer string, gold string, error string")
    assert [tuple(r)[3:] for r in library.evaluated(df, ["support", "reject"]).collect()] == [("ok", True, True), ("ok", False, False), ("ok", False, False), ("error", False, None)]


def test_checks_stop_the_job(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, label string")
    assert review.only_once(a, "id").count() == 2 and review.known_only(a, a, "id").count() == 2 and review.aligned(a, a, "id", "label").count() == 2 and review.covered(a, a, "id").count() == 2
    bad = [
        review.only_once(a.unionAll(a), "id"),
        review.known_only(a, a.where("id = 1"), "id"),
        review.aligned(a, a.withColumn("label", F.lit("x")), "id", "label"),
        review.covered(a.where("id = 1"), a, "id"),
        review.compare_runs(a.select("id", F.col("label").alias("gold"), F.lit("x").alias("prediction")), a.select("id", F.lit("x").alias("gold"), F.lit("x").alias("prediction")), "id"),
        library.one_context(a, "label"),
    ]
    for df in bad:
        with pytest.raises(Exception, match="repeated|unknown id|differs|not covered|more than one"):
            df.collect()
    assert library.one_context(a, "id").limit(0).count() == 0 and library.one_context(a.where("id = 1"), "label").count() == 1
    stored = spark.createDataFrame([("n", "5")], "name string, value string")
    new = spark.createDataFrame([("n", "6"), ("m", "1")], "name string, value string")
    assert review.guard(new, stored, force=True).count() == 2 and review.guard(stored, stored).count() == 1
    with pytest.raises(Exception, match="setting differs"):
        review.guard(new, stored).collect()


def test_profile_expressions(spark):
    df = spark.createDataFrame([("Whether A; if B; and c", '{"a": [1, 2], "b": null}', "b - x\nb\n\n- y;\n"), (None, "{'a': 1}", None)], "issues string, j string, auth string")
    out = df.select(P.issue_questions(F.col("issues")).alias("q"), P.equal_structures(F.col("j"), F.lit('{"b":null,"a":[1,2]}')).alias("e"), P.numbered_authorities(F.col("auth")).alias("n"), P.demand_focus(F.array(F.lit("z"), F.lit("y")), ["x", "y", "z"]).alias("f"), P.signature_prefix(F.lit("a > b > c > d > e > f")).alias("s"), P.safe_name(F.lit(" A b/c! ")).alias("name")).collect()
    assert (out[0].q, out[0].e, [x.text for x in out[0].n], out[0].f, out[0].s, out[0].name) == (2, True, ["b - x", "b", "y"], "y", "a > b > c > d > e", "a_b_c")
    assert (out[1].q, out[1].e, out[1].n) == (0, False, [])


def test_ranks_in_parts_equal_ranks_in_one(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(500)], "doc int, k string")
    place = lambda: {(r.doc, r["__rn"], r["__n"]) for r in sampling.hash_ranked(df, "k", "doc", "s").collect()}
    whole = place()
    monkeypatch.setattr(sampling, "TASK_ROWS", 7)
    assert place() == whole and len(whole) == 500


def test_manifest_is_replaced_whole(spark, tmp_path):
    from sievemill.sources import io

    path = str(tmp_path / "manifest")
    for n in (1, 2):
        io.write_manifest(spark.createDataFrame([(n, "x")], "n int, name string"), path)
        assert [r.n for r in spark.read.json(path).collect()] == [n]
    assert not io.exists(spark, f"{path}.new")
    with pytest.raises(Exception, match="no such"):
        io.write_manifest(spark.range(1).select(F.raise_error(F.lit("no such")).alias("x")), path)
    assert [r.n for r in spark.read.json(path).collect()] == [2]
