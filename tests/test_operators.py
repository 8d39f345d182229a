import json
import math
import re

import pytest
from pyspark.sql import functions as F

from sievemill.functions import text as T
from sievemill.functions import vectors as V
from sievemill.operators import ledger, models, preference, sampling, scoring, similarity
from sievemill.plans import catalogue
from sievemill.sources import io
from sievemill.streaming import ledger_stream


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column(F.col("t"))).collect()]


def test_apportion(spark):
    sizes = spark.createDataFrame([(0, 70), (1, 20), (2, 10)], "k int, n long")
    assert {r.k: r.quota for r in sampling.apportion(sizes, "k", "n", 11).collect()} == {0: 8, 1: 2, 2: 1}
    assert {r.k: r.quota for r in sampling.apportion(sizes, "k", "n", 1000).collect()} == {0: 70, 1: 20, 2: 10}


def test_packing(spark):
    rows = [("g", i, 700) for i in range(6)]
    out = sampling.pack(spark.createDataFrame(rows, "g string, k long, n long"), "g", "k", "n", 2200).collect()
    assert sorted([r.bin for r in out]) == [0, 0, 0, 1, 1, 1]


def test_mcnemar():
    assert scoring.mcnemar_p(0, 0) == 1
    assert math.isclose(scoring.mcnemar_p(1, 9), 2 * (1 + 10) / 1024)


def test_text(spark):
    assert one(spark, T.normalize_answer, " Final Answer:  Yes. ", "answer: no", None) == ["yes", "no", ""]
    assert one(spark, T.lookup_term, "Contract Terms", "gas", "A--B") == ["contract_term", "gas", "a_b"]
    assert one(spark, lambda c: T.sanitize(c, ["Acme"]), "Acme paid $1,200 (F12), 5% of 12345 in case-77") == ["[entity] paid [amount] ([fact]), [percent] of [number] in [case]"]
    assert one(spark, T.fact_count, "F1 x F2 y F1", "One. Two! Three", "") == [2, 3, 0]
    assert one(spark, T.trailing_number, "a12", "x", None) == [12, 10**18, 10**18]
    assert one(spark, lambda c: T.binary_label(c, ["1", "allowed"], ["0", "rejected"]), "1", "Allowed ", "REJECTED") == ["accepted", "accepted", "rejected"]
    with pytest.raises(Exception, match="unknown label"):
        one(spark, lambda c: T.binary_label(c, ["1"], ["0"]), "mixed")


def test_ledger(spark):
    rows = spark.createDataFrame([("a", 1, "error"), ("a", 2, "ok"), ("b", 3, "error"), (None, 4, "ok"), (None, 5, "ok")], "run_hash string, seq int, status string")
    assert sorted(r.seq for r in ledger.latest(rows, ["run_hash"], ["seq"]).collect()) == [2, 3, 4, 5]
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_hash string")
    assert sorted(r[0] for r in ledger.pending(jobs, rows, "run_hash").collect()) == ["b", "c"]
    assert ledger.planned(rows, None, "run_hash").count() == 5
    context = spark.createDataFrame([("a", None), ("b", None)], "k string, w string")
    assert ledger.current(context, w="x").count() == 2
    assert ledger.current(context.withColumn("w", F.when(F.col("k") == "a", "x")), w="x").count() == 1


def test_preferences(spark):
    c = [("A", i, f"t{i}", 0.5, 2, i) for i in range(4)] + [("B", i, f"t{i}", 0.5, 2, i) for i in range(4)] + [("C", i, "same", 0.5, 2, i) for i in range(4)]
    e = [(a, i, t, i == 2 or (i == 1 and t == 0)) for a in "AC" for i in range(4) for t in range(3)] + [("B", i, t, True) for i in range(4) for t in range(3)]
    out = preference.best_worst(spark.createDataFrame(c, "anchor string, candidate int, text string, similarity double, steps int, sample int"), spark.createDataFrame(e, "anchor string, candidate int, target int, correct boolean"), 4, 3).collect()
    assert [tuple(r) for r in out] == [("A", 2, 3, 1.0)]  # B ties, C has equal texts


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    for block in (64 << 20, 1):
        top = {r.query: r.neighbour for r in similarity.dense_topk(v, v, 1, "id", "v", block_bytes=block).collect()}
        assert top == {1: 2, 2: 1, 3: 2}
    assert similarity.batch_clusters(100, 5, 20, 25) == 5 and similarity.batch_clusters(10, 5, 8, 12) == 1
    with pytest.raises(ValueError):
        similarity.batch_clusters(13, 7, 8, 12)
    n = v.select(V.norm(V.normalized(F.col("v"))).alias("n"), V.norm(V.dual_view(F.col("v"), F.col("v"))).alias("d")).collect()
    assert all(math.isclose(r.n, 1) and math.isclose(r.d, 1) for r in n)
    steps = spark.createDataFrame([(1, "Red Ring", ["x"]), (2, "none", ["colours"]), (3, "none", ["zzz"])], "step long, name string, tags array<string>")
    items = spark.createDataFrame([(10, "red-ring", ["shape"], 0), (11, "blue", ["colour"], 1)], "item long, name string, tags array<string>, position int")
    scores = spark.createDataFrame([(s, i, 0.1 * i) for s in (1, 2, 3) for i in (10, 11)], "step long, item long, score double")
    assert sorted((r.step, r.item, r.mode) for r in similarity.cascade(steps, items, scores).collect()) == [(1, 10, "exact_name"), (2, 11, "exact_tag_unique"), (3, 11, "full_pool")]


def test_models(spark):
    jobs = spark.createDataFrame([(1, "p", 3), (2, None, 4)], "k long, prompt string, seed int")
    assert {r.status for r in models.generate(jobs, "k", "prompt", "seed").collect()} == {"ok"}

    def broken(prompts, seeds):
        raise RuntimeError("no answer")

    assert {(r.status, r.output) for r in models.generate(jobs, "k", "prompt", "seed", broken).collect()} == {("error", "no answer")}
    pairs = spark.createDataFrame([("a b", "b c")], "x string, y string")
    assert math.isclose(models.score_pairs(pairs, "x", "y").first().pair_score, 1 / 3)


def test_io(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in io.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]
    assert io.read_jsonl(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_jsonl(spark, f"{tmp_path}/none.jsonl", "a int", strict=True)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "7.json").write_text('{"a":\n 1}')
    assert io.read_json_files(spark, f"{tmp_path}/c", "a int").first().file_id == "7"
    for k in (0, 1):
        (tmp_path / "run" / "shards" / str(k)).mkdir(parents=True)
        (tmp_path / "run" / "shards" / str(k) / "g.jsonl").write_text(json.dumps({"a": k}))
    assert io.read_shards(spark, f"{tmp_path}/run", "g.jsonl", "a int").count() == 2
    df = spark.createDataFrame([(1, "x|y"), (2, None)], "k long, v string")
    io.write_csv(df, f"{tmp_path}/out")
    assert io.read_csv(spark, f"{tmp_path}/out", "k long, v string", ["k"]).count() == 2
    io.write_jsonl(df, f"{tmp_path}/j", True)
    assert io.file_digests(spark, f"{tmp_path}/j/*.json").first().lines == 2
    assert "x\\|y" in io.markdown(df)
    assert io.unique(df, "k").count() == 2
    with pytest.raises(Exception, match="duplicate id"):
        io.unique(df.unionAll(df), "k").collect()


def test_streams(spark, tmp_path):
    schema = "run_hash string, seq int, status string"
    source = tmp_path / "ledger"
    source.mkdir()
    (source / "1.json").write_text('{"run_hash":"a","seq":1,"status":"error"}\n{"run_hash":"a","seq":2,"status":"ok"}\n{"run_hash":"a","seq":3,"status":"ok"}\n')
    done = ledger_stream.completed(ledger_stream.read_ledger(spark, str(source), schema))
    q = done.writeStream.format("memory").queryName("done").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("done").count() == 1
    for n in (1, 2):
        if n == 2:
            (source / "2.json").write_text('{"run_hash":"a","seq":9,"status":"ok"}\n{"run_hash":"b","seq":4,"status":"ok"}\n')
        ledger_stream.upsert_latest(ledger_stream.read_ledger(spark, str(source), schema), f"{tmp_path}/state", f"{tmp_path}/cp", ["run_hash"], ["seq"]).awaitTermination(60)
    assert sorted((r.run_hash, r.seq) for r in spark.read.parquet(f"{tmp_path}/state/version=1").collect()) == [("a", 9), ("b", 4)]


def test_natural_sort_ranks_every_customer(spark):
    out = catalogue.QUERIES["natural_sort_all"](spark, "/root/testdata/sf0.01").collect()
    names = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_custkey", "c_name").collect()
    assert len(out) == len(names) > 50 and [r.rank for r in out] == list(range(1, len(out) + 1))
    place = lambda c: int(m[0]) if (m := re.search("[0-9]+$", c)) else 10**18
    assert [(r.place, r.c_name, r.c_custkey) for r in out] == sorted((place(r.c_name), r.c_name, r.c_custkey) for r in names)


def test_ranked_over_many_parts(spark):
    rows = [(f"c{i % 700}" if i % 9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, i long").repartition(7).withColumn("place", T.trailing_number(F.col("name")))
    out = {r["rank"]: r.i for r in sampling.ranked(df, ["place", "i"], "rank").collect()}
    assert [out[n] for n in range(1, 3001)] == [i for _, i in sorted((int(c[1:]) if c else 10**18, i) for c, i in rows)]
    assert sampling.ranked(df.where("i < 0"), ["place", "i"], "rank").count() == 0


def test_packing_fills_bins_of_every_batch(spark):
    size = {r.doc_id: (r.lang, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "n_chars").collect()}
    got = {}
    for r in catalogue.QUERIES["packing"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.batch, {})[r.doc_id] = r.bin
    assert sorted(i for b in got.values() for i in b) == sorted(size)
    bins = 0
    for batch in got.values():
        assert len({size[i][0] for i in batch}) == 1
        total = sum(size[i][1] for i in batch)
        loads = [0] * max(1, -(-total // 200_000))
        for i in sorted(batch, key=lambda i: (-size[i][1], i)):
            at = min(range(len(loads)), key=lambda k: (loads[k] + size[i][1] > 200_000, loads[k], k))
            if loads[at] + size[i][1] > 200_000:
                at = len(loads)
                loads.append(0)
            loads[at] += size[i][1]
            assert batch[i] == at
        assert max(loads) <= 200_000 and total < 2 * 16 * 200_000
        bins += len(loads)
        assert len(loads) > 1
    assert bins < 1.2 * sum(n for _, n in size.values()) / 200_000 + len(got)


def test_null_strata_are_strata(spark):
    from sievemill.operators import sampling

    df = spark.range(100).selectExpr("id", "case when id % 4 = 0 then null else cast(id % 4 as string) end as s")
    out = sampling.stratified(df, "s", "id", 20, "x").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in out} == {None: 5, "1": 5, "2": 5, "3": 5}
    splits = sampling.exact_splits(df, "s", "id", [("a", 0.5), ("b", 0.25)], "rest", "x")
    assert {r.split: r["count"] for r in splits.groupBy("split").count().collect()} == {"a": 50, "b": 25, "rest": 25}
    assert splits.where("s is null and split = 'b'").count() in (6, 7)
