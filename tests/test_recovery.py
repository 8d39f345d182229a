"""Recovery as a stream against the batch rule, in any split and after a restart; rows by their place in raw files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievemill.operators import library
from sievemill.sources import io
from sievemill.streaming import ledger_stream as ls

SCHEMA = "anchor long, sample_index int, status string, error string"


def events(seed, n=160):
    rng = random.Random(seed)
    return [(rng.randrange(30), rng.randrange(4), *rng.choice([("ok", None), ("error", "missing planned_steps"), ("error", "missing planned_steps"), ("error", "missing planned_steps"), ("error", "timeout"), ("error", None)])) for _ in range(n)]


@pytest.mark.parametrize("splits", [1, 4])
def test_stream_is_the_batch(spark, tmp_path, splits):
    rows = events(splits)
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    # each part is a run of its own, from the checkpoint of the one before
    for part in range(splits):
        own = [dict(zip(("anchor", "sample_index", "status", "error"), r)) for i, r in enumerate(rows) if i * splits // len(rows) == part]
        (source / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in own))
        found = ls.recovery_stream(ls.read_ledger(spark, str(source), SCHEMA), "anchor")
        save = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        assert found.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(map(tuple, ls.latest_slots(spark.read.parquet(out), "anchor").collect()))
    whole = spark.createDataFrame(rows, SCHEMA)
    slots = library.plan_slots(spark.range(30).withColumnRenamed("id", "anchor"), "anchor")
    want = library.missing_slots(slots, whole.where("status = 'ok'"), whole.where("status <> 'ok'"), "anchor").select("anchor", "sample_index", "seed", "attempt")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 5


def test_row_index_and_back_join(spark, tmp_path):
    path = str(tmp_path / "raw")
    for k in range(3):
        spark.range(1000 * k, 1000 * k + 700).selectExpr("id", "concat('text ', id) as text", "repeat('x', 200) as pad").coalesce(1).write.mode("append").parquet(path)
    places = {}
    for size in ("1k", "16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = {r.row_index: r.id for r in io.row_indexed(spark, path).select("row_index", "id").collect()}
        assert sorted(rows) == list(range(2100)) and places.setdefault("all", rows) == rows
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    df = spark.createDataFrame([("case-7", None, "m"), ("case-2099", None, None), ("no number", "own", "m")], "case string, text string, pad string")
    out = {r.case: (r.text, r.pad[:1]) for r in io.with_raw(df, io.row_indexed(spark, path), "case", ["text", "pad"]).collect()}
    assert out == {"case-7": (f"text {places['all'][7]}", "m"), "case-2099": (f"text {places['all'][2099]}", "x"), "no number": ("own", "m")}
    for bad in ("case-2100", "none"):
        with pytest.raises(Exception, match=f"no raw row for {bad}"):
            io.with_raw(spark.createDataFrame([(bad, None, None)], df.schema), io.row_indexed(spark, path), "case", ["text"]).select(F.max("text")).collect()


def test_append_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    new = spark.createDataFrame([("a", "error", 1), ("a", "ok", 2), ("a", "ok", 3), ("b", "error", 4), ("c", "ok", 5)], "run_hash string, status string, n int")
    none = new.limit(0)
    io.append_ledger(new, none, path)
    first = spark.read.schema(new.schema).json(path)
    assert sorted((r.run_hash, r.status, r.n) for r in first.collect()) == [("a", "ok", 3), ("b", "error", 4), ("c", "ok", 5)]
    io.append_ledger(new.where("run_hash <> 'c'"), first, path)
    assert sorted((r.run_hash, r.n) for r in spark.read.schema(new.schema).json(path).collect()) == [("a", 3), ("b", 4), ("b", 4), ("c", 5)]


def test_hashes_of_parts_do_not_meet(spark):
    from sievemill.functions.text import canonical_hash

    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), ("\x00", ""), (None, ""), ("", None), ('a","b', None)]
    out = spark.createDataFrame(rows, "a string, b string").select(canonical_hash(F.col("a"), F.col("b")).alias("h")).collect()
    assert len({r.h for r in out}) == len(rows)
