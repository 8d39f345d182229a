import os
import random
import sys

import pyarrow as pa
import pytest
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from sievemill.operators import trajectory

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
ITEMS = [(f"i{k}", f"name {k}", ["t"], k) for k in range(4)]


def reply(records):
    return [{"decision": "final_answer" if r["force"] else "continue", "answer": "yes", "steps": None} for r in records]


@pytest.mark.parametrize("requests,often", [(1 << 16, 4096), (0, 10), (0, 1 << 30)])
def test_a_request_is_answered_once_and_calls_are_dealt(spark, tmp_path, monkeypatch, requests, often):
    monkeypatch.setattr(trajectory, "REQUESTS", requests)
    monkeypatch.setattr(trajectory, "OFTEN", often)
    where, asked = str(tmp_path / "where"), []
    os.mkdir(where)

    def execute(records):
        open(f"{where}/{TaskContext.get().partitionId()}", "w").close()
        return [r["item"] for r in records]

    def scores(steps, items):
        asked.append(steps.count())
        return trajectory.shared_tags(steps, items)

    # many cases ask for one item, a few for each of three others, one for nothing; all lie in one task
    name = F.when(F.col("case") < 90, "name 0").when(F.col("case") < 99, F.concat(F.lit("name "), (F.col("case") % 3 + 1).cast("string")))
    step = F.struct(name.alias("name"), F.when(F.col("case") % 2 == 5, F.array(F.lit("t"))).alias("tags"))
    cases = spark.range(100).coalesce(1).select(F.col("id").alias("case"), F.lit("x").alias("text")).withColumn("steps", F.array(step, step))
    items = spark.createDataFrame(ITEMS, "item string, name string, tags array<string>, position int")
    out = trajectory.trajectories(cases, items, execute, reply, ["yes"], str(tmp_path / "run"), scores=scores)
    first = {i: 0 if i < 90 or i == 99 else i % 3 + 1 for i in range(100)}
    second = {i: 0 if first[i] else 1 for i in range(100)}
    got = {r.case: (r.status, [a["result"] for a in r.artifacts]) for r in out.collect()}
    assert got == {i: ("ok", [f"i{first[i]}", f"i{second[i]}"]) for i in range(100)}
    assert asked == [5, 5] and len(os.listdir(where)) > 1


def test_plain_is_to_pylist():
    rng = random.Random(4)
    step = pa.struct([("name", pa.string()), ("tags", pa.list_(pa.string()))])
    kind = pa.struct([("case", pa.int64()), ("score", pa.float64()), ("force", pa.bool_()), ("day", pa.date32()), ("steps", pa.list_(step))])
    some = lambda x: None if rng.random() < 0.3 else x
    made = lambda: {"case": some(1 << 60), "score": some(0.1), "force": some(True), "day": some(3), "steps": some([some({"name": some("é"), "tags": some([some("a")] * rng.randrange(3))}) for _ in range(rng.randrange(3))])}
    column = pa.array([some(made()) for _ in range(300)], kind)
    for c in (column, column.slice(7, 100), column.slice(0, 0), pa.array([{"case": 1 << 62, "score": 0.5, "force": False, "day": None, "steps": []}], kind)):
        assert trajectory.plain(c) == c.to_pylist()
