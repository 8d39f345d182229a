"""Integrity of exports, lengths in tokens, the frozen protocol."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievemill.operators import exports


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


ROWS = [(f"r{i}", f"prompt {i}", sha(f"prompt {i}"), "yes " * (i % 5), "no") for i in range(30)]
SCHEMA = "id string, prompt string, prompt_hash string, chosen string, rejected string"


def test_problems(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    prompts = rows.select("id", "prompt")
    settings = {"pool": "p1", "checkpoint": "c1"}
    manifest = exports.manifest_of(rows, planner="m", **settings)
    assert exports.export_problems(rows.repartition(4), manifest, settings, prompts, ("planner",)).collect() == []
    assert manifest["rows_hash"] != exports.rows_hash(rows.where("id <> 'r3'")) and exports.rows_hash(rows.unionAll(rows)) != manifest["rows_hash"]
    bad = spark.createDataFrame([("r1", "prompt 1", sha("other"), "", ""), ("r2", "prompt 2", sha("prompt 2"), None, ""), ("r2", "prompt 2", sha("prompt 2"), "", ""), (None, None, sha(""), "", ""), *[(f"x{i}", "new", sha("new"), "", "") for i in range(8)]], SCHEMA)
    got = {r.problem: (r.n, r.first) for r in exports.export_problems(bad, manifest, {"pool": "p2", "checkpoint": "c1"}, prompts, ("planner", "reviewer")).collect()}
    assert got.pop("prompt does not match its hash") == (1, ["r1"]) and got.pop("id repeats") == (1, ["r2"]) and got.pop("no id") == (1, ["<missing-id>"])
    assert got.pop("prompt is made otherwise today") == (10, ["<missing-id>", "r1", "x0", "x1", "x2"])
    assert got.pop("rows is 30, not 12") and got.pop("pool is p1, not p2") and got.pop("reviewer is not recorded")
    assert [k for k in got if not k.startswith("rows_hash is")] == [] and len(got) == 1


def test_lengths(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    words = lambda texts: [len(t.split()) for t in texts]
    texts = {"chosen": ["prompt", F.lit(" "), "chosen"], "rejected": ["prompt", F.lit(" "), "rejected"]}
    assert {r["name"]: (r.id, r.tokens) for r in exports.longest(rows, "id", texts, words).collect()} == {"chosen": ("r14", 6), "rejected": ("r0", 3)}
    assert exports.within_length(rows, "id", texts, words, 7) == 7 and exports.within_length(rows.limit(0), "id", texts, words, 1) == 0
    with pytest.raises(ValueError, match="chosen of r14 has 7 tokens, more than 6"):
        exports.within_length(rows, "id", texts, words, 6)


def test_protocol(spark, tmp_path):
    p = exports.Protocol(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="not frozen"):
        p.check({"workflow": "a"})
    p.freeze({"workflow": "a", "pool": "b"})
    p.freeze({"pool": "b", "workflow": "a"})
    p.check({"workflow": "a", "pool": "b"})
    with pytest.raises(ValueError, match=r"frozen: \['pool'\]"):
        p.check({"workflow": "a", "pool": "c"})
    with pytest.raises(ValueError, match="other digests"):
        p.freeze({"workflow": "z", "pool": "b"})
    with pytest.raises(ValueError, match="not sealed"):
        p.check({"workflow": "a", "pool": "b"}, {"sft": "1"})
    with pytest.raises(ValueError, match="frozen"):
        p.seal({"workflow": "a"}, {"sft": "1"})
    p.seal({"workflow": "a", "pool": "b"}, {"sft": "1"})
    exports.Protocol(spark, str(tmp_path / "p")).check({"workflow": "a", "pool": "b"}, {"sft": "1"})
    with pytest.raises(ValueError, match=r"sealed: \['sft'\]"):
        p.check({"workflow": "a", "pool": "b"}, {"sft": "2"})
