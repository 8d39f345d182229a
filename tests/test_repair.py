"""Repair of model output: a table of broken texts, keys against plain Python, payloads with their logs."""

import json
import random
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from sievemill.functions import repair as r
from sievemill.sources.tables import spread

BROKEN = [
    ('{"answer":"ok" "reason":"missing comma"}', {"answer": "ok", "reason": "missing comma"}, False),
    ('{"answer":"ok"},{"reason":"split object"}', {"answer": "ok", "reason": "split object"}, True),
    ('[{"a": 1}, {"b": 2, "a": 3}]', {"a": 3, "b": 2}, True),
    ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}, False),
    ("{'a': 'it''s', 'b': True, c: None, d: plain words}", {"a": "it''s", "b": True, "c": None, "d": "plain words"}, False),
    ('Here you are: {"a": {"b": [1, {"c": "x"', {"a": {"b": [1, {"c": "x"}]}}, False),
    ('{"a": "he said "no" twice", "b": 1}', {"a": 'he said "no" twice', "b": 1}, False),
    ('{"a": "two\nlines", "b": "tab\\t\\u00e9\\ud83d\\ude00"}', {"a": "two\nlines", "b": "tab\té😀"}, False),
    ('{"a": 1.5e3, "b": -0, "c": 12abc, "d": NaN}', {"a": 1500.0, "b": 0, "c": "12abc", "d": "NaN"}, False),
    ('{"a": , "b": 2, "c"}', {"a": None, "b": 2, "c": None}, False),
    ('{"a": [1, 2}, "b": 3]} tail', {"a": [1, 2]}, False),
    ('{“a”: “b”}', {"a": "b"}, False),
    ('{"a": "unclosed', {"a": "unclosed"}, False),
    ('{"a": "x",, "b": "y"}', {"a": "x", "b": "y"}, False),
    ('{"a": 1 "b": true "c": x "d": 2}', {"a": 1, "b": True, "c": 'x "d": 2'}, False),
    ("{}{}", {}, True),
    ("[1, 2]", None, False),
    ("no json at all", None, False),
    ("", None, False),
    (None, None, False),
]


def test_table_of_broken_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(BROKEN)] + [(100, ' {"b": 1, "a": [2]} ')], "id int, text string")
    out = {x.id: x for x in r.with_object(rows, "text").collect()}
    for i, (text, want, merged) in enumerate(BROKEN):
        got = out[i]
        assert (json.loads(got.payload) if got.payload else None) == want, text
        assert (got.payload_repaired, got.payload_merged) == (want is not None, merged), text
    assert (out[100].payload, out[100].payload_repaired, out[100].payload_merged) == ('{"b": 1, "a": [2]}', False, False)


def test_any_object_survives_its_loss_of_commas_and_closers():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [rng.randrange(100), "w" + "x" * rng.randrange(5), True, None][kind] if kind < 4 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))} if kind == 4 else [value(depth - 1) for _ in range(rng.randrange(4))]

    for _ in range(300):
        v = {f"k{i}": value(3) for i in range(rng.randrange(1, 5))}
        t = json.dumps(v)
        assert json.loads(r.repaired(t)[0]) == v
        assert json.loads(r.repaired(t.rstrip("}]"))[0]) == v
        assert json.loads(r.repaired(t.replace('", "', '" "').replace("}", ",}").replace("[,", "["))[0]) == v
        for cut in range(len(t)):
            r.repaired(t[:cut])  # never fails


def test_long_and_deep_texts():
    assert json.loads(r.repaired("[" * 0 + '{"a":' * 300 + "1")[0])
    assert json.loads(r.repaired('{"a": "' + "x y " * 100_000)[0])["a"].startswith("x y")


def test_closest_key():
    rng = random.Random(4)
    allowed = ["final_decision", "final_rationale", "issue_id", "supporting_fact_ids", "opposing_fact_ids"]
    for _ in range(500):
        key = list(rng.choice(allowed))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(key))
            key[at : at + rng.randrange(2)] = rng.choice("abcxyz_")
        key = "".join(key)
        want = next((a for a in sorted(allowed) if a in key), None) or next(iter(get_close_matches(key, allowed, n=1, cutoff=0.86)), None)
        assert r.closest_key(key, sorted(allowed)) == want
    assert r.closest_key("['final_decision']", allowed) == "final_decision"
    assert r.closest_key("opp_fact_ids", allowed, r.ID_PREFIXES) == "opposing_fact_ids"
    assert r.closest_key("something", allowed) is None


def plain_keys(payload, allowed):
    actions = []
    for key in list(payload):
        if key in allowed:
            continue
        target = r.closest_key(key, sorted(allowed), r.ID_PREFIXES)
        if target and target not in payload:
            payload[target] = payload.pop(key)
            actions.append(f"schema_key_typo: {key} -> {target}")
    return actions


def plain_answer(payload):
    """The rule of normalised_answers on one object."""
    out, actions = dict(payload), []
    if set(r.ANSWER) & set(out):
        for k in r.SCHEMA_WORDS:
            if k in out:
                del out[k]
                actions.append(f"schema_metadata_removed: {k}")
    actions += plain_keys(out, r.ANSWER)
    if out.pop("task_answer", None) is not None or "task_answer" in payload:
        actions.append("obsolete_task_answer_removed")
    if "final_decision" in out and "final_rationale" not in out:
        out["final_rationale"] = r.NO_RATIONALE
        actions.append("missing_final_rationale_filled")
    if "final_decision" in out:
        extra = {k: out.pop(k) for k in list(out) if k not in r.ANSWER}
        full = {k: v for k, v in extra.items() if v not in (None, "", [], {})}
        if extra and not full:
            actions.append("direct_extra_fields_removed")
        elif extra:
            note, old = json.dumps(full, ensure_ascii=False, sort_keys=True), out.get("final_rationale")
            out["final_rationale"] = f"{old}\nAdditional structured notes: {note}" if isinstance(old, str) and old.strip() else note
            actions.append("direct_extra_fields_folded_into_final_rationale")
    return out, actions


PAYLOADS = [
    {"final_decision": "support", "final_rationale": "because"},
    {"final_decison": "support", "final_rationle": "typos"},
    {"[final_decision]": "a", "final_decision.": "b", "final_rationale": None},
    {"final_decision": "x", "title": "t", "type": "object", "$schema": "s", "note": {"z": [1, "é"], "a": None}, "count": 3},
    {"final_decision": "x", "empty": "", "none": None, "list": [], "map": {}},
    {"task_answer": "old", "final_decision": "x"},
    {"title": "kept, as there is no answer", "other": 1},
    {"final_rationale": "no decision", "other": "stays"},
    {"final_decision": 'quo"te', "final_rationale": "  ", "b": "2", "a": "1"},
    {"final_decisions": "first", "final_decision_": "second"},
    {},
]


def test_answers(spark):
    rows = spark.createDataFrame([(i, json.dumps(p, ensure_ascii=False), "x") for i, p in enumerate(PAYLOADS)] + [(50, None, "x"), (51, "[1]", "x")], "id int, payload string, extra string")
    out = r.normalised_answers(rows, "id", "payload")
    got = {x.id: x for x in out.select("id", r.written(out.entries).alias("json"), "actions", "extra").collect()}
    for i, p in enumerate(PAYLOADS):
        want, actions = plain_answer(p)
        # notes are compared as JSON: writers differ in spacing
        text, other = json.loads(got[i].json), dict(want)
        for x in (text, other):
            v = x.get("final_rationale")
            if isinstance(v, str) and "{" in v:
                x["final_rationale"] = (v[: v.index("{")], json.loads(v[v.index("{") :]))
        assert (text, got[i].actions) == (other, actions), p
    assert got[50].actions == [] and got[51].actions == []


@pytest.mark.parametrize("seed", range(3))
def test_random_keys(spark, seed):
    rng = random.Random(seed)
    allowed = ["issue_id", "conclusion", "supporting_fact_ids", "opposing_fact_ids", "explanation"]

    def noisy(k):
        k = list(k)
        for _ in range(rng.randrange(3)):
            k[rng.randrange(len(k))] = rng.choice("aeiou_")
        return "".join(k)

    payloads = [{noisy(rng.choice(allowed)): i for i in range(rng.randrange(7))} for _ in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id int, payload string")
    for x in r.repaired_keys(rows, "id", "payload", allowed, r.ID_PREFIXES).collect():
        p = dict(payloads[x.id])
        assert x.actions == plain_keys(p, allowed)
        assert {e.key: json.loads(e.value) for e in x.entries} == p and [e.key for e in x.entries] == list(p)


def test_answers_are_read_once_and_by_all_cores(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def answer(i):
        seen.add(1)
        return json.dumps({"final_decison": f"d{i}", "final_rationale": "r", "note": i})

    rows = spark.range(0, 40, numPartitions=1).withColumn("payload", answer("id"))
    out = r.normalised_answers(rows, "id", "payload")
    assert {(x["id"], x["actions"][0]) for x in out.collect()} == {(i, "schema_key_typo: final_decison -> final_decision") for i in range(40)}
    assert seen.value == 40
    # one small file is read in one task; what is then done to its rows is not
    assert spread(rows, "id").rdd.getNumPartitions() >= 4
