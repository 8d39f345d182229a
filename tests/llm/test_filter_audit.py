"""The filter audit against plain Python: all orders, copies, labels, odd rows."""

import itertools
import re

from sievemill.llm import filter_audit as f

LONG = " ".join(f"word{i}" for i in range(210))
ROWS = [
    (5, "a", LONG), (2, "a", LONG), (9, "b", LONG), (9, "b", LONG), (2, "a", LONG), (None, "b", LONG), (None, None, LONG),
    (1, None, None), (3, "", ""), (4, "b", " \n\t"), (6, "b", "SHOUT " * 300), (7, "b", LONG + " #"), (8, "a", LONG + " Ab Ab"),
    (10, "a", "x y " * 150), (11, "a", "x y " * 150), (12, "a", "É " * 10), (13, "a", LONG), (7, "b", "another text of one id | B"), (14, "b", LONG * 40),
]
LABELS = [(5, 1, 0), (9, 1, 1), (9, 0, None), (6, 0, 1), (13, None, None), (None, 1, 1), (11, 1, 0), (11, 1, 0), (3, 2, 1)]


def plain(rows, labels):
    text = [(i, s or "", t or "") for i, s, t in rows]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    failing = []
    for i, s, t in text:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and u == t for j, _, u in text)]
        failing.append((s, i, {x for x, hit in zip("ABCDE", tests) if hit}))
    out = []
    for part in {s for _, s, _ in text}:
        mine = [(i, x) for s, i, x in failing if s == part]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, own in enumerate(order):
                before = set(order[:k])
                here = [i for i, x in mine if own in x and not before & x]
                shapley[own] += len(here)
                rows.append([part, "".join(order), k + 1, sum(not x & (before | {own}) for _, x in mine), len(here), sum(own in x and bool(before & x) for _, x in mine), sum(x == {own} for _, x in mine), sum(i in good for i in here), sum(i in toxic for i in here), own])
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def test_all_orders(spark):
    docs = spark.createDataFrame([(*r, "x", "y", "z", "q") for r in ROWS], "doc_id long, source string, text string, part string, digest string, copies string, word string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as good", "'y' as lone")
    assert sorted(tuple(r) for r in f.audit(docs, labels).collect()) == plain(ROWS, LABELS)
    assert sorted(tuple(r) for r in f.audit(docs, labels.limit(0)).collect()) == plain(ROWS, [])
    assert f.audit(docs.limit(0), labels).collect() == []


def test_words_shuffle_only_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    plan = f.word_counts(f.identified(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 4
