"""Each planted sentence is found by its pattern; guarded patterns find what the plain ones find."""

import random
import re

from pyspark.sql import functions as F

from sievemill.functions import lexicon
from sievemill.functions import profile as P
from sievemill.plans import casework  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_every_reason_family_and_demand_occurs(spark):
    from sievemill.plans.catalogue import QUERIES

    seen = lambda name, column: {x for r in QUERIES[name](spark, SF).select(column).collect() for x in r[0].split("|")}
    assert set(lexicon.OUTCOME_PATTERNS) | {"judgment_text_overlap"} <= seen("leakage_reasons", "reasons")
    assert set(lexicon.FAMILY_PATTERNS) | {"general_legal_reasoning"} <= seen("case_profile", "families")
    assert set(lexicon.DEMAND_PATTERNS) <= seen("case_profile", "demands")


def test_predicates_go_both_ways(spark):
    from sievemill.plans.catalogue import QUERIES

    rows = QUERIES["case_predicates"](spark, SF).collect()
    assert all({r[c] for r in rows} == {True, False} for c in ("civil", "strict", "defense", "place", "year"))


def test_guarded_patterns(spark):
    patterns = lexicon.FAMILY_PATTERNS | lexicon.DEMAND_PATTERNS
    rng = random.Random(1)
    words = [w for p in patterns.values() for w in re.findall(r"[a-z]{3,}", p)] + ["s&p", "set-off", "labour", "the", "x", "will.", "SHE"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.m for r in df.select("id", P.matching(F.col("t"), patterns).alias("m")).collect()}
    assert all(got[i] == [n for n, p in patterns.items() if re.search(p, t, re.I)] for i, t in enumerate(texts))
