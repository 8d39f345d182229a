import random

from pyspark.sql import functions as F

from sievemill.functions import text


def test_lookup_of_few_grams_is_containment(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["a", "ab", "b", "A.", "é", "ba"]) for _ in range(n))
    rows = [(words(n), words(m)) for n in (0, 2, 3, 9, 200) for m in (0, 3, 60)] + [(None, "a b c"), ("a b c", None)]
    df = spark.createDataFrame(rows, "p string, w string")
    old = text.containment(text.token_ngrams(F.col("p"), 3), text.token_ngrams(F.col("w"), 3))
    found = df.select(text.gram_containment(F.col("p"), F.col("w"), 3).alias("new"), old.alias("old"), F.size(text.token_ngrams(F.col("p"), 3)).alias("n")).collect()
    assert all(r["new"] == r["old"] for r in found)
    assert {r["n"] > text.FEW_GRAMS for r in found} <= {True, False} and any(r["new"] for r in found)
