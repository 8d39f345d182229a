from pyspark.sql import functions as F

from sievemill.operators import preference


def test_candidates_are_ranked_in_more_tasks_than_a_plain_aggregation_has(spark):
    rows = spark.range(0, 40, numPartitions=1).select((F.col("id") % 10).alias("anchor"), F.expr("id div 10").alias("candidate"))
    candidates = rows.select("anchor", "candidate", F.concat_ws("/", "anchor", "candidate").alias("text"), F.lit(0.0).alias("similarity"), F.lit(1).alias("steps"), F.col("candidate").alias("sample"))
    evaluations = rows.select("anchor", "candidate", F.lit("t").alias("target"), (F.col("candidate") == 2).alias("correct"))
    out = preference.best_worst(candidates, evaluations, 4, 1)
    assert sorted((r["anchor"], r["chosen"], r["rejected"]) for r in out.collect()) == [(a, 2, 3) for a in range(10)]
    assert out.rdd.getNumPartitions() >= 16
