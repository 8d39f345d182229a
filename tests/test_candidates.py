from pyspark.sql import functions as F

from sievemill.operators import library


def test_candidates_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<long>")
    def support(i):
        seen.add(1)
        return [i, i, 99]

    rows = spark.range(10).select(F.col("id").alias("candidate"), support("id").alias("support"), F.lit(3).cast("long").alias("support_count"))
    out = library.candidate_problems(rows, spark.range(5), 3).groupBy("problem").count()
    assert {(r["problem"], r["count"]) for r in out.collect()} == {("unknown support", 10), ("too few", 10), ("count differs", 10)}
    assert seen.value == 10
