import numpy as np
from pyspark.sql import functions as F

from sievemill.operators import clusters


def test_an_iteration_is_one_shuffle_and_rows_are_dealt(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, [float(v) for v in rng.normal(size=6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "fam string, key long, vec array<double>").coalesce(1)
    counts = spark.createDataFrame([("a", 600, 8)], "family string, n long, k long")
    sc, jobs, centres = spark.sparkContext, {}, {}
    try:
        for n in (2, 8):
            sc.setJobGroup(f"iterations {n}", "")
            members, found = clusters.family_kmeans(df, "fam", "key", "vec", counts, iterations=n)
            jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"iterations {n}"))
            centres[n] = [r.vector for r in found.orderBy("cluster").collect()]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert not np.allclose(centres[2], centres[8])
    # the map side and the result of one shuffle
    assert jobs[8] - jobs[2] <= 6 * 2
    assert members.select(F.input_file_name()).distinct().count() > 1 and members.count() == 600


def test_rows_of_families_without_centres_are_passed_over(spark):
    df = spark.createDataFrame([(f, i, [float(i % 7), 1.0]) for i in range(40) for f in ("a", "b")], "fam string, key long, vec array<double>")
    counts = spark.createDataFrame([("a", 40, 2)], "family string, n long, k long")
    members, centres = clusters.family_kmeans(df, "fam", "key", "vec", counts, iterations=3)
    assert members.count() == 40 and {r.family for r in members.collect()} == {r.family for r in centres.collect()} == {"a"}
