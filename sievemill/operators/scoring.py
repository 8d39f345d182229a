"""Metrics over (gold, prediction) rows, each a single aggregation or one on a small grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import ranked


def group_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def class_counts(df: DataFrame, gold: str, pred: str, labels: Sequence) -> DataFrame:
    """label, tp, n_gold, n_pred; a null prediction is wrong for any label."""
    rows = df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("c"))
    each = rows.select("*", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    hit = lambda *c: F.sum(F.when(sum((F.col(x).eqNullSafe(F.col("label")).cast("int") for x in c), F.lit(0)) == len(c), F.col("c")).otherwise(0)).cast("long")
    return each.groupBy("label").agg(hit(gold, pred).alias("tp"), hit(gold).alias("n_gold"), hit(pred).alias("n_pred"))


def f1(df: DataFrame, gold: str, pred: str, labels: Sequence) -> DataFrame:
    """weighted_f1, macro_f1; 0 where a class has no row and no prediction."""
    c = class_counts(df, gold, pred, labels)
    score = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("n_gold") + F.col("n_pred")).cast("double")), F.lit(0.0))
    return c.withColumn("f1", score).agg(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("n_gold")), F.sum("n_gold").cast("double")), F.lit(0.0)).alias("weighted_f1"), F.avg("f1").alias("macro_f1"))


def accuracy_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """n, accuracy, balanced_accuracy, majority_accuracy."""
    by = df.groupBy(gold).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(gold).eqNullSafe(F.col(pred)).cast("long")).alias("ok"))
    return by.agg(F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("accuracy"), F.avg(F.col("ok") / F.col("n")).alias("balanced_accuracy"), (F.max("n") / F.sum("n")).alias("majority_accuracy"))


def confusion(df: DataFrame, gold: str, pred: str, labels: Sequence) -> DataFrame:
    """gold, pred, n over the whole grid of labels."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], ["gold", "pred"])
    seen = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(seen, ["gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial test with p = 1/2; 1 without discordant pairs."""
    n = b + c
    if not n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(min(b, c) + 1)]
    return min(1.0, 2 * sum(map(math.exp, log)))


def paired(df: DataFrame, left: str, right: str) -> DataFrame:
    """n, both, left_only, right_only, neither, delta, p of two boolean columns; null pairs dropped."""
    ok = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    counts = ok.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(left) & F.col(right)).alias("both"), F.count_if(F.col(left) & ~F.col(right)).alias("left_only"), F.count_if(~F.col(left) & F.col(right)).alias("right_only"))
    counts = counts.withColumn("neither", F.expr("n - both - left_only - right_only")).withColumn("delta", F.try_divide((F.col("right_only") - F.col("left_only")).cast("double"), F.col("n").cast("double")))

    def test(frames):
        for pdf in frames:
            pdf["p"] = [mcnemar_p(int(b), int(c)) for b, c in zip(pdf.left_only, pdf.right_only)]
            yield pdf

    return counts.mapInPandas(test, "n long, both long, left_only long, right_only long, neither long, delta double, p double")


def outcome_buckets(df: DataFrame, left: str, right: str) -> DataFrame:
    name = F.when(F.col(left) & F.col(right), "both").when(F.col(left), "left_only").when(F.col(right), "right_only").otherwise("neither")
    return df.groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bootstrap_ci(df: DataFrame, key: str, value: str, samples: int = 2000, seed: int = 20260619) -> DataFrame:
    """key, n, mean, low, high: percentile bootstrap of the mean.

    Values are first counted by distinct value, so a task gets a group's value counts, not its rows;
    resampling is a multinomial draw of the counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        n = int(pdf.c.sum())
        draws = np.random.default_rng(seed).multinomial(n, pdf.c / n, samples) @ pdf.v.to_numpy() / n
        return pd.DataFrame([(pdf[key].iloc[0], n, float((pdf.v * pdf.c).sum() / n), *np.percentile(draws, [2.5, 97.5]))], columns=[key, "n", "mean", "low", "high"])

    return counts.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, n long, mean double, low double, high double")


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """reason, n: each row once per distinct reason."""
    return df.select(F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def distribution(population: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Counts and shares of each value in the population and the selection."""
    a = population.groupBy(key).agg(F.count(F.lit(1)).alias("n_population"))
    b = selected.groupBy(key).agg(F.count(F.lit(1)).alias("n_selected"))
    both = a.join(b, key, "full").na.fill(0, ["n_population", "n_selected"])
    w = Window.partitionBy()
    return both.select(key, "n_population", "n_selected", (F.col("n_population") / F.sum("n_population").over(w)).alias("share_population"), F.try_divide(F.col("n_selected").cast("double"), F.sum("n_selected").over(w).cast("double")).alias("share_selected"))


def terciles(df: DataFrame, value: str, key: str) -> DataFrame:
    """short, medium or long by thirds of the rank of (value, key), which a range-partitioned sort gives, whatever the values."""
    rows = df.where(F.col(value).isNotNull())
    n = rows.count()
    place = F.col("__r") - 1
    tercile = F.when(3 * place < n - 1, "short").when(3 * place < 2 * (n - 1), "medium").otherwise("long")
    return ranked(rows, [value, key], "__r").withColumn("tercile", tercile).drop("__r")
