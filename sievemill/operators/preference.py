"""Preference pairs and library maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread


def rewards(evaluations: DataFrame, n_targets: int) -> DataFrame:
    """anchor, candidate, reward: mean correctness of candidates with exactly n_targets distinct targets."""
    return evaluations.groupBy("anchor", "candidate").agg(F.count_distinct("target").alias("t"), F.avg(F.col("correct").cast("double")).alias("reward")).where(F.col("t") == n_targets).drop("t")


def best_worst(candidates: DataFrame, evaluations: DataFrame, n_candidates: int, n_targets: int) -> DataFrame:
    """anchor, chosen, rejected, gap. An anchor counts only if it has exactly n_candidates and every
    one has all its targets; ties in reward go by similarity (higher), steps (fewer), sample (lower);
    anchors whose best and worst reward are equal, or whose texts are, have no pair.

    candidates: anchor, candidate, text, similarity, steps, sample; evaluations: anchor, candidate, target, correct.
    """
    scored = candidates.join(rewards(evaluations, n_targets), ["anchor", "candidate"], "left")
    rank = F.struct("reward", "similarity", -F.col("steps"), -F.col("sample"))
    # the texts of all candidates are sorted: in more and smaller tasks than a plain aggregation would have
    pairs = spread(scored, "anchor").groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("reward").alias("n_scored"),
        F.max_by(F.struct("candidate", "text", "reward"), rank).alias("best"),
        F.min_by(F.struct("candidate", "text", "reward"), rank).alias("worst"),
    )
    ok = (F.col("n") == n_candidates) & (F.col("n_scored") == n_candidates) & (F.col("best.reward") > F.col("worst.reward")) & (F.col("best.text") != F.col("worst.text"))
    return pairs.where(ok).select("anchor", F.col("best.candidate").alias("chosen"), F.col("worst.candidate").alias("rejected"), (F.col("best.reward") - F.col("worst.reward")).alias("gap"))


def violations(pool: DataFrame, key: str, **minimum: int) -> DataFrame:
    """key, problem: repeated ids and arrays with fewer than their least number of entries."""
    twice = pool.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("duplicate id").alias("problem"))
    out = twice
    for column, least in minimum.items():
        out = out.unionAll(pool.where(F.coalesce(F.size(column), F.lit(0)) < least).select(key, F.lit(f"{column} below {least}").alias("problem")))
    return out


def renumber(pool: DataFrame, order: list[str], drop: DataFrame | None, key: str, prefix: str) -> DataFrame:
    """pool without the dropped ids, with new ids prefix001... in order; key stays as the lineage.
    The library is a small table, numbered in one task."""
    kept = pool if drop is None else pool.join(drop.select(key), key, "left_anti")
    return kept.withColumn("new_id", F.format_string(f"{prefix}%03d", F.row_number().over(Window.orderBy(*order))))


def rollup_children(nodes: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """key, n_children, children (values in order of key) of every node, by a self-join."""
    kids = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__p")).agg(F.count(F.lit(1)).alias("n_children"), F.sort_array(F.collect_list(F.struct(key, value))).alias("c"))
    out = nodes.join(kids, F.col(key) == F.col("__p"), "left")
    return out.select(key, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce(F.transform("c", lambda x: x[value]), F.array().cast("array<string>")).alias("children"))


def control_audit(pairs: DataFrame, left: str, right: str, fields: list[str]) -> DataFrame:
    """field, equal, different, missing of paired structs, in one pass."""
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{left}.{f}").cast("string").alias("a"), F.col(f"{right}.{f}").cast("string").alias("b")) for f in fields])).alias("x")).select("x.*")
    return each.groupBy("field").agg(F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count_if(F.col("a") != F.col("b")).alias("different"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"))
