"""Exact-count sampling, splitting and packing.

Ranks are by sha256 of seed and id, so samples do not depend on partitioning. Quotas come from a
row a stratum. A stratum is ranked in parts of about ``TASK_ROWS`` rows, cut by the first digits of
the hash, so no task sorts a whole stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


#: Rows that are ranked in one task, about.
TASK_ROWS = 1 << 20


def sha_rank(seed: str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def apportion(sizes: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """key, size and quota by largest remainder; ties by key; a stratum's quota is at most its size."""
    total = F.sum(size).over(Window.partitionBy())
    exact = F.least(F.lit(target), total) * F.col(size) / total
    rows = sizes.withColumns({"__x": exact, "__floor": F.floor(exact)})
    left = F.least(F.lit(target), total) - F.sum("__floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("__x") - F.col("__floor")), F.col(key).cast("string")))
    return rows.withColumns({"__left": left, "__place": place}).select(key, size, (F.col("__floor") + (F.col("__place") <= F.col("__left")).cast("long")).cast("long").alias("quota"))


def hash_ranked(df: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """df with __rn, the rank of (sha_rank, key) within the stratum, from 1, and __n, the stratum's size; a null stratum is one."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    most = sizes.agg(F.max("__n")).first()[0] or 0
    digits = 0
    while most > TASK_ROWS * 16**digits:
        digits += 1
    rows = df.withColumn("__s", sha_rank(seed, key)).withColumn("__part", F.substring("__s", 1, digits))
    rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(stratum, "__part").orderBy("__s", key)))
    # a row a stratum and part: 1 / TASK_ROWS of the rows, times 16 at most
    parts = rows.groupBy(stratum, "__part").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(stratum)
    parts = parts.select(F.col(stratum).alias("__of"), F.col("__part").alias("__p"), (F.sum("__c").over(whole.orderBy("__part")) - F.col("__c")).alias("__before"), F.sum("__c").over(whole).alias("__n"))
    out = rows.join(parts, rows[stratum].eqNullSafe(parts["__of"]) & (rows["__part"] == parts["__p"]))
    return out.withColumn("__rn", F.col("__rn") + F.col("__before")).drop("__s", "__part", "__of", "__p", "__before")


def stratified(df: DataFrame, stratum: str, key: str, target: int, seed: str) -> DataFrame:
    """Exactly target rows (or all), each stratum (null is one) by its quota, lowest ranks first."""
    quotas = apportion(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size")), stratum, "__size", target)
    quotas = quotas.select(F.col(stratum).alias("__k"), "quota")
    rows = hash_ranked(df, stratum, key, seed)
    return rows.join(quotas, rows[stratum].eqNullSafe(quotas["__k"])).where("__rn <= quota").drop("__rn", "__n", "__k", "quota")


def exact_splits(df: DataFrame, stratum: str, key: str, shares: Sequence[tuple[str, float]], rest: str, seed: str) -> DataFrame:
    """Column split: each split has exactly round(share x rows) rows, drawn in proportion from what earlier ones left of the strata; the rest is the last."""
    left = cut(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size")))
    total = left.agg(F.sum("__size")).first()[0] or 0
    limits = left.select(F.col(stratum).alias("__k"), F.lit(0).cast("long").alias("__upto"))
    ranked_rows = hash_ranked(df, stratum, key, seed)
    out, base = None, ranked_rows.columns
    for i, (name, share) in enumerate(shares):
        quota = apportion(left, stratum, "__size", round(total * share))
        left = quota.select(stratum, (F.col("__size") - F.col("quota")).alias("__size"))
        drawn = quota.select(F.col(stratum).alias("__of"), "quota")
        limits = limits.join(drawn, F.col("__k").eqNullSafe(F.col("__of"))).withColumn("__upto", F.col("__upto") + F.col("quota")).drop("quota", "__of").withColumn(f"__u{i}", F.col("__upto"))
        hit = F.col("__rn") <= F.col(f"__u{i}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    joined = ranked_rows.join(limits, ranked_rows[stratum].eqNullSafe(limits["__k"]))
    return joined.withColumn("split", out.otherwise(rest)).select(*[c for c in base if c not in ("__rn", "__n")], "split")


def balanced(df: DataFrame, label: str, key: str, per_label: int, seed: str) -> DataFrame:
    return hash_ranked(df, label, key, seed).where(F.col("__rn") <= per_label).drop("__rn", "__n")


def round_robin(df: DataFrame, stratum: str, key: str, count: int, seed: str) -> DataFrame:
    """One row a stratum in turn, until count rows."""
    turns = hash_ranked(df, stratum, key, seed).withColumnRenamed("__rn", "turn").drop("__n")
    return turns.orderBy("turn", stratum).limit(count)


def split_by_shares(df: DataFrame, key: str, shares: Sequence[tuple[str, float]], seed: str, stratum: str) -> DataFrame:
    """Column split: within a stratum, by rank, cumulative shares of its size; disjoint and complete."""
    ranked = hash_ranked(df, stratum, key, seed)
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        hit = F.col("__rn") <= F.bround(F.col("__n") * upto, 0)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return ranked.withColumn("split", out.otherwise(shares[-1][0])).drop("__rn", "__n")


def holdout(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """Column is_eval for bround(n * share) rows of all."""
    n = df.count()
    take = int(round(n * share))
    chosen = df.select(key).orderBy(sha_rank(seed, key), key).limit(take).withColumn("is_eval", F.lit(True))
    return df.join(chosen, key, "left").withColumn("is_eval", F.coalesce("is_eval", F.lit(False)))


def even_examples(df: DataFrame, category: str, order: str, k: int) -> DataFrame:
    """k evenly spaced rows of each category; the middle one for k = 1."""
    # places in the whole table less the first of the category, so no task has a category
    placed = ranked(df, [category, order], "__r")
    starts = placed.groupBy(F.col(category).alias("__of")).agg(F.min("__r").alias("__first"), F.count(F.lit(1)).alias("__m"))
    rows = placed.join(starts, F.col(category).eqNullSafe(F.col("__of"))).withColumn("__i", F.col("__r") - F.col("__first"))
    if k == 1:
        places = F.array((F.col("__m") / 2).cast("int"))
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__m") - 1) / F.lit(float(k - 1)), 0).cast("int"))
    return rows.where((F.col("__m") <= k) | F.array_contains(places, F.col("__i").cast("int"))).select(*df.columns)


def batches(df: DataFrame, group: str, key: str, size: str, target: int) -> DataFrame:
    """df with a batch: each group dealt by hash into as many batches as its total size holds targets, rounded up."""
    n = df.groupBy(F.col(group).alias("of")).agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / target)).alias("batches"))
    name = F.concat_ws("/", F.coalesce(F.col(group).cast("string"), F.lit("")), F.pmod(F.xxhash64(key), F.col("batches")))
    return df.join(n, F.col(group).eqNullSafe(F.col("of"))).withColumn("batch", name).drop("of", "batches")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rank over the whole table, 1 first: a range-partitioned sort, then the rows of the parts before."""
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    # the id's upper bits number the parts in order, the lower 33 the rows of a part; one row a part is left
    part = F.shiftright("_at", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, rank.alias(name))


def ordered_subset(df: DataFrame, strata: list[str], key: str, order: str, count: int, seed: str) -> DataFrame:
    """count rows of df, each combination of the strata (null: unknown) by its quota, with their place in the original order, from 1."""
    rows = df.withColumn("__stratum", F.to_json(F.array(*[F.coalesce(F.col(s).cast("string"), F.lit("unknown")) for s in strata])))
    return ranked(stratified(rows, "__stratum", key, count, seed).drop("__stratum"), [order, key], "place")


def pack(df: DataFrame, group: str, key: str, size: str, budget: int) -> DataFrame:
    """group, key, bin: worst-fit decreasing within a group, at least ceil(total / budget) bins.

    Sequential by nature, so each group is one task; groups must be batches of bounded size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf[key], pdf[size]), key=lambda r: (-r[1], r[0]))
        if rows and rows[0][1] > budget:
            raise ValueError(f"{rows[0][0]} alone is over the budget")
        loads = [0] * max(1, -(-int(sum(s for _, s in rows)) // budget))
        out = []
        for k, s in rows:
            fit = [i for i, load in enumerate(loads) if load + s <= budget]
            if fit:
                at = min(fit, key=lambda i: (loads[i], i))
            else:
                loads.append(0)
                at = len(loads) - 1
            loads[at] += int(s)
            out.append((pdf[group].iloc[0], k, at))
        return pd.DataFrame(out, columns=[group, key, "bin"])

    kinds = dict(df.dtypes)
    return df.select(group, key, size).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, bin int")
