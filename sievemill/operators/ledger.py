"""Append-only ledgers: latest rows, pending jobs, job expansion, shards, run identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_hash
from .sampling import ranked


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order, as one aggregation with map-side combine; rows with a null key stay."""
    rest = [c for c in df.columns if c not in keys]
    known = df.where(" and ".join(f"{k} is not null" for k in keys))
    last = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(*df.columns)
    return last.unionByName(df.where(" or ".join(f"{k} is null" for k in keys)))


def planned(rows: DataFrame, plan: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is in the plan; all without a plan."""
    return rows if plan is None else rows.join(plan.select(key), key, "left_semi")


def pending(jobs: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Jobs without an 'ok' row."""
    return jobs.join(ledger.where("status = 'ok'").select(key), key, "left_anti")


def expand_jobs(cases: DataFrame, conditions: Sequence[str], samples: int, seed: int) -> DataFrame:
    """cases x conditions x sample_index by explosion (no join), with seed + sample_index."""
    out = cases.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions]))).withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return out.withColumn("seed", F.col("sample_index") + seed)


def run_hash(df: DataFrame, *parts: str) -> DataFrame:
    return df.withColumn("run_hash", canonical_hash(*[F.col(p) for p in parts]))


def shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """shard = rank of the distinct key modulo n; the ranks are of keys, not of rows, and no task has all keys. Null keys have no shard and are left out."""
    ranks = ranked(df.select(key).distinct().where(F.col(key).isNotNull()), [key], "__rank")
    return df.join(ranks.select(key, F.pmod(F.col("__rank") - 1, F.lit(n)).cast("int").alias("shard")), key)


def current(df: DataFrame, **context: str) -> DataFrame:
    """Rows whose context fields match; all rows if none has any context."""
    has = F.lit(False)
    fits = F.lit(True)
    for name, value in context.items():
        has = has | F.col(name).isNotNull()
        fits = fits & F.col(name).eqNullSafe(F.lit(value))
    if df.where(has).isEmpty():
        return df
    return df.where(fits)
