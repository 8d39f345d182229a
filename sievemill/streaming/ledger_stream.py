"""Ledgers as streams: completed runs once each, latest rows by micro-batch upsert."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import latest


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def completed(stream: DataFrame, key: str = "run_hash", time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Rows with status ok, the first of each key; a watermark bounds the state where there is an event time."""
    ok = stream.where("status = 'ok'")
    return ok.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key]) if time else ok.dropDuplicates([key])


def progress(stream: DataFrame) -> DataFrame:
    return stream.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keep path/version=N as the latest rows; each micro-batch writes the next version."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/version={epoch - 1}") if epoch else None
        rows = batch if old is None else batch.unionByName(old)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recovery_stream(events: DataFrame, key: str, seed: int = 7, stride: int = 4, max_attempts: int = 3) -> DataFrame:
    """The state of every slot that an event touches: key, sample_index, version, attempt, seed, retry.

    events: a stream of key, sample_index, status and error: a candidate (ok) or a failed try. A slot is to be
    tried again while it has no candidate, all its failures are for want of planned steps, and they are fewer
    than max_attempts; its seed moves by stride a failure. The row of a slot with the highest version is
    what operators.library.missing_slots says of the events so far, however they fall into micro-batches:
    the state is three counts, which no order of events changes.
    """
    kind = dict(events.dtypes)[key]

    def update(slot: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        present, attempt, fit, version = state.get if state.exists else (0, 0, 0, 0)
        for f in frames:
            failed = f[f["status"] != "ok"]
            present += len(f) - len(failed)
            attempt += len(failed)
            fit += int(failed["error"].fillna("").str.contains("planned_steps", regex=False).sum())
            version += len(f)
        state.update((present, attempt, fit, version))
        retry = not present and 0 < attempt < max_attempts and fit == attempt
        yield pd.DataFrame([(slot[0], slot[1], version, attempt, seed + int(slot[1]) + attempt * stride, retry)], columns=[key, "sample_index", "version", "attempt", "seed", "retry"])

    rows = events.select(key, F.col("sample_index").cast("int").alias("sample_index"), "status", "error")
    out = f"{key} {kind}, sample_index int, version long, attempt long, seed long, retry boolean"
    return rows.groupBy(key, "sample_index").applyInPandasWithState(update, out, "present long, attempt long, fit long, version long", "update", GroupStateTimeout.NoTimeout)


def latest_slots(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows that recovery_stream wrote, the slots to try again: key, sample_index, seed, attempt."""
    last = rows.groupBy(key, "sample_index").agg(F.max(F.struct("version", "attempt", "seed", "retry")).alias("s"))
    return last.where("s.retry").select(key, "sample_index", "s.seed", "s.attempt")
