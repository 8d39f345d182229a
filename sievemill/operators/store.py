"""A store of vectors by content: each text is encoded once, whatever the number of runs.

Rows are keyed by the hash of the text and bucketed by it, so that looking up which texts are
missing shuffles the asking side only. A manifest guards the settings: a store that was made with
another model, length or corpus is not mixed with.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import exists
from .models import Encoder, fake_encoder

BUCKETS = 64


def corpus_hash(df: DataFrame, key: str, text: str) -> str:
    """One hash of all (key, text), whatever their order: of the sums of halves of the rows' hashes."""
    h = F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\u0001"), F.coalesce(text, F.lit("\u0000"))), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(4)]
    row = df.select(F.count(F.lit(1)).cast("string").alias("n"), *parts).select(F.sha2(F.concat_ws(":", "n", *[f"p{i}" for i in range(4)]), 256).alias("h"))
    return row.first()["h"]


class VectorStore:
    """path/vectors (sha, vector), a bucketed table, and path/manifest, its settings."""

    def __init__(self, spark: SparkSession, path: str, settings: dict, buckets: int = BUCKETS, force: bool = False) -> None:
        self.spark, self.path = spark, path
        self.name = f"vectors_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        manifest = f"{path}/manifest"
        if exists(spark, f"{manifest}/_SUCCESS"):
            old = json.loads("\n".join(r["value"] for r in spark.read.text(manifest).collect()))
            differ = {k: (old.get(k), v) for k, v in settings.items() if old.get(k) != v}
            if differ and not force:
                raise ValueError(f"{path} was built with other settings: {differ}")
        if force or not exists(spark, f"{manifest}/_SUCCESS"):
            spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
        if force:
            spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (sha STRING, vector ARRAY<FLOAT>) USING parquet CLUSTERED BY (sha) SORTED BY (sha) INTO {buckets} BUCKETS LOCATION '{path}/vectors'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, df: DataFrame, text: str) -> DataFrame:
        """sha, text of the distinct texts that the store lacks."""
        asked = df.select(F.coalesce(text, F.lit("")).alias("text")).select(F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["sha"])
        return asked.join(self.table().select("sha"), "sha", "left_anti")

    def fill(self, df: DataFrame, text: str, encoder: Encoder = fake_encoder) -> tuple[int, int]:
        """Encode what is missing; the number of distinct texts that were there, and that were not."""
        width = self.table().select(F.size("vector").alias("n")).first()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = np.asarray(encoder(b.column(1).to_pylist()), np.float32)
                if m.ndim != 2 or len(m) != b.num_rows or (width is not None and len(m) and m.shape[1] != width["n"]):
                    raise ValueError("the encoder returned a matrix of another shape")
                m /= np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(m), pa.list_(pa.float32()))], ["sha", "vector"])

        n = df.select(F.sha2(F.coalesce(text, F.lit("")), 256)).distinct().count()
        before = self.table().count()
        rows = self.missing(df, text).mapInArrow(run, "sha string, vector array<float>")
        rows.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        new = self.table().count() - before
        return n - new, new

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, vector of every row whose text is in the store."""
        rows = df.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha"))
        return rows.join(self.table(), "sha").select(key, "vector")
