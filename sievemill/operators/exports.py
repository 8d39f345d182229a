"""Checks before exported rows are trained on: integrity against a manifest, lengths in tokens, a frozen protocol."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_hash
from ..sources.io import exists

#: Ids that a problem names.
NAMED = 5


def rows_hash(df: DataFrame) -> str:
    """One hash of all rows, repeats included, whatever their order: of the sums of the parts of the rows' hashes."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(4)]
    return df.agg(F.count(F.lit(1)).cast("string").alias("n"), *parts).select(canonical_hash(*[F.col(c) for c in ("n", "p0", "p1", "p2", "p3")]).alias("h")).first()["h"]


def manifest_of(rows: DataFrame, **settings: str) -> dict:
    """What an export says of itself: its rows' number and hash, and the settings that it was made with."""
    return {"rows": rows.count(), "rows_hash": rows_hash(rows), **settings}


def export_problems(rows: DataFrame, manifest: dict, current: dict, prompts: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """problem, n, first: what is wrong with exported rows (id, prompt, prompt_hash, ...); no rows if nothing is.

    manifest: as of manifest_of, recorded with the export; current: the settings that must equal the
    recorded ones; required: settings that must be recorded; prompts: id, prompt as they are made today.
    """
    spark = rows.sparkSession
    now = manifest_of(rows)
    whole = [(f"{k} is {manifest.get(k)}, not {v}", 1, []) for k, v in (now | current).items() if manifest.get(k) != v]
    whole += [(f"{k} is not recorded", 1, []) for k in required if not str(manifest.get(k) or "").strip()]
    name = F.coalesce(F.col("id").cast("string"), F.lit("<missing-id>"))
    made = prompts.groupBy(F.col("id").alias("_id")).agg(F.max(F.sha2(F.coalesce("prompt", F.lit("")), 256)).alias("_now"))
    own = F.sha2(F.coalesce("prompt", F.lit("")), 256)
    tests = {"prompt does not match its hash": ~F.col("prompt_hash").eqNullSafe(own), "prompt is made otherwise today": ~F.col("prompt_hash").eqNullSafe(F.col("_now")), "no id": F.col("id").isNull()}
    checked = rows.join(made, F.col("id") == F.col("_id"), "left").select(name.alias("name"), F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("problem"))
    twice = rows.where("id is not null").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("name", F.lit("id repeats").alias("problem"))
    each = checked.unionAll(twice)
    counted = each.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    # of each problem the first ids only: ranks are limited in the tasks
    first = each.groupBy("problem", "name").agg(F.count(F.lit(1)).alias("c")).select("problem", "name").withColumn("r", F.expr("row_number() over (partition by problem order by name)")).where(F.col("r") <= NAMED)
    named = first.groupBy("problem").agg(F.array_sort(F.collect_list("name")).alias("first"))
    return spark.createDataFrame(whole, "problem string, n long, first array<string>").unionAll(counted.join(named, "problem").select("problem", "n", "first"))


def longest(rows: DataFrame, key: str, texts: dict[str, list[str | Column]], tokens: Callable[[list[str]], list[int]]) -> DataFrame:
    """key, name, tokens: the row with most tokens of each named text, the concatenation of its columns; ties by key.

    tokens counts the tokens of a batch of texts; a task passes on its longest only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = pa.array(tokens(b.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], [key, "name", "tokens"])

    whole = F.array(*[F.struct(F.lit(n).alias("name"), F.concat(*[F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in columns]).alias("text")) for n, columns in texts.items()])
    long = rows.select(key, F.inline(whole)).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, name string, tokens long")
    best = long.groupBy("name").agg(F.max("tokens").alias("tokens"), F.min_by(key, F.struct(-F.col("tokens"), key)).alias(key))
    return best.select(key, "name", "tokens")


def within_length(rows: DataFrame, key: str, texts: dict[str, list[str | Column]], tokens: Callable[[list[str]], list[int]], most: int, end_tokens: int = 1) -> int:
    """The most tokens of a text and its end; an error that names the text if that is over ``most``: nothing is cut silently."""
    found = longest(rows, key, texts, tokens).orderBy(F.desc("tokens"), "name").first()
    n = found["tokens"] + end_tokens if found else 0
    if n > most:
        raise ValueError(f"{found['name']} of {found[key]} has {n} tokens, more than {most}")
    return n


class Protocol:
    """Digests of what a held-out evaluation depends on: frozen once, then sealed with what is evaluated."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def recorded(self, name: str) -> dict | None:
        path = f"{self.path}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(path).collect()))

    def write(self, name: str, digests: dict) -> None:
        old = self.recorded(name)
        if old is not None and old != digests:
            raise ValueError(f"{name} already, with other digests: {sorted(k for k in old | digests if old.get(k) != digests.get(k))}")
        if old is None:
            self.spark.createDataFrame([(json.dumps(digests, sort_keys=True),)], "value string").coalesce(1).write.text(f"{self.path}/{name}")

    def freeze(self, digests: dict) -> None:
        self.write("frozen", digests)

    def seal(self, digests: dict, evaluated: dict) -> None:
        """The digests must be the frozen ones; evaluated: the checkpoints that may be run on the held-out part."""
        self.check(digests)
        self.write("sealed", evaluated)

    def check(self, digests: dict, evaluated: dict | None = None) -> None:
        """An error unless everything is as it was frozen and, for the held-out part, sealed."""
        for name, now in (("frozen", digests), ("sealed", evaluated)):
            if now is None:
                continue
            old = self.recorded(name)
            if old is None:
                raise ValueError(f"the protocol is not {name}")
            differ = sorted(k for k in old | now if old.get(k) != now.get(k))
            if differ:
                raise ValueError(f"changed since the protocol was {name}: {differ}")
