"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; a byte order mark and blank lines are skipped, a missing path is empty unless strict."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], kind)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.btrim("value") != "")
    parsed = lines.select(F.from_json("value", kind, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    out = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return out.select(*columns) if columns else out


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file, with the file's name without its extension as file_id."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def read_shards(spark: SparkSession, run_dir: str, name: str, schema: str) -> DataFrame:
    """run_dir/shards/*/name if there is any, else run_dir/name."""
    shards = f"{run_dir}/shards/*/{name}"
    return read_jsonl(spark, shards if exists(spark, shards) else f"{run_dir}/{name}", schema)


def unique(df: DataFrame, key: str) -> DataFrame:
    """df; fails at run time if a key occurs twice."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    checked = twice.select(key, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string")))).cast("int").alias("__bad"))
    return df.join(checked, key).where("__bad is null").drop("__bad")


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_manifest(df: DataFrame, path: str) -> None:
    """An aggregate of a few rows as one JSON file. It is written beside the old one, which it then replaces: a
    failed write leaves the old one, and between deleting and renaming there is none; a part is never seen."""
    df.coalesce(1).write.mode("overwrite").json(f"{path}.new")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path}.new could not be renamed")


def append_ledger(df: DataFrame, ledger: DataFrame, path: str, key: str = "run_hash") -> None:
    """Append the rows whose key has no 'ok' row yet, one a key, an 'ok' one if there is any; errors do not block a retry."""
    new = df.join(ledger.where("status = 'ok'").select(key), key, "left_anti")
    row = F.struct(*[new[f"`{c}`"] for c in new.columns])
    one = new.groupBy(key).agg(F.max_by(row, F.struct(F.col("status").eqNullSafe("ok"), F.to_json(row))).alias("row"))
    one.select("row.*").write.mode("append").json(path)


def blind(df: DataFrame, *hidden: str) -> DataFrame:
    return df.drop(*hidden)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 and non-empty lines of each file."""
    files = spark.read.format("binaryFile").load(path)
    lines = F.filter(F.split(F.decode("content", "UTF-8"), r"\r?\n"), lambda x: F.btrim(x) != "")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.size(lines).alias("lines"))


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A small report as a Markdown table; limit is the report's own."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def row_indexed(spark: SparkSession, path: str, name: str = "row_index") -> DataFrame:
    """A Parquet table with the place of each row, from 0: files in the order of their names, rows in that of the file.

    Places come from the files' metadata, so they do not depend on how the scan is split. Beside the
    scan there is one of no columns, for the rows of each file.
    """
    df = spark.read.parquet(path)
    sizes = df.groupBy(F.col("_metadata.file_name").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    # a row a file
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    rows = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(before, "_file").withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_before", "_at")


def with_raw(df: DataFrame, raw: DataFrame, key: str, columns: list[str], index: str = "row_index", pattern: str = r"(\d+)$") -> DataFrame:
    """df with its null columns filled from raw (row_indexed), at the row that the key ends with; fails at run time if that is no row."""
    place = F.regexp_extract(F.col(key).cast("string"), pattern, 1).try_cast("long")
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
    rows = df.withColumn("_place", F.when(lacks, F.coalesce(place, F.lit(-1))))
    found = rows.join(raw.select(F.col(index).alias("_place"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_raw_{c}") for c in columns]), "_place", "left")
    ok = F.when(F.col("_place").isNull() | F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no raw row for "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(ok).withColumns({c: F.coalesce(c, f"_raw_{c}") for c in columns}).select(*df.columns)
