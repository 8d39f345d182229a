"""Where entries of a library come from: references resolved by their prefix, then pointer jumping to the roots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, release


def resolved(entries: DataFrame, library: DataFrame, gaps: DataFrame, prefix: str = "LF", separator: str = "+") -> DataFrame:
    """id, source: a row for each source of an entry; an unknown reference is an error.

    entries: id, ref. A ref of prefix and digits is the entry at that position (from 1) of library
    (position, id); a ref that holds the separator is a merge of the refs between; any other is the id
    of a gap (gaps: id).
    """
    refs = entries.select("id", F.explode(F.split("ref", rf"\Q{separator}\E")).alias("ref")).select("id", F.btrim("ref").alias("ref"))
    number = F.try_to_number(F.regexp_extract("ref", rf"^\Q{prefix}\E0*([0-9]{{1,18}})$", 1), F.lit("999999999999999999")).cast("long")
    refs = refs.withColumn("position", number)
    by_place = library.select(F.col("position").cast("long").alias("position"), F.col("id").alias("_library"))
    by_name = gaps.select(F.col("id").alias("ref"), F.col("id").alias("_gap")).distinct()
    found = refs.join(by_place, "position", "left").join(by_name, "ref", "left")
    source = F.coalesce(F.when(F.col("position").isNotNull(), F.col("_library")).otherwise(F.col("_gap")), F.raise_error(F.concat(F.lit("unknown reference: "), F.col("ref"))).cast("string"))
    return found.select("id", source.alias("source"))


def roots(edges: DataFrame) -> DataFrame:
    """id, root of every id that has a source: all entries without a source that it comes from; a cycle is an error.

    edges: id, source. Each round doubles the steps a pointer goes back, so their number is the
    logarithm of the longest chain; pointers that arrived are written apart and not joined again.
    """
    now = cut(edges.select("id", "source").distinct(), shuffled=True)
    # a chain without a cycle passes each id once
    most = math.ceil(math.log2(max(2, now.select("id").distinct().count()))) + 1
    for _ in range(most + 1):
        has = now.select(F.col("id").alias("source")).distinct()
        if now.join(has, "source", "left_semi").isEmpty():
            return now.select("id", F.col("source").alias("root"))
        jump = now.select(F.col("id").alias("source"), F.col("source").alias("up"))
        old, now = now, cut(now.join(jump, "source", "left").select("id", F.coalesce("up", "source").alias("source")).distinct(), shuffled=True)
        release(old)
    raise ValueError("the references go round in a cycle")
