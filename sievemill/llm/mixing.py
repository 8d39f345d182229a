"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded hash order, are cut into blocks of ``block_docs``. Of a
source with weight w, block j (0-based) is released at slot floor(j / w) and due at
ceil((j + 1) / w); in every slot the earliest deadline among released blocks runs. As the
weights sum to 1, every deadline is met, and at any slot t a source has had more than w * t - 1
and fewer than w * t + 1 blocks.

Weights are whole shares of ``shares`` (largest remainder), so the schedule of a phase repeats
after at most ``shares`` slots: one period is simulated on the driver (a bounded table, whatever
the data) and every block's slot follows by arithmetic. When a source runs out, the next phase
shares the slots among the remaining sources in proportion to their weights; nothing is dropped
or repeated. There are at most as many phases as sources.

Ranks within a source need no window over a whole source: documents are dealt by hash to
buckets of about ``bucket_docs``, bucket counts are summed up, and the window runs inside a
bucket. So one source may hold any share of all rows.

The driver plans lanes. A source is a lane of its own while there are at most ``max_sources``; beyond
that, those with a given weight (at most ``max_sources``, else it is an error) and the largest others are, and the
rest are pooled by size class (powers of two, so at most 64 more lanes), whose weight is the sum of
theirs. So what is collected and broadcast is bounded: a row a
lane, and a row a lane and phase with at most ``shares`` (or lanes, if more) slots a phase in all.

Within a pooled lane the sources are scheduled once more, by arithmetic alone: document i of a
source with weight w is due at (i + 1/2) / w, and the lane's order is that of the due times. At any
point of the lane a source of it is within half a document of w times the time reached, and that time within
half a document a source of its own; as the weights of a class differ by a factor of 1.42 at most, that is
1.3 documents in all. Its share of the lane's own deviation is under 1.42 / k blocks for k sources. So
with the usual block of 16 documents any number of sources stay within one block of their weights.

The default weights are the square roots of the sources' sizes (temperature 2). Edge cases: a
null source is a source of its own; sources without a given weight share one smallest share
each, after the others; repeated rows are placed like any other; rows of one doc_id are ordered by a
hash of their columns, those without a doc_id dealt by it; an empty table gives no rows;
extra columns are kept, but for any that are named like the four added ones, which replace them.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .common import cut

SHARES = 1024
ADDED = ["source_rank", "block", "slot", "slot_rank"]


def whole_shares(weights: dict, shares: int = SHARES) -> dict:
    """Positive whole shares in proportion to weights, by largest remainder; ties by name."""
    if not weights:
        return {}
    shares = max(shares, len(weights))
    names = sorted(weights, key=lambda k: (k is None, str(k)))
    total = sum(weights[k] for k in names)
    exact = {k: (weights[k] / total * (shares - len(names)) if total > 0 else (shares - len(names)) / len(names)) for k in names}
    out = {k: 1 + math.floor(exact[k]) for k in names}
    for k in sorted(names, key=lambda k: (math.floor(exact[k]) - exact[k], names.index(k)))[: shares - sum(out.values())]:
        out[k] += 1
    return out


def period(shares: dict) -> list:
    """The source that runs in each slot of one period, earliest deadline first; ties by name."""
    names = sorted(shares, key=lambda k: (k is None, str(k)))
    total = sum(shares.values())
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[names[i]]), i, j))
        due, i, j = heapq.heappop(ready)
        assert due > t
        out.append(names[i])
        if j + 1 < shares[names[i]]:
            heapq.heappush(waiting, ((j + 1) * total // shares[names[i]], i, j + 1))
    return out


def phases(blocks: dict, shares: dict) -> list[dict]:
    """Phases of the schedule: the slot each starts at, its period, each source's blocks done before and within."""
    left, done, start, out = {k: n for k, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        part = {k: shares[k] for k in left}
        g = math.gcd(*part.values())
        part = {k: v // g for k, v in part.items()}
        order = period(part)
        total = len(order)
        # whole periods that all sources can fill, then the prefix up to the first that runs out
        rounds = min(left[k] // part[k] for k in left)
        used = {k: rounds * part[k] for k in left}
        prefix = 0
        while prefix < total and all(used[k] < left[k] for k in left):
            used[order[prefix]] += 1
            prefix += 1
        out.append({"start": start, "order": order, "shares": part, "before": {k: done[k] for k in left}, "used": used})
        start += rounds * total + prefix
        for k in list(left):
            done[k] += used[k]
            left[k] -= used[k]
            if not left[k]:
                del left[k]
    return out


def has_map(kind: DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return isinstance(kind, MapType) or any(has_map(k) for k in parts)


def row_hash(docs: DataFrame, columns: list[str]) -> Column:
    """A hash of the columns, so that rows that differ have an order of their own."""
    fields = {f.name: f.dataType for f in docs.schema.fields}
    return F.xxhash64(*[F.to_json(F.struct(docs[f"`{c}`"])) if has_map(fields[c]) else docs[f"`{c}`"] for c in columns])


def lanes_of(docs: DataFrame, weights: dict | None, max_sources: int) -> tuple[DataFrame, dict, dict, int]:
    """docs with __lane and, of sources in pooled lanes, __n (their rows, else null); the number of rows and the weight of each lane; how many lanes are a source's own."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    n_sources = sizes.count()
    given = {k: w for k, w in (weights or {}).items() if w and w > 0}
    if len(given) > max_sources:
        raise ValueError(f"{len(given)} weights, more than max_sources")
    spark = docs.sparkSession
    if n_sources > max_sources:
        sizes = cut(sizes)
        listed = F.broadcast(spark.createDataFrame([(k,) for k in given] or [(None,)], "of string").where(F.lit(bool(given))))
        named = sizes.join(listed, F.col("source").eqNullSafe(F.col("of")), "left_semi").collect()
        others = sizes.join(listed, F.col("source").eqNullSafe(F.col("of")), "left_anti")
        named += others.orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(max_sources - len(named)).collect()
    else:
        named = sizes.collect()
    named.sort(key=lambda r: (r["source"] is None, str(r["source"])))
    own = F.broadcast(spark.createDataFrame([(r["source"], i) for i, r in enumerate(named)] or [(None, 0)], "__of string, __own int"))
    dealt = docs.join(own, F.col("source").eqNullSafe(F.col("__of")), "left")
    counts = {i: r["n"] for i, r in enumerate(named)}
    if weights is None:
        weight = {i: math.sqrt(n) for i, n in counts.items()}
    else:
        least = min((given[r["source"]] for r in named if r["source"] in given), default=1.0)
        weight = {i: given.get(r["source"], least * 1e-9) for i, r in enumerate(named)}
    if n_sources <= max_sources:
        return dealt.withColumns({"__lane": F.col("__own"), "__n": F.lit(None).cast("long")}), counts, weight, len(named)
    # the pooled sources are many small ones, so their sizes are joined, not broadcast
    size_class = F.floor(F.log2("n")).cast("int")
    rest = sizes.join(own, F.col("source").eqNullSafe(F.col("__of")), "left_anti").select(F.col("source").alias("__small"), size_class.alias("__class"), "n")
    for r in rest.groupBy("__class").agg(F.sum("n").alias("n"), F.sum(F.sqrt("n")).alias("w"), F.count(F.lit(1)).alias("k")).collect():
        lane = len(named) + r["__class"]
        counts[lane], weight[lane] = r["n"], r["w"] if weights is None else least * 1e-9 * r["k"]
    pooled = dealt.where("__own is null").join(rest.select("__small", "__class", F.col("n").alias("__n")), F.col("source").eqNullSafe(F.col("__small"))).withColumn("__lane", F.col("__class") + len(named)).drop("__small", "__class")
    own_lanes = dealt.where("__own is not null").withColumns({"__lane": F.col("__own"), "__n": F.lit(None).cast("long")})
    return own_lanes.unionByName(pooled), counts, weight, len(named)


def due_times(dealt: DataFrame, first: int, rooted: bool, bucket_docs: int) -> DataFrame:
    """dealt with __due (0 to 1, of the lane's time; null where a lane is one source): (rank in the source + 1/2) over its weight."""
    part = F.expr(f"shiftright(shiftrightunsigned(__h, 33) * greatest(1, __n div {bucket_docs}), 31)")
    pooled = dealt.where("__n is not null").withColumn("__part", part)
    rank = F.row_number().over(Window.partitionBy("source", "__part").orderBy("__h", "__id", "__row"))
    pooled = pooled.withColumn("__in", rank)
    parts = pooled.groupBy("source", "__part").agg(F.count(F.lit(1)).alias("__c"))
    before = parts.select(F.col("source").alias("__of"), F.col("__part").alias("__p"), (F.sum("__c").over(Window.partitionBy("source").orderBy("__part")) - F.col("__c")).alias("__before"))
    pooled = pooled.join(before, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__p")))
    # weights of a source of n rows: its root, or 1; the last document of the largest source of class c is due before the lane's end
    weight, end = (F.sqrt("__n"), F.pow(F.lit(2.0), (F.col("__lane") - first + 1) / 2)) if rooted else (F.lit(1.0), F.pow(F.lit(2.0), F.col("__lane") - first + 1))
    due = (F.col("__in") + F.col("__before") - 0.5) / weight / end
    pooled = pooled.withColumn("__due", due).drop("__part", "__in", "__of", "__p", "__before")
    return dealt.where("__n is null").withColumn("__due", F.lit(None).cast("double")).unionByName(pooled)


def mix_sources(docs: DataFrame, weights: dict | None = None, block_docs: int = 16, shares: int = SHARES, bucket_docs: int = 4096, seed: str = "mix", max_sources: int = 512) -> DataFrame:
    """docs with source_rank (in its lane), block, slot and slot_rank: the mixed order is (slot, slot_rank)."""
    spark = docs.sparkSession
    # a row travels as one struct, so no column of docs can clash with the names used here
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), docs["source"].alias("source"), docs["doc_id"].alias("__id"), row_hash(docs, kept).alias("__row"))
    rows, counts, weight, first = lanes_of(rows, weights, max_sources)
    blocks = {k: -(-n // block_docs) for k, n in counts.items()}
    share = whole_shares(weight, shares)
    # (lane, phase, position in the period) -> slot; bounded by shares x lanes, whatever the number of documents
    plan_rows = []
    for n, p in enumerate(phases(blocks, share)):
        offsets: dict = {k: [] for k in p["shares"]}
        for t, k in enumerate(p["order"]):
            offsets[k].append(t)
        for k, own in offsets.items():
            plan_rows.append((k, n, p["before"][k], p["before"][k] + p["used"][k], p["start"], len(p["order"]), own))
    buckets = spark.createDataFrame([(k, max(1, n // bucket_docs)) for k, n in counts.items()] or [(0, 1)], "__lane int, n_buckets long")
    dealt = rows.select("row", "source", "__lane", "__n", "__id", "__row", F.when(F.col("__id").isNull(), F.col("__row")).otherwise(F.xxhash64(F.lit(seed), "__id")).alias("__h"))
    dealt = due_times(dealt, first, weights is None, bucket_docs) if len(counts) > first else dealt.withColumn("__due", F.lit(None).cast("double"))
    bucket = F.when(F.col("__due").isNull(), F.expr("shiftright(shiftrightunsigned(__h, 33) * n_buckets, 31)")).otherwise(F.floor(F.col("__due") * F.col("n_buckets")))
    dealt = dealt.join(F.broadcast(buckets), "__lane").withColumn("__bucket", bucket).drop("n_buckets")
    sizes = dealt.groupBy("__lane", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__lane", "__bucket", (F.sum("n").over(Window.partitionBy("__lane").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__lane", "__bucket").orderBy("__due", "__h", "__id", "__row")) - 1).join(before, ["__lane", "__bucket"])
    ranked = ranked.withColumn("source_rank", (F.col("__rank") + F.col("__before")).cast("long")).withColumn("block", F.expr(f"source_rank div {block_docs}"))
    plan = spark.createDataFrame(plan_rows or [(0, 0, 0, 0, 0, 1, [0])], "p_lane int, phase int, first_block long, end_block long, start long, period long, offsets array<long>")
    placed = ranked.join(F.broadcast(plan), (F.col("__lane") == F.col("p_lane")) & (F.col("block") >= F.col("first_block")) & (F.col("block") < F.col("end_block")))
    k = F.col("block") - F.col("first_block")
    slot = F.col("start") + F.expr("(block - first_block) div size(offsets)") * F.col("period") + F.get("offsets", (k % F.size("offsets")).cast("int"))
    return placed.withColumn("slot", slot.cast("long")).withColumn("slot_rank", F.pmod("source_rank", F.lit(block_docs)).cast("int")).select("row.*", *ADDED)
