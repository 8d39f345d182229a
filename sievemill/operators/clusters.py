"""Clusters of bounded size within families: k-means of all families at once, then exact rebalancing.

``family_batches`` chains the two: a family that fits one batch stays whole, a larger one is cut
into ``similarity.batch_clusters`` clusters, and members move at the least loss of similarity until
every batch is within its bounds. No family is a task: rows are dealt over all cores once, centres are
held in blocks of a checked size, sums are made in the tasks first (an iteration is one job), and moves
are ranked in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import cut, release, spread
from .similarity import batch_clusters

#: Bytes of centres that a task holds; more of them are read in several passes.
CENTRE_BYTES = 64 << 20
#: Parts of a list that is ranked.
PARTS = 64


def normalised(x: np.ndarray) -> np.ndarray:
    """Unit rows; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def start_centres(rows: DataFrame, counts: DataFrame, seed: str) -> DataFrame:
    """family, cluster, centre: of each family its first k members by the hash of seed and id; counts: family, k."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    # about 4 k + 64 members of a family are ranked: fewer than k would need a chance far below 1e-15
    spread = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / float(1 << 48)
    held = rows.join(counts, "family").withColumn("h", order)
    near = held.where((spread < 4.0 * F.col("k") / F.col("n") + 64.0 / F.col("n")))
    first = near.withColumn("cluster", F.row_number().over(Window.partitionBy("family").orderBy("h", "id")) - 1)
    return first.where("cluster < k").select("family", "cluster", "vector")


def blocks_of(counts: DataFrame, width: int, limit: int = CENTRE_BYTES) -> list[list]:
    """Families in blocks whose centres take at most limit bytes (or a family alone): a row a family of several clusters."""
    out: list[list] = []
    held = 0
    for r in counts.select("family", "k").orderBy("family").toLocalIterator():
        size = r["k"] * width * 8
        if not out or held + size > limit:
            out.append([])
            held = 0
        out[-1].append(r["family"])
        held += size
    return out


def centre_map(centres: DataFrame) -> dict:
    """family -> matrix of centres in the order of clusters; the caller bounds their size."""
    rows = centres.select("family", "cluster", "vector").toArrow()
    out: dict = {}
    for f, c, v in zip(rows["family"].to_pylist(), rows["cluster"].to_pylist(), rows["vector"].to_pylist()):
        out.setdefault(f, []).append((c, v))
    return {f: np.array([v for _, v in sorted(x)], float) for f, x in out.items()}


def centre_table(spark: SparkSession, centres: dict, kind: str) -> DataFrame:
    """family, cluster, vector of a centre_map."""
    rows = [(f, j, v) for f, c in centres.items() for j, v in enumerate(c.tolist())]
    return cut(spark.createDataFrame(rows, f"family {kind}, cluster long, vector array<double>"))


def by_family(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """family, places, vectors of a batch with the columns id, family and vector."""
    coded = batch.column(1).dictionary_encode()
    x = vectors_of(batch.column(2))
    at = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    for f, places in zip(coded.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(at, minlength=len(coded.dictionary)))[:-1])):
        yield f, places, x[places]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by squared distance, the first of equals."""
    return np.argmin(np.round((c * c).sum(1)[None, :] - 2 * x @ c.T, 12), axis=1)


def lloyd_step(spark: SparkSession, rows: DataFrame, centres: dict, kind: str) -> dict:
    """The means of the members nearest to each centre; a centre without members stays. Families without centres are passed over.

    Sums are added up in the tasks, then a cluster in one place; what reaches the driver is as large as the centres.
    """
    shared = spark.sparkContext.broadcast(centres)
    ddl = f"family {kind}, cluster long, sums array<double>"

    def out(named: pa.DataType, keys: list, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], named), pa.array([c for _, c in keys], pa.int64()), pa.array(sums, pa.list_(pa.float64()))], ["family", "cluster", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        named = None
        for b in batches:
            named = b.column(1).type
            for f, _, x in by_family(b):
                c = shared.value.get(f)
                if c is None:
                    continue
                s = sums.setdefault(f, np.zeros((len(c), c.shape[1] + 1)))
                at = nearest(x, c)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
                s[at[order][first]] += np.add.reduceat(np.hstack([x, np.ones((len(x), 1))])[order], first, axis=0)
        for f, s in sums.items():
            some = np.flatnonzero(s[:, -1])
            yield out(named, [(f, c) for c in some.tolist()], s[some].tolist())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        named = None
        for b in batches:
            named = b.column(0).type
            for f, c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), vectors_of(b.column(2))):
                total[f, c] = total[f, c] + v if (f, c) in total else v
        if total:
            yield out(named, list(total), [v.tolist() for v in total.values()])

    found = rows.mapInArrow(run, ddl).repartition("family", "cluster").mapInArrow(merge, ddl).toArrow()
    shared.destroy()
    moved = {f: c.copy() for f, c in centres.items()}
    for f, c, v in zip(found["family"].to_pylist(), found["cluster"].to_pylist(), vectors_of(found["sums"].combine_chunks())):
        moved[f][c] = v[:-1] / v[-1]
    return moved


def family_kmeans(df: DataFrame, family: str, key: str, vector: str, counts: DataFrame, seed: str = "kmeans", iterations: int = 25, starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (family, id, cluster, sims: cosines to all centres of the family) and centres (family, cluster, vector).

    counts: family, n, k. All families iterate together until no centre moves. starts: family,
    cluster, vector in place of the members that the seed chooses. Vectors are made unit vectors.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(family).alias("family"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null and family is not null")
    rows = cut(unit(spread(rows, "id")))
    kind = rows.schema["family"].dataType.simpleString()
    start = starts if starts is not None else start_centres(rows, counts, seed)
    centres = cut(start.select("family", F.col("cluster").cast("long").alias("cluster"), F.col("vector").cast("array<double>").alias("vector")), shuffled=True)
    head = centres.select(F.size("vector").alias("d")).first()
    if head is None:
        raise ValueError("no family has members")
    done = []
    for names in blocks_of(counts, head["d"]):
        # a block of centres is held here and in the tasks, within CENTRE_BYTES
        now = centre_map(centres.join(F.broadcast(spark.createDataFrame([(f,) for f in names], f"family {kind}")), "family"))
        for _ in range(iterations):
            old, now = now, lloyd_step(spark, rows, now, kind)
            if all(np.abs(now[f] - old[f]).max(initial=0) <= 1e-9 for f in now):
                break
        done.append((cut(assigned(spark, rows, now, kind)), centre_table(spark, now, kind)))
    release(rows, centres)
    members, final = done[0]
    for m, c in done[1:]:
        members, final = members.unionAll(m), final.unionAll(c)
    return members, final


def unit(rows: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    # the norm is formed once a row, not once for each entry
    return rows.withColumn("vector", let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform("vector", lambda x: x / n)))


def assigned(spark: SparkSession, rows: DataFrame, centres: dict, kind: str) -> DataFrame:
    """family, id, cluster, sims of the rows whose family has centres."""
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, at, x in by_family(b):
                c = shared.value.get(f)
                if c is None:
                    continue
                # rounded, so that ties are ties whatever the order of the sums
                sims = np.round(x @ normalised(c).T, 9)
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), b.column(1).type), b.column(0).take(pa.array(at)), pa.array(nearest(x, c)), pa.array(sims.tolist(), pa.list_(pa.float64()))], ["family", "id", "cluster", "sims"])

    return rows.mapInArrow(run, f"family {kind}, id {rows.schema['id'].dataType.simpleString()}, cluster long, sims array<double>")


def ranked_in_parts(df: DataFrame, group: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """df with the rank of each row in its group, from 1; part must not fall along the order, and tells the tasks of a group apart."""
    rows = df.withColumn("_part", part)
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    sizes = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select(*group, "_part", (F.sum("_c").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_c")).alias("_before"))
    return rows.join(before, [*group, "_part"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before", "_c")


def loss_part(loss: Column) -> Column:
    """Losses of similarity lie in [-2, 2]."""
    return F.floor((loss + 2) * (PARTS / 4))


def rebalance(members: DataFrame, least: int, most: int) -> DataFrame:
    """family, id, cluster with least to most members in every cluster of a family; members: family, id, cluster, sims.

    The greedy rule: while a cluster has over most members, the largest (the first of equals)
    gives up the member that loses least similarity (ties by id, then by cluster) to a cluster with
    room; then, while one has under least, the smallest (the first of equals) takes the member that
    loses least (ties by id, then by its cluster) from one with more than least. A family whose
    clusters cannot be brought within the bounds is an error.

    Which cluster gives (or takes) at each step follows from the sizes alone, so all steps up to the
    next one that fills (or empties) a cluster are made at once: a round a closed cluster, for all
    families together. Of sizes only a row a cluster is joined.
    """
    now = cut(members.select("family", "id", F.col("cluster").cast("long").alias("cluster"), "sims"), shuffled=True)
    for step in (shrink, grow):
        while True:
            moves = step(now, least, most)
            if moves is None:
                break
            moves = cut(moves, shuffled=True)
            moved = now.join(moves, ["family", "id"], "left").select("family", "id", F.coalesce("to", "cluster").alias("cluster"), "sims")
            old, now = now, cut(moved, shuffled=True)
            release(old, moves)
    return now.select("family", "id", "cluster")


def cluster_sizes(now: DataFrame) -> DataFrame:
    """family, cluster, n of all clusters of every family, empty ones too."""
    width = now.groupBy("family").agg(F.max(F.size("sims")).alias("k"))
    names = width.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("cluster"))
    counted = now.groupBy("family", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, ["family", "cluster"], "left").select("family", "cluster", F.coalesce("n", F.lit(0)).alias("n"))


def checked(sizes: DataFrame, wants: Column, can: Column) -> Row:
    """some: a cluster is outside its bounds; stuck: one in whose family none can help; biggest: the size of the largest."""
    families = sizes.groupBy("family").agg(F.bool_or(wants).alias("wants"), F.bool_or(can).alias("can"), F.max("n").alias("n"))
    return families.agg(F.bool_or("wants").alias("some"), F.bool_or(F.col("wants") & ~F.col("can")).alias("stuck"), F.max("n").alias("biggest")).first()


def shrink(now: DataFrame, least: int, most: int) -> DataFrame | None:
    """family, id, to: the moves out of clusters with over most members, up to the first that fills a cluster; None: there are none."""
    sizes = cut(cluster_sizes(now), shuffled=True)
    over = sizes.where(F.col("n") > most)
    state = checked(sizes, F.col("n") > most, F.col("n") < most)
    if not state["some"]:
        release(sizes)
        return None
    room = sizes.groupBy("family").agg(F.array_sort(F.collect_list(F.when(F.col("n") < most, F.col("cluster")))).alias("open"))
    if state["stuck"]:
        raise ValueError(f"clusters of over {most} members, and none with room")
    rows = now.join(over, ["family", "cluster"]).join(room, "family")
    loss = lambda d: F.round(F.get("sims", F.col("cluster").cast("int")) - F.get("sims", d.cast("int")), 9)
    rows = rows.select("family", "id", "cluster", "n", F.array_min(F.transform("open", lambda d: F.struct(loss(d).alias("loss"), d.alias("to")))).alias("best")).select("family", "id", "cluster", "n", "best.*")
    rows = ranked_in_parts(rows, ["family", "cluster"], loss_part(F.col("loss")), [F.col("loss"), F.col("id"), F.col("to")], "k")
    moves = cut(rows.where(F.col("k") <= F.col("n") - most).withColumn("size", F.col("n") - F.col("k") + 1).select("family", "id", "cluster", "to", "size"), shuffled=True)
    # the cluster that gives is the largest, the first of equals
    turn = F.struct((-F.col("size")).alias("a"), F.col("cluster").alias("b"))
    room_of = sizes.select("family", F.col("cluster").alias("to"), (F.lit(most) - F.col("n")).alias("room"))
    arrivals = ranked_in_parts(moves.join(room_of, ["family", "to"]), ["family", "to"], -F.floor(F.col("size") / max(1.0, state["biggest"] / PARTS)), [turn], "at")
    last = arrivals.where("at = room").groupBy("family").agg(F.min(turn).alias("last"))
    return moves.join(last, "family", "left").where(F.col("last").isNull() | (turn <= F.col("last"))).select("family", "id", "to")


def grow(now: DataFrame, least: int, most: int) -> DataFrame | None:
    """family, id, to: the moves into clusters with under least members, up to the first that empties a donor or takes a member twice."""
    sizes = cut(cluster_sizes(now), shuffled=True)
    under = sizes.where(F.col("n") < least).select("family", F.col("cluster").alias("to"), F.col("n").alias("have"))
    state = checked(sizes, F.col("n") < least, F.col("n") > least)
    if not state["some"]:
        release(sizes)
        return None
    donors = sizes.where(F.col("n") > least)
    if state["stuck"]:
        raise ValueError(f"clusters of under {least} members, and none that can give")
    need = under.groupBy("family").agg(F.collect_list(F.struct("to", "have")).alias("wants"))
    rows = now.join(donors, ["family", "cluster"]).join(need, "family")
    rows = rows.select("family", "id", "cluster", "n", "sims", F.inline("wants"))
    loss = F.round(F.get("sims", F.col("cluster").cast("int")) - F.get("sims", F.col("to").cast("int")), 9)
    rows = ranked_in_parts(rows.withColumn("loss", loss).drop("sims"), ["family", "to"], loss_part(F.col("loss")), [F.col("loss"), F.col("id"), F.col("cluster")], "k")
    moves = rows.where(F.col("k") <= least - F.col("have")).withColumn("size", F.col("have") + F.col("k") - 1)
    moves = cut(moves.select("family", "id", "cluster", "n", "to", "size"), shuffled=True)
    # the cluster that takes is the smallest, the first of equals
    turn = F.struct(F.col("size").alias("a"), F.col("to").alias("b"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("family", *by).orderBy(turn))  # noqa: E731  at most least * clusters rows
    gives = moves.withColumns({"at": rank("cluster"), "again": rank("id")})
    last = gives.where(F.col("at") == F.col("n") - least).groupBy("family").agg(F.min(turn).alias("last"))
    twice = gives.where("again = 2").groupBy("family").agg(F.min(turn).alias("twice"))
    ok = (F.col("last").isNull() | (turn <= F.col("last"))) & (F.col("twice").isNull() | (turn < F.col("twice")))
    return moves.join(last, "family", "left").join(twice, "family", "left").where(ok).select("family", "id", "to")


def family_batches(df: DataFrame, family: str, key: str, vector: str, least: int, target: int, most: int, seed: str = "kmeans", starts: DataFrame | None = None) -> DataFrame:
    """family, id, cluster: batches of least to most members within each family (a family of at most ``most`` is one batch).

    Rows without a family or a vector are left out; a family that no number of batches fits is an error.
    """
    counted = df.where(F.col(family).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    kind = counted.schema["family"].dataType.simpleString()
    sizes = [(r["family"], r["n"], batch_clusters(r["n"], least, target, most)) for r in counted.where(F.col("n") > most).toLocalIterator()]
    whole = df.join(counted.where(F.col("n") <= most), F.col(family) == F.col("family")).where(F.col(vector).isNotNull())
    whole = whole.select("family", F.col(key).alias("id"), F.lit(0).cast("long").alias("cluster"))
    if not sizes:
        return whole
    counts = df.sparkSession.createDataFrame(sizes, f"family {kind}, n long, k long")
    large = df.join(F.broadcast(counts.select(F.col("family").alias(family))), family, "left_semi")
    members, _ = family_kmeans(large, family, key, vector, counts, seed, starts=starts)
    return rebalance(members, least, most).unionAll(whole)


def batch_coherence(batches: DataFrame, df: DataFrame, key: str, vector: str) -> DataFrame:
    """family, cluster, n, mean_cos, p10_cos and min_cos of members to the unit centroid of their batch; a zero vector's cosine is 0."""
    rows = unit(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null"))
    rows = cut(batches.join(rows, "id").select("family", "cluster", "id", "vector"), shuffled=True)
    long = rows.select("family", "cluster", F.posexplode("vector").alias("d", "x")).groupBy("family", "cluster", "d").agg(F.sum("x").alias("c"))
    centre = long.groupBy("family", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    norm = F.sqrt(dot("c", "c"))
    cos = F.when(norm == 0, 0.0).otherwise(dot("vector", "c") / norm)
    scored = rows.join(centre, ["family", "cluster"]).select("family", "cluster", F.round(cos, 9).alias("cos"))
    return scored.groupBy("family", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("mean_cos"), F.percentile("cos", 0.1).alias("p10_cos"), F.min("cos").alias("min_cos"))
