"""Connected components of a table of edges, whatever the type of the node keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, release

#: Edges of a task that turns them into stars, about; it does not hold more than twice as many.
EDGES = 1 << 19


def stars(u: pa.Array, v: pa.Array) -> pa.RecordBatch:
    """u, v: edges with the same components, a star around the smallest node of each."""
    nodes = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(nodes.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[nodes.indices.to_numpy()]
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(order))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    names, move = nodes.dictionary.take(pa.array(order)), np.flatnonzero(root != np.arange(len(order)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(move)), names.take(pa.array(root[move]))], ["u", "v"])


def contracted(edges: DataFrame) -> DataFrame:
    """u, v: edges with the same components, for every block of an Arrow task's edges a star around its smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 2 * EDGES:
                yield stars(*(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1)))
                held, n = [], 0
        if n:
            yield stars(*(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1)))

    kind = edges.schema["u"].dataType.simpleString()
    return cut(map_arrow(edges.select("u", "v"), run, f"u {kind}, v {kind}"))


def classes(edges: DataFrame) -> DataFrame:
    """key, label: the smallest key of each node's component (nodes without a link are left out); edges: two columns of keys.

    Tasks of about EDGES edges turn theirs into stars. Those of a single task are the classes, and
    so are those of several if they fit together. Otherwise a large-star and a small-star step join
    them, and so on.
    """
    a, b = edges.columns
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), shuffled=True)
    while True:
        tasks = max(1, -(-edges.count() // EDGES))
        old, edges = edges, contracted(edges.coalesce(tasks))
        release(old)
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if tasks == 1 or ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty():
            return edges.select(F.col("u").alias("key"), F.col("v").alias("label"))
        both = edges.unionAll(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old = edges
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))), shuffled=True)
        release(old)
