"""Bloom filters of 64-bit hashes, of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textvec import U64, mix

#: Most bits of a filter, as a power of two: 16 MB.
FILTER_BITS = 27


def bits_of(h: np.ndarray, size: int) -> np.ndarray:
    """Four bits of a table of size bits (a power of two) for each hash, a row a bit."""
    x = mix(h.view(U64))
    return np.stack([(x >> U64(s)) * U64(0x9E3779B97F4A7C15) >> U64(64 - size.bit_length() + 1) for s in (0, 11, 23, 37)]).astype(np.int64)


def filter_of(hashes: DataFrame) -> Broadcast:
    """A broadcast filter of one long column: about 10 bits a row, at most FILTER_BITS in all whatever the number of rows."""
    size = 1 << min(FILTER_BITS, max(16, (10 * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size // 64, U64)
        for b in batches:
            at = bits_of(b.column(0).to_numpy(), size).ravel()
            np.bitwise_or.at(table, at >> 6, U64(1) << (at & 63).astype(U64))
        at = np.flatnonzero(table)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].view(np.int64))], ["at", "bits"])

    rows = map_arrow(hashes.select(hashes.columns[0]), run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table.view(U64))


def maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; True for all that are."""
    at = bits_of(h, 64 * len(table))
    return ((table[at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(bool).all(axis=0)
