"""Line dedup: documents probe a sharded minimal perfect hash of frequent lines.

1. A map emits (line hash, document) for every distinct key of a document that is long enough.
2. An aggregation with map-side combine counts the documents of each hash and keeps the largest
   doc_id. Hashes below ``min_docs`` documents can never lose a line and are not indexed.
3. The remaining hashes are dealt to shards of about ``shard_keys`` keys. Each shard builds a
   minimal perfect hash (levels of bit arrays: a key that is alone in its slot rests there, the
   others go on to the next level; the rank of the set bit is the key's index) and arrays by
   index: 64-bit fingerprint, document count, largest doc_id.
4. Documents probe the arrays in a map; no line is joined and no text is shuffled.

The arrays are broadcast if they hold at most ``broadcast_keys`` keys (24 bytes each, checked
by a count). Beyond that, each shard's probes are routed to the shard's arrays by shard number,
as (hash, document, line) without texts, and only line numbers to drop return to the documents.
Fingerprints are independent of the index hash, so a line outside the index is taken for one
inside with a probability below 2**-64.

Keys: a line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Edge cases: a null or empty
text is one empty line; repeated document rows count as documents of their own, and with equal
doc_id all of them hold the largest; a null doc_id is smaller than any other; extra columns are
left out (op5) or kept (pipeline stage).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .textvec import U64, mix

BLANK = b" \t\n\v\f\r"
NO_DOC = -(1 << 63)
#: Documents holding a shard's lines for each of its tasks, where probes are routed.
TASK_PROBES = 1 << 18


def key_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """Two 64-bit hashes of a line's key, or None if the key is too short."""
    key = line.strip(BLANK)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    x = xxhash.xxh3_128_intdigest(key.lower())  # bytes.lower() is ASCII only
    return x >> 64, x & 0xFFFFFFFFFFFFFFFF


class PerfectHash:
    """A minimal perfect hash of distinct uint64 keys: index(keys) is 0..n-1, any value for others."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.5) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, level, base = keys, 0, 0
        while len(left):
            size = max(64, int(gamma * len(left)) + 63 & ~63)
            slot = self.slots(left, level, size)
            alone = np.bincount(slot, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base
            self.levels.append((size, np.packbits(alone, bitorder="little"), rank[::64].astype(np.int64) - alone[::64]))
            base += int(alone.sum())
            left, level = left[~alone[slot]], level + 1
        self.n = base

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level holds it."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            if not len(left):
                break
            slot = self.slots(keys[left], level, size)
            there = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            s = slot[there]
            # bits of the slot's word of 64 up to the slot itself
            word = bits.view("<u8")[s >> 6] if len(bits) % 8 == 0 else np.zeros(0, U64)
            below = word & (~U64(0) >> (U64(63) - (s & 63).astype(U64)))
            out[left[there]] = rank[s >> 6] + np.bitwise_count(below)
            left = left[~there]
        return out


class Shard:
    """The perfect hash of a shard and its arrays by index; a key whose index hash another has too is kept beside them."""

    def __init__(self, h: np.ndarray, check: np.ndarray, n_docs: np.ndarray, last: np.ndarray) -> None:
        _, first = np.unique(h, return_index=True)
        others = np.setdiff1d(np.arange(len(h)), first)
        self.twins = {(int(h[i]), int(check[i])): int(last[i]) for i in others}
        h, check, n_docs, last = h[first], check[first], n_docs[first], last[first]
        self.mph = PerfectHash(h)
        order = self.mph.index(h)
        self.check, self.n_docs, self.last = np.empty_like(check), np.empty(len(h), np.uint32), np.empty_like(last)
        self.check[order], self.n_docs[order], self.last[order] = check, np.minimum(n_docs, 0xFFFFFFFF), last

    def probe(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the shard, and the largest doc_id holding it."""
        if not len(self.check):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = self.mph.index(h)
        there, last = (at >= 0) & (self.check[at] == check), self.last[at]
        if self.twins:
            for i in np.flatnonzero(~there):
                twin = self.twins.get((int(h[i]), int(check[i])))
                if twin is not None:
                    there[i], last[i] = True, twin
        return there, last


def shard_of(h: np.ndarray, n_shards: int) -> np.ndarray:
    return ((h >> U64(32)) % U64(n_shards)).astype(np.int64)


def frequent_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h, check, n_docs, last of the keys that at least min_docs documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs: list[tuple[int, int]] = []
            counts = []
            for text in b.column(1):
                t = text.as_py()
                own = {x for x in (key_hash(line, min_chars) for line in t.encode("utf-8", "surrogatepass").split(b"\n")) if x} if t else ()
                pairs.extend(own)
                counts.append(len(own))
            if pairs:
                hashes = np.array(pairs, U64).view(np.int64)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), ids], ["h", "check", "doc_id"])

    found = map_arrow(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"), "text"), run, "h long, check long, doc_id long")
    return found.groupBy("h", "check").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)


def build_shards(lines: DataFrame, n_shards: int) -> list[Shard]:
    """The shards' arrays; only called below the bound on broadcast keys."""
    rows = lines.toArrow()
    h, check = (rows.column(c).to_numpy().view(U64) for c in ("h", "check"))
    n_docs, last = rows.column("n_docs").to_numpy(), rows.column("last").to_numpy()
    shard = shard_of(h, n_shards)
    return [Shard(h[m], check[m], n_docs[m], last[m]) for m in (shard == k for k in range(n_shards))]


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def drops_of(lines: list[bytes], doc_id: int, shards: list[Shard], min_chars: int) -> list[int]:
    """Numbers of the lines that the document loses."""
    found = [(n, x) for n, x in ((n, key_hash(line, min_chars)) for n, line in enumerate(lines)) if x]
    if not found:
        return []
    keys = np.array([x for _, x in found], U64)
    shard = shard_of(keys[:, 0], len(shards))
    out: list[int] = []
    for k in np.unique(shard):
        own = np.flatnonzero(shard == k)
        there, last = shards[k].probe(keys[own, 0], keys[own, 1])
        out.extend(found[i][0] for i in own[there & (last != doc_id)])
    return sorted(out)


def cleaned(docs: DataFrame, out, schema, min_chars: int, min_docs: int, shard_keys: int, broadcast_keys: int) -> DataFrame:
    """docs through out(batch, lines by row, dropped line numbers by row)."""
    lines = cut(frequent_lines(docs, min_chars, min_docs))
    n_keys = lines.count()
    n_shards = max(1, -(-n_keys // shard_keys))
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    if n_keys <= broadcast_keys:
        shared = docs.sparkSession.sparkContext.broadcast(build_shards(lines, n_shards))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column(id_at).to_pylist(), b.column(text_at).to_pylist()
                split = [split_lines(t) for t in texts]
                yield out(b, split, [drops_of(s, NO_DOC if i is None else i, shared.value, min_chars) for i, s in zip(ids, split)])

        return map_arrow(docs, run, schema)
    drops = routed_drops(docs, lines, n_shards, min_chars, TASK_PROBES)
    joined = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))).join(drops, "__id", "left").select(*docs.columns, "__drop")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_lines(t) for t in b.column(text_at).to_pylist()]
            lost = [{(x["h"], x["check"]) for x in d or ()} for d in b.column(b.num_columns - 1).to_pylist()]
            # a routed drop is a key's two hashes, so that equal doc_ids with different texts stay apart
            yield out(b, split, [[n for n, x in ((n, key_hash(line, min_chars)) for n, line in enumerate(s)) if x and (_signed(x[0]), _signed(x[1])) in d] if d else [] for s, d in zip(split, lost)])

    return map_arrow(joined, apply, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def routed_drops(docs: DataFrame, lines: DataFrame, n_shards: int, min_chars: int, task_probes: int) -> DataFrame:
    """__id, __drop: hashes of the lines that each document loses, found by the shards' owners.

    A probe goes to the partition of its shard, salted so that one frequent line does not land
    in one task: a shard has a salt for every task_probes documents that hold its lines. Each
    salt's task builds the shard's arrays from the same rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(_signed(x[0]), _signed(x[1]), i) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in (key_hash(line, min_chars) for line in split_lines(t)) if x}
            h, check, ids = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(check, pa.int64()), pa.array(ids, pa.int64())], ["h", "check", "id"])

    shard = F.pmod(F.shiftrightunsigned("h", 32), F.lit(n_shards)).alias("shard")
    lines = lines.select(shard, "h", "check", "n_docs", "last")
    # a row a shard, that is, one for about shard_keys lines
    salts = F.broadcast(lines.groupBy("shard").agg(F.ceil(F.sum("n_docs") / task_probes).cast("long").alias("salts")))
    probes = map_arrow(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("id"), "text"), emit, "h long, check long, id long")
    # a shard without a frequent line has no salts: none of its probes can succeed
    probes = probes.select(shard, "h", "check", "id").join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).groupBy("shard", "salt")
    owners = lines.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "h", "check", "n_docs", "last").groupBy("shard", "salt")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        h, check, n_docs, last = (right.column(n).to_numpy() for n in ("h", "check", "n_docs", "last"))
        own = Shard(h.view(U64), check.view(U64), n_docs, last)
        probed, checks, ids = (left.column(n).to_numpy() for n in ("h", "check", "id"))
        there, last = own.probe(probed.view(U64), checks.view(U64))
        lost = there & (last != ids)
        return pa.table({"__id": ids[lost], "h": probed[lost], "check": checks[lost]})

    lost = probes.cogroup(owners).applyInArrow(probe, "__id long, h long, check long")
    return lost.groupBy("__id").agg(F.collect_set(F.struct("h", "check")).alias("__drop"))


def dedup_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1 << 16, broadcast_keys: int = 1 << 21) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs."""

    def out(b: pa.RecordBatch, split: list[list[bytes]], drops: list[list[int]]) -> pa.RecordBatch:
        sha = []
        for s, d in zip(split, drops):
            lost = set(d)
            sha.append(hashlib.sha256(b"\n".join(x for n, x in enumerate(s) if n not in lost)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in split], pa.int64()), pa.array([len(d) for d in drops], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return cleaned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), out, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", min_chars, min_docs, shard_keys, broadcast_keys)


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1 << 16, broadcast_keys: int = 1 << 21) -> DataFrame:
    """docs with cleaned texts (n_chars is updated where there is such a column); null texts stay null."""
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names, width = docs.columns, len(docs.columns)

    def out(b: pa.RecordBatch, split: list[list[bytes]], drops: list[list[int]]) -> pa.RecordBatch:
        columns = list(b.columns)[:width]
        texts, chars = columns[text_at].to_pylist(), columns[chars_at].to_pylist() if chars_at is not None else None
        for i, d in enumerate(drops):
            if d:
                lost = set(d)
                texts[i] = b"\n".join(x for n, x in enumerate(split[i]) if n not in lost).decode("utf-8", "surrogatepass")
                if chars is not None:
                    chars[i] = len(texts[i])
        columns[text_at] = pa.array(texts, pa.string())
        if chars is not None:
            columns[chars_at] = pa.array(chars, columns[chars_at].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return cleaned(docs, out, docs.schema, min_chars, min_docs, shard_keys, broadcast_keys)
