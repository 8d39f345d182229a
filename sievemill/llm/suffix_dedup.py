"""Suffix-array dedup: remove every byte of a string of LENGTH bytes that starts anywhere else too.

A suffix array over all positions would be many times the corpus. It is made sparse: every string
of LENGTH bytes chooses an anchor, the start of its K-byte gram with the smallest hash, which
depends on the string alone. Equal strings have equal anchor grams at equal offsets, so only
suffixes at anchors (about one in a hundred bytes) are sorted, and only those whose gram occurs
twice or more. Neighbouring strings with one anchor are a run; its text has at most
SPAN - 1 + LENGTH bytes.

1. A scan counts the anchor grams. Grams that occur once are done with.
2. A scan lists the runs of the other grams. Runs with equal text (128 bits of hash) repeat as a
   whole. Texts of the distinct runs of grams that have several are fetched, one for each text.
3. Within a gram, the suffixes that start at the anchors are sorted, and so are the reversed texts
   before them: a mergesort that compares two suffixes by their longest common extension, found by
   binary search on polynomial prefix hashes, in a logarithmic number of steps. The extensions of
   sorted neighbours are verified byte by byte (a batch with a hash collision is sorted again by
   its bytes). A string at offset o before the anchor repeats if another run shares LENGTH - o
   bytes of the suffix and o bytes before it, that is, if both are in one class of each order.
4. Documents cut the covered bytes and hash the rest.

A gram with more than ``group_runs`` distinct runs is not sorted in one task: its strings are
counted by 128-bit hashes in an aggregation with map-side combine. Lists of grams, positions and
spans are broadcast while they take at most ``broadcast_bytes`` (checked by counts; they are flat
arrays of eight-byte numbers); beyond, they are joined. A hot gram is only ever counted or joined
by adaptive sort-merge joins.

Edge cases: null and empty texts, and those shorter than LENGTH, keep all their bytes; a
repeated row is a document of its own, and repeats itself; a null doc_id is kept; extra columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, release
from .textvec import U64, buffers, chunks, mix, powers, prefix, span_hash

LENGTH, K = 400, 200
SPAN = LENGTH - K + 1  # grams of a string
NO_DOC = -(1 << 63)
POS_BITS = 24


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: block-wise minima from both sides."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of a chunk: document, anchor, first and last string start (in the chunk), gram, run hash."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    h = prefix(data)
    _, down = powers(len(h))
    gram = mix((h[K:] - h[:-K]) * down[: len(h) - K])
    key = (gram >> U64(POS_BITS) << U64(POS_BITS)) | np.arange(len(gram)).astype(U64)
    at = (sliding_min(key, SPAN) & U64((1 << POS_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + LENGTH <= offsets[1:][doc])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    at, doc = at[inside], doc[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = inside[first], inside[np.append(first[1:], len(at)) - 1]
    p, d = at[first], doc[first]
    run = mix(span_hash(h, lo, hi + LENGTH) + mix((p - lo).astype(U64) * U64(1 << 20) + (hi - lo).astype(U64)))
    return d, p, lo, hi, gram[p], run


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, start of the piece in it, bytes, offsets): chunks, and long documents in overlapping parts."""
    for i, _, x, o in chunks(data, offsets, limit):
        if len(x) <= 2 * limit:
            yield i, 0, x, o
        else:
            for s in range(0, len(x) - LENGTH + 1, limit):
                part = x[s : s + limit + LENGTH - 1]
                yield i, s, part, np.array([0, len(part)])


def text_id(text: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(text.tobytes())


def ids_of(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and a hash of the text: together they name a document."""
    doc = column.fill_null(NO_DOC).to_numpy(zero_copy_only=False)
    return doc, np.array([text_id(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], U64).view(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x)


def repeated_grams(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, x, o in pieces(*buffers(b.column(1))):
                g, n = np.unique(anchor_runs(x, o)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(g), pa.array(n)], ["gram", "n"])

    return map_arrow(docs, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def candidate_runs(docs: DataFrame, grams: DataFrame, broadcast_bytes: int) -> DataFrame:
    """doc, t, gram, run, at (anchor in the run), lo, hi of the runs whose gram is in grams."""
    small = 8 * grams.count() <= broadcast_bytes
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(grams.toArrow().column("gram").to_numpy()) if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            doc, t = ids_of(b.column(0), data, offsets)
            for i, s, x, o in pieces(data, offsets):
                d, p, lo, hi, g, r = anchor_runs(x, o)
                g, r = g.view(np.int64), r.view(np.int64)
                if small:
                    known = shared.value
                    keep = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g) if len(known) else np.zeros(0, np.int64)
                    d, p, lo, hi, g, r = (y[keep] for y in (d, p, lo, hi, g, r))
                base = o[d] - s
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (doc[d + i], t[d + i], g, r, p - lo, lo - base, hi - base)], ["doc", "t", "gram", "run", "at", "lo", "hi"])

    found = map_arrow(docs, run, "doc long, t long, gram long, run long, at long, lo long, hi long")
    return found if small else found.join(grams, "gram", "left_semi")


def pair_key(doc: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix(t.view(U64) + mix(doc.view(U64)))


def with_lists(docs: DataFrame, lists: DataFrame, columns: list[str], broadcast_bytes: int, use, schema: str) -> DataFrame:
    """use(batch, data, offsets, per-row arrays of columns or None) over docs; lists: doc, t and columns, a row an entry."""
    small = 8 * (3 + len(columns)) * lists.count() <= broadcast_bytes
    if small:
        rows = lists.select("doc", "t", *columns).toArrow()
        doc, t = (rows.column(c).to_numpy() for c in ("doc", "t"))
        key = pair_key(doc, t)
        order = np.lexsort((t, doc, key))
        doc, t, key = doc[order], t[order], key[order]
        differ = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
        # two documents under one key are as good as impossible, but then the lists are joined
        small = not (differ & (key[1:] == key[:-1])).any()
    if small:
        new = np.flatnonzero(np.append(True, differ)) if len(doc) else np.zeros(0, np.int64)
        shared = docs.sparkSession.sparkContext.broadcast((key[new], doc[new], t[new], np.append(new, len(doc)), [rows.column(c).to_numpy()[order] for c in columns]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, docs_of, ts, ends, values = shared.value
            for b in batches:
                data, offsets = buffers(b.column(1))
                doc, t = ids_of(b.column(0), data, offsets)
                at = np.minimum(np.searchsorted(keys, pair_key(doc, t)), max(0, len(keys) - 1))
                there = (docs_of[at] == doc) & (ts[at] == t) if len(keys) else np.zeros(len(doc), bool)
                yield from use(b, data, offsets, [[v[ends[n] : ends[n + 1]] for v in values] if ok else None for n, ok in zip(at.tolist(), there.tolist())])

        return map_arrow(docs, run, schema)
    grouped = lists.groupBy("doc", "t").agg(F.collect_list(F.struct(*columns)).alias("entries"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, t = ids_of(b.column(0), *buffers(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(doc), pa.array(t)], ["doc_id", "text", "doc", "t"])

    joined = map_arrow(docs, name, "doc_id long, text binary, doc long, t long").join(grouped, ["doc", "t"], "left").select("doc_id", "text", "entries")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entries = b.column(2).to_pylist()
            yield from use(b, *buffers(b.column(1)), [None if e is None else [np.array([x[c] for x in e]) for c in columns] for e in entries])

    return map_arrow(joined, apply, schema)


class Suffixes:
    """Byte strings a[i:i + n] of one buffer, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> None:
        self.data, self.start, self.size, self.group = data, start, size, group
        self.h = prefix(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extensions by binary search."""
        a, b = self.start[i], self.start[j]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = span_hash(self.h, a, a + mid) == span_hash(self.h, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix i sorts before suffix j (equal: or is its equal); a prefix is before what it begins."""
        n = self.common(i, j)
        end_i, end_j = n == self.size[i], n == self.size[j]
        last = len(self.data) - 1
        less = self.data[np.minimum(self.start[i] + n, last)] < self.data[np.minimum(self.start[j] + n, last)]
        return np.where(end_i, np.where(end_j, equal, True), np.where(end_j, False, less))

    def order(self) -> np.ndarray:
        """Order of the suffixes within each group (groups are contiguous): bottom-up mergesort."""
        n = len(self.start)
        new = np.append(True, self.group[1:] != self.group[:-1]) if n else np.zeros(0, bool)
        first = np.flatnonzero(new)
        begin = np.repeat(first, np.diff(np.append(first, n)))
        end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n))) if n else begin
        rel, out, width = np.arange(n) - begin, np.arange(n), 1
        while n and (end - begin).max() > width:
            live = np.flatnonzero(end - begin > width)
            block = rel[live] // width
            other = begin[live] + (block ^ 1) * width
            lo, hi = np.minimum(other, end[live]), np.minimum(other + width, end[live])
            low, odd = lo.copy(), block & 1 == 1
            # rank in the sibling block: those before it, and for the right block also its equals
            while (lo < hi).any():
                go = lo < hi
                mid = np.where(go, (lo + hi) >> 1, lo)
                mid = np.minimum(mid, n - 1)
                mine, theirs = out[live], out[mid]
                smaller = np.where(odd, self.before(theirs, mine, True), self.before(theirs, mine, False))
                lo = np.where(go & smaller, mid + 1, lo)
                hi = np.where(go & ~smaller, mid, hi)
            place = begin[live] + (block // 2) * 2 * width + (rel[live] - block * width) + (lo - low)
            merged = out.copy()
            merged[place] = out[live]
            out, width = merged, 2 * width
        return out

    def sorted_with_extensions(self) -> tuple[np.ndarray, np.ndarray]:
        """The order and each suffix's common extension with the one before it in its group (else -1)."""
        order = self.order()
        ext = np.full(len(order), -1, np.int64)
        near = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1 if len(order) else order
        i, j = order[near - 1], order[near]
        ext[near] = self.common(i, j)
        if not self.verified(i, j, ext[near]):
            order = np.array(sorted(range(len(order)), key=lambda k: (self.group[k], self.data[self.start[k] : self.start[k] + self.size[k]].tobytes())))
            for m in near:
                a, b = (self.data[self.start[k] : self.start[k] + self.size[k]] for k in (order[m - 1], order[m]))
                short = min(len(a), len(b))
                differ = np.flatnonzero(a[:short] != b[:short])
                ext[m] = differ[0] if len(differ) else short
        return order, ext

    def verified(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> bool:
        """Whether the extensions hold byte by byte."""
        step = 4096
        for k in range(0, len(i), step):
            size = n[k : k + step]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            if (self.data[np.repeat(self.start[i[k : k + step]], size) + within] != self.data[np.repeat(self.start[j[k : k + step]], size) + within]).any():
                return False
        return True


def repeated_strings(texts: list[bytes], at: np.ndarray, times: np.ndarray, group: np.ndarray) -> list[list[int]]:
    """Per run, starts (first of run = 0) of the strings that another run of the group has too, or the run itself times over.

    texts: run texts; at: anchor in the run; times: occurrences of the whole run; group: sorted ids.
    """
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    right = Suffixes(data, start + at, size - at, group)
    back = data[::-1]
    left = Suffixes(back, len(data) - start - at, at, group)
    n = len(texts)
    (ro, rx), (lo, lx) = right.sorted_with_extensions(), left.sorted_with_extensions()
    last = size - LENGTH  # last string start
    out: list[list[int]] = [[] for _ in range(n)]
    for o in range(int(at.max(initial=-1)) + 1):
        rows = np.flatnonzero((o <= at) & (at - o <= last))
        if not len(rows):
            continue
        by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
        by_right[ro] = np.cumsum(rx < LENGTH - o)
        by_left[lo] = np.cumsum(lx < o)
        _, inverse = np.unique(by_right[rows] * (n + 1) + by_left[rows], return_inverse=True)
        total = np.bincount(inverse, np.minimum(times[rows], 2))
        for r in rows[total[inverse] >= 2]:
            out[r].append(int(at[r] - o))
    return out


def to_ranges(starts: list[int]) -> list[tuple[int, int]]:
    x = np.sort(np.array(starts, np.int64))
    cuts = np.flatnonzero(np.diff(x) != 1) + 1
    return [(int(y[0]), int(y[-1])) for y in np.split(x, cuts)]


def resolved(runs: DataFrame, group_runs: int) -> DataFrame:
    """gram, run, first, last: ranges of repeated string starts within a run.

    runs: gram, run, times, at, text, n_runs (distinct runs of the gram).
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        gram = np.array([r[0] for r in rows])
        found = repeated_strings([r[4] for r in rows], np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), gram)
        out = [(r[0], r[1], *x) for r, f in zip(rows, found) if f for x in to_ranges(f)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["gram", "run", "first", "last"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held.extend(zip(*(c.to_pylist() for c in b.columns)))
            if len(held) >= 4096:
                # whole grams only: the last one may go on
                end = len(held)
                while end and held[end - 1][0] == held[-1][0]:
                    end -= 1
                if end:
                    yield flush(held[:end])
                    held = held[end:]
        if held:
            yield flush(held)

    few = runs.where(F.col("n_runs") <= group_runs).select("gram", "run", "times", "at", "text")
    done = map_arrow(few.repartition("gram").sortWithinPartitions("gram"), sort, "gram long, run long, first long, last long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, run, times, _, text in zip(*(c.to_pylist() for c in b.columns)):
                n = len(text) - LENGTH + 1
                keys = [hashlib.md5(text[i : i + LENGTH]).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([gram] * n), pa.array([run] * n), pa.array([min(times, 2)] * n), pa.array(range(n), pa.int64()), pa.array(keys, pa.binary())], ["gram", "run", "times", "start", "key"])

    many = map_arrow(runs.where(F.col("n_runs") > group_runs).select("gram", "run", "times", "at", "text"), strings, "gram long, run long, times long, start long, key binary")
    twice = many.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1")
    return done.unionAll(many.join(twice, "key", "left_semi").select("gram", "run", F.col("start").alias("first"), F.col("start").alias("last")))


def repeated_spans(docs: DataFrame, group_runs: int, broadcast_bytes: int) -> DataFrame:
    """doc, t, begin, end: spans of bytes to remove, merged where they touch."""
    grams = cut(repeated_grams(docs))
    runs = cut(candidate_runs(docs, grams, broadcast_bytes))
    texts = runs.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "t", "at", "lo", "hi")).alias("one"))
    texts = cut(texts.select("gram", "run", "times", "one.*"))
    several = texts.groupBy("gram").agg(F.count(F.lit(1)).alias("n_runs"), F.min("times").alias("least")).where("n_runs > 1 and least = 1").select("gram", "n_runs")
    wanted = cut(texts.join(several, "gram"))

    def fetch(b, data, offsets, lists) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for n, entry in enumerate(lists):
            if entry is not None:
                own = data[offsets[n] : offsets[n + 1]]
                for gram, run, times, at, lo, hi, n_runs in zip(*(e.tolist() for e in entry)):
                    out.append((gram, run, times, at, own[lo : hi + LENGTH].tobytes(), n_runs))
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["gram", "run", "times", "at", "text", "n_runs"])

    fetched = with_lists(docs, wanted, ["gram", "run", "times", "at", "lo", "hi", "n_runs"], broadcast_bytes, fetch, "gram long, run long, times long, at long, text binary, n_runs long")
    # a repeated row offers its text more than once
    fetched = fetched.dropDuplicates(["gram", "run"])
    part = resolved(fetched, group_runs)
    whole = runs.join(texts.where("times > 1").select("gram", "run"), ["gram", "run"], "left_semi").select("doc", "t", F.col("lo").alias("begin"), (F.col("hi") + LENGTH).alias("end"))
    rest = texts.where("times = 1").join(part, ["gram", "run"]).select("doc", "t", (F.col("lo") + F.col("first")).alias("begin"), (F.col("lo") + F.col("last") + LENGTH).alias("end"))
    # a repeated row lists its spans as often as it stands there
    out = cut(merged(whole.unionAll(rest).groupBy("doc", "t", "begin").agg(F.max("end").alias("end"))))
    release(grams, runs, texts, wanted)
    return out


def remove_repeats(docs: DataFrame, group_runs: int = 4096, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    spans = repeated_spans(docs, group_runs, broadcast_bytes)

    def out(b, data, offsets, lists) -> Iterator[pa.RecordBatch]:
        rows = []
        for n, entry in enumerate(lists):
            own = data[offsets[n] : offsets[n + 1]]
            lost = np.zeros(len(own) + 1, np.int32)
            if entry is not None:
                np.add.at(lost, entry[0], 1)
                np.add.at(lost, entry[1], -1)
            gone = np.cumsum(lost)[:-1] > 0
            begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(own), int(gone.sum()), begins, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_lists(docs, spans, ["begin", "end"], broadcast_bytes, out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def merged(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap as one; spans of a document meet in one task, they are bounded by its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int, int] | None = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[:2] == row[:2] and row[2] <= held[3]:
                    held = (*held[:3], max(held[3], row[3]))
                else:
                    if held:
                        out.append(held)
                    held = row
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["doc", "t", "begin", "end"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], ["doc", "t", "begin", "end"])

    return map_arrow(spans.select("doc", "t", "begin", "end").repartition("doc", "t").sortWithinPartitions("doc", "t", "begin"), run, "doc long, t long, begin long, end long")
