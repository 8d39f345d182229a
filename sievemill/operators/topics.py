r"""Topic families of texts: a bounded vocabulary, a distributed truncated SVD, bisection of the largest family.

No term of a text is a row of its own: words are counted in the tasks, only pairs of words that are
frequent enough for the vocabulary themselves are counted, and once its words are found a text is codes
in a piece of texts, which has its own list of words. The weighted term matrix stays a table of such blocks; what passes through the driver
is at most ``max_features`` by ``components`` numbers, whatever the number of texts, and the words
that can be in the vocabulary (of a checked number). The SVD finds the range of the matrix by
multiplying a random block with it and its transpose, in tasks, and making the block orthonormal in
between. The split of a family is two centres, so that the families of a text follow from its vector
and the list of splits, and nothing is written or joined for a split.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import cut, release, spread
from .clusters import nearest, normalised

#: Rows of a block, whose products are formed together.
CHUNK = 256
#: Words that tasks and the driver hold, at most; where more can be in the vocabulary, every term of a text is a row.
WORDS = 1 << 20
#: Rows of a block of vectors, about: there are few numbers to a row.
VECTORS = 4096
#: Entries of a dense chunk of the matrix for one that is not zero, and in all, at most; others are multiplied sparse.
DENSE, CELLS = 64, 1 << 23
#: Texts and words of a piece of coded texts, at most (but for a single text).
PIECE = 4096, 1 << 21
#: Pairs of words that a task holds before it passes on their counts.
PAIRS = 1 << 22


def accent_table() -> tuple[str, str]:
    """Latin letters that are a plain letter and marks, and those plain letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and c != d]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = accent_table()


def words_of(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words of two word characters or more, lower-cased, without accents and stop words."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), "[̀-ͯ]", "")
    words = F.regexp_extract_all(plain, F.lit(r"(?U)(\w{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def terms(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words of two word characters or more, lower-cased, without accents and stop words, then pairs of neighbours among them."""
    pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return F.element_at(F.transform(F.array(words_of(text, stop_words)), lambda w: F.concat(w, pairs(w))), 1)


def vocabulary(counts: DataFrame, n: int, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """term, j, idf of at most max_features terms, the most frequent ones (ties by term), numbered by term; counts: id, term, tf."""
    kept = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("times"))
    return most_frequent(kept, n, min_df, max_df, max_features)


def most_frequent(counted: DataFrame, n: int, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """The same of term, df, times."""
    kept = counted.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    first = kept.orderBy(F.desc("times"), "term").limit(max_features)
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1
    return first.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("j"), idf.alias("idf"))  # at most max_features rows


def term_matrix(counts: DataFrame, words: DataFrame) -> DataFrame:
    """id, row: array of (j, w), (1 + log tf) * idf of unit length; ids without a term of the vocabulary are left out."""
    rows = counts.join(F.broadcast(words), "term").select("id", "j", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    rows = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("row"))
    # the norm is formed once a row, not once for each of its terms
    scaled = lambda norm: F.transform("row", lambda x: F.struct(x["j"].alias("j"), (x["w"] / norm).alias("w")))
    return rows.select("id", let(F.sqrt(F.aggregate("row", F.lit(0.0), lambda t, x: t + x["w"] * x["w"])), scaled).alias("row"))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys)))


def coded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column of word lists; and of each word its place among them and its row."""
    found = column.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end row of pieces within PIECE."""
    ends, i = np.cumsum(lengths), 0
    while i < len(ends):
        end = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE[1], "right"))
        yield i, (i := min(max(end, i + 1), i + PIECE[0], len(ends)))


def coded_texts(rows: DataFrame) -> DataFrame:
    """ids, names, n, code, words, df, times of pieces of the rows; rows: id (each once), words.

    names: the ids as text, n: the words of each, code: the place of each word in ``words``, the distinct ones of the piece;
    df and times: in how many of its texts, and how often in all, each of those occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, end in pieces(b.column(2).value_lengths().to_numpy()):
                words, code, row = coded(b.column(2)[i:end])
                width = max(len(words), 1)
                held = runs(row * width + code)[0] % width
                counts = [pa.array(np.bincount(x, minlength=len(words))[: len(words)]) for x in (held, code)]
                n = np.bincount(row, minlength=end - i).astype(np.int64)
                out = block(b.column(0)[i:end], b.column(1)[i:end], n=n, code=code.astype(np.int32))
                for name, x in zip(("words", "df", "times"), (words, *counts)):
                    out = out.append_column(name, one_list(x))
                yield out

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("id").cast("string").alias("name"), "words").mapInArrow(run, f"ids array<{kind}>, names array<string>, n binary, code binary, words array<string>, df array<long>, times array<long>")


def word_counts(texts: DataFrame) -> DataFrame:
    """term, df, times of the words of all coded texts."""
    rows = texts.select(F.inline(F.arrays_zip("words", "df", "times")))
    return rows.groupBy(F.col("words").alias("term")).agg(F.sum("df").alias("df"), F.sum("times").alias("times"))


def least_times(counted: DataFrame, n: int, min_df: int, max_df: float, max_features: int) -> int:
    """How often a term must occur to be among the max_features most frequent: as often as the last of that many words. 0: there are fewer words."""
    first = counted.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("times")).limit(max_features)
    found = first.agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("times")).first()
    return found["times"] if found["n"] and found["n"] == max_features else 0


def one_list(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def block(ids: pa.Array, names: pa.Array, **arrays: np.ndarray) -> pa.RecordBatch:
    """One row: ids, their names, and arrays as bytes."""
    return pa.RecordBatch.from_arrays([one_list(ids), one_list(names), *[pa.array([x.tobytes()], pa.binary()) for x in arrays.values()]], ["ids", "names", *arrays])


def read(b: pa.RecordBatch, i: int, **kinds: type) -> list[np.ndarray]:
    """The named arrays of the block in row i."""
    return [np.frombuffer(b.column(name)[i].as_buffer(), kind) for name, kind in kinds.items()]


def recoded(b: pa.RecordBatch, i: int, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a piece of coded texts its place in ``words`` (others: -1) and its row."""
    n, code = read(b, i, n=np.int64, code=np.int32)
    place = pc.index_in(b.column("words")[i].values, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
    return place[code], np.repeat(np.arange(len(n)), n)


def neighbours(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The places of the words that are a pair with the next one."""
    return np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[1:] == row[:-1]))


def pair_counts(texts: DataFrame, words: pa.Array) -> DataFrame:
    """term, df, times of the pairs of neighbours among ``words``."""
    width = len(words)
    shared = texts.sparkSession.sparkContext.broadcast(words)
    ddl = "pair long, df long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, all_of, held = [], [], 0

        def counted() -> pa.RecordBatch:
            pairs, times = runs(np.concatenate(all_of))
            df = runs(np.concatenate(once))[1]
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(df), pa.array(times)], ["pair", "df", "times"])

        for b in batches:
            for i in range(len(b)):
                code, row = recoded(b, i, shared.value)
                at = neighbours(code, row)
                pairs = code[at] * width + code[at + 1]
                all_of.append(pairs)
                once.append(runs(row[at] * width**2 + pairs)[0] % width**2)
                held += len(pairs)
                if held >= PAIRS:
                    yield counted()
                    once, all_of, held = [], [], 0
        if held:
            yield counted()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = b.column(0).to_numpy()
            first, second = [shared.value.take(pa.array(x)) for x in (pairs // width, pairs % width)]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, second, " "), b.column(1), b.column(2)], ["term", "df", "times"])

    found = texts.select("n", "code", "words").mapInArrow(run, ddl).groupBy("pair").agg(F.sum("df").alias("df"), F.sum("times").alias("times"))
    return found.mapInArrow(named, "term string, df long, times long")


def matrix_blocks(texts: DataFrame, words: pa.Array, terms: pa.Table) -> DataFrame:
    """ids, names, n, j, w: the rows of term_matrix as blocks; n: entries a row. terms: term, j, idf, in the order of j."""
    width, named = len(terms), [x.split(" ") for x in terms["term"].to_pylist()]
    place = dict(zip(words.to_pylist(), range(len(words))))
    # the last entry is that of other words, whose code is -1
    alone, starts, ends = np.full(len(words) + 1, -1), np.zeros(len(words) + 1, bool), np.zeros(len(words) + 1, bool)
    pairs = []
    for j, x in enumerate(named):
        if len(x) == 1:
            alone[place[x[0]]] = j
        else:
            first, second = place[x[0]], place[x[1]]
            starts[first] = ends[second] = True
            pairs.append((first * len(words) + second, j))
    keys, of = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
    shared = texts.sparkSession.sparkContext.broadcast((words, alone, starts, ends, keys, of, terms["idf"].to_numpy()))
    size = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, alone, starts, ends, keys, of, idf = shared.value
        for b in batches:
            for i in range(len(b)):
                code, row = recoded(b, i, words)
                at = np.flatnonzero(alone[code] >= 0)
                entries = row[at] * width + alone[code[at]]
                if len(keys):
                    at = np.flatnonzero(starts[code[:-1]] & ends[code[1:]] & (row[1:] == row[:-1]))
                    pairs = code[at] * size + code[at + 1]
                    found = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    hit = keys[found] == pairs
                    entries = np.concatenate([entries, row[at[hit]] * width + of[found[hit]]])
                entries, tf = runs(entries)
                row, j = entries // width, entries % width
                w = (1 + np.log(tf)) * idf[j]
                ids, names = b.column("ids")[i].values, b.column("names")[i].values
                w /= np.sqrt(np.bincount(row, w * w, len(ids)))[row]
                n = np.bincount(row, minlength=len(ids)).astype(np.int64)
                held = np.flatnonzero(n)
                to = np.append(0, np.cumsum(n[held]))
                for k in range(0, len(held), CHUNK):
                    some = held[k : k + CHUNK]
                    s = slice(to[k], to[k + len(some)])
                    yield block(ids.take(pa.array(some)), names.take(pa.array(some)), n=n[some], j=j[s].astype(np.int32), w=w[s])

    ids = texts.schema["ids"].dataType.simpleString()
    return texts.select("ids", "names", "n", "code", "words").mapInArrow(run, f"ids {ids}, names array<string>, n binary, j binary, w binary")


def packed(matrix: DataFrame) -> DataFrame:
    """The rows of a term_matrix as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), CHUNK):
                rows = b.column(2)[i : i + CHUNK]
                flat = rows.flatten()
                yield block(b.column(0)[i : i + CHUNK], b.column(1)[i : i + CHUNK], n=rows.value_lengths().to_numpy().astype(np.int64), j=flat.field("j").to_numpy().astype(np.int32), w=flat.field("w").to_numpy())

    kind = matrix.schema["id"].dataType.simpleString()
    return matrix.select("id", F.col("id").cast("string").alias("name"), "row").mapInArrow(run, f"ids array<{kind}>, names array<string>, n binary, j binary, w binary")


class Chunk:
    """The rows of a block of the matrix: dense where they are full enough for that to be less work."""

    def __init__(self, n: np.ndarray, j: np.ndarray, w: np.ndarray, zeros: np.ndarray):
        """zeros: as many columns as the matrix and CHUNK rows, which the dense rows are written to; clear() makes them zero again."""
        self.rows, self.j, self.w = len(n), j, w
        self.row = np.repeat(np.arange(len(n)), n)
        self.dense = None
        if self.rows * zeros.shape[1] <= min(DENSE * len(w), CELLS):
            self.dense = zeros[: self.rows]
            self.dense[self.row, j] = w

    def clear(self) -> None:
        if self.dense is not None:
            self.dense[self.row, self.j] = 0

    def times(self, right: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ right
        out = np.zeros((self.rows, right.shape[1]))
        if len(self.row):
            at = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1]))
            out[self.row[at]] = np.add.reduceat(self.w[:, None] * right[self.j], at, axis=0)
        return out

    def add_transposed(self, right: np.ndarray, total: np.ndarray) -> None:
        """Adds the transposed rows times right."""
        if self.dense is not None:
            total += self.dense.T @ right
        elif len(self.j):
            order = np.argsort(self.j, kind="stable")
            js = self.j[order]
            at = np.flatnonzero(np.append(True, js[1:] != js[:-1]))
            total[js[at]] += np.add.reduceat(self.w[order, None] * right[self.row[order]], at, axis=0)


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, Chunk]]:
    zeros = np.zeros((CHUNK, width))
    for b in batches:
        for i in range(len(b)):
            yield b, i, (chunk := Chunk(*read(b, i, n=np.int64, j=np.int32, w=np.float64), zeros))
            chunk.clear()


def summed(blocks: DataFrame, part, width: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of what part(chunk, total) adds to a dense matrix; added up in tasks, then CHUNK rows of it in a place."""
    rows, columns = shape
    ddl = "at long, v binary"

    def out(at: int, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["at", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, _, chunk in chunks(batches, width):
            part(chunk, total)
        for k in range(0, rows, CHUNK):
            yield out(k, total[k : k + CHUNK])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                (v,) = read(b, i, v=np.float64)
                total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            yield out(k, v)

    found = blocks.select("n", "j", "w").mapInArrow(run, ddl).repartition("at").mapInArrow(merge, ddl).toArrow()
    total = np.zeros(shape)
    for k, v in zip(found["at"].to_pylist(), found["v"].to_pylist()):
        total[k : k + CHUNK] = np.frombuffer(v).reshape(-1, columns)
    return total


def truncated_svd(matrix: DataFrame, width: int, k: int, seed: int = 7, rounds: int = 7, extra: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values, and the right vectors (width x k; the largest entry of each is positive); matrix: id, row, or its blocks."""
    spark = matrix.sparkSession
    blocks = cut(packed(matrix)) if "row" in matrix.columns else matrix
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + extra))))[0]

    def gram(chunk: Chunk, total: np.ndarray) -> None:
        chunk.add_transposed(chunk.times(shared.value), total)

    def small(chunk: Chunk, total: np.ndarray) -> None:
        y = chunk.times(shared.value)
        total += y.T @ y

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(block)
        block = np.linalg.qr(summed(blocks, gram, width, block.shape))[0]
    shared = spark.sparkContext.broadcast(block)
    values, turn = np.linalg.eigh(summed(blocks, small, width, (block.shape[1], block.shape[1])))
    if blocks is not matrix:
        release(blocks)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = block @ turn[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return np.sqrt(np.maximum(values[order], 0)), vectors


def vector_blocks(blocks: DataFrame, vectors: np.ndarray) -> DataFrame:
    """ids, names, x: rows of the matrix in the space of the vectors, of unit length, in blocks of some VECTORS rows."""
    shared = blocks.sparkSession.sparkContext.broadcast(vectors)

    def joined(parts: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        ids, names, x = zip(*parts)
        return block(pa.concat_arrays(ids), pa.concat_arrays(names), x=np.concatenate(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b, i, chunk in chunks(batches, len(shared.value)):
            y = chunk.times(shared.value)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            # rounded: sums of another order give the same vectors
            parts.append((b.column(0)[i].values, b.column(1)[i].values, np.round(y, 10)))
            held += chunk.rows
            if held >= VECTORS:
                yield joined(parts)
                parts, held = [], 0
        if parts:
            yield joined(parts)

    ids = blocks.schema["ids"].dataType.simpleString()
    return blocks.mapInArrow(run, f"ids {ids}, names array<string>, x binary")


def projected(matrix: DataFrame, vectors: np.ndarray) -> DataFrame:
    """id, vector: rows of the matrix in the space of the vectors, of unit length."""
    width = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in vectors_in(batches, width):
            yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "vector"])

    return vector_blocks(packed(matrix), vectors).mapInArrow(run, f"id {matrix.schema['id'].dataType.simpleString()}, vector array<double>")


def vectors_in(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for b in batches:
        for i in range(len(b)):
            yield b, i, read(b, i, x=np.float64)[0].reshape(-1, width)


def families_of(x: np.ndarray, splits: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The family of unit rows: split number i makes those of a family that are nearest to its second centre family i."""
    family = np.zeros(len(x), np.int64)
    for new, (top, centres) in enumerate(splits, 1):
        at = np.flatnonzero(family == top)
        family[at[nearest(x[at], centres) == 1]] = new
    return family


def gathered(blocks: DataFrame, columns: list[str], part, merge):
    """part(batches) of every task, merged here: a few numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part(batches).tobytes()], pa.binary())], ["v"])

    found = [np.frombuffer(v) for v in blocks.select(*columns).mapInArrow(run, "v binary").toArrow()["v"].to_pylist()]
    return merge(found)


def bisected(blocks: DataFrame, width: int, families: int, seed: str = "bisect", starts: int = 3, iterations: int = 25) -> tuple[list[tuple[int, np.ndarray]], dict[int, int]]:
    """The splits for families_of, and the size of each family: the largest (the first of equals) is split in two until there are ``families``.

    A split is the best, by its sum of squared distances, of several k-means of two clusters, which
    iterate together, a job an iteration. Fewer families result where none can be split. blocks: those of vector_blocks.
    """
    spark = blocks.sparkSession
    splits: list[tuple[int, np.ndarray]] = []

    def own(batches: Iterator[pa.RecordBatch], splits: list, top: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
        """The rows of the family: block, their places, vectors and unit vectors."""
        for b, i, x in vectors_in(batches, width):
            u = normalised(x)
            at = np.flatnonzero(families_of(u, splits) == top)
            yield b, i, at, x[at], u[at]

    def first_two(splits: list, top: int, new: int) -> np.ndarray:
        """For each try the two members that its own hash puts first: starts x 2 x width."""

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            best: list[list] = [[] for _ in range(starts)]
            for b, i, at, x, _ in own(batches, splits, top):
                names = b.column(0)[i].values.take(pa.array(at)).to_pylist()
                for t in range(starts):
                    first = f"{seed}:{new}:{t}:".encode()
                    hashes = [hashlib.sha256(first + name.encode()).digest() for name in names]
                    some = sorted(range(len(names)), key=hashes.__getitem__)[:2]
                    best[t] = sorted([*best[t], *[(hashes[k], x[k]) for k in some]], key=lambda e: e[0])[:2]
            # a hash as its 32 bytes, each a number
            return np.array([[t, *h, *v] for t in range(starts) for h, v in best[t]], float)

        found = gathered(blocks, ["names", "x"], part, np.concatenate).reshape(-1, 33 + width).tolist()
        return np.array([[row[33:] for row in sorted((r for r in found if r[0] == t), key=lambda r: r[1:33])[:2]] for t in range(starts)])

    def step(splits: list, top: int, centres: np.ndarray) -> np.ndarray:
        """The means of the members nearest to each centre; a centre without members stays."""

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            sums = np.zeros((starts, 2, width + 1))
            for _, _, _, _, u in own(batches, splits, top):
                rows = np.hstack([u, np.ones((len(u), 1))])
                for t in range(starts):
                    second = nearest(u, centres[t]) == 1
                    sums[t] += np.array([~second, second], float) @ rows
            return sums

        sums = gathered(blocks, ["x"], part, lambda found: np.sum(found, axis=0)).reshape(starts, 2, width + 1)
        n = sums[:, :, -1:]
        return np.where(n > 0, sums[:, :, :-1] / np.maximum(n, 1), centres)

    def costs(splits: list, top: int, centres: np.ndarray) -> np.ndarray:
        """For each try the number of members of its second cluster, and the sum of squared distances, less the number of members."""

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((starts, 2))
            for _, _, _, _, u in own(batches, splits, top):
                for t in range(starts):
                    second = nearest(u, centres[t])
                    sims = np.round(u @ normalised(centres[t]).T, 9)[np.arange(len(u)), second]
                    # the squared distance of a unit vector to its centre: 1 + |c|^2 - 2 |c| cos
                    c = np.linalg.norm(centres[t], axis=1)[second]
                    out[t] += second.sum(), (c * c - 2 * c * sims).sum()
            return out

        return gathered(blocks, ["x"], part, lambda found: np.sum(found, axis=0)).reshape(starts, 2)

    sizes = {0: blocks.agg(F.sum(F.size("ids"))).first()[0] or 0}
    for new in range(1, families):
        top = min(sizes, key=lambda f: (-sizes[f], f))
        if sizes[top] < 2:
            break
        centres = first_two(splits, top, new)
        for _ in range(iterations):
            old, centres = centres, step(splits, top, centres)
            if np.abs(centres - old).max() <= 1e-9:
                break
        found = costs(splits, top, centres)
        # a mean, rounded: tries that end in the same split are equal whatever the number of members and the order of sums
        best = int(np.argmin(np.round(found[:, 1] / sizes[top], 12)))
        splits = [*splits, (top, centres[best])]
        moved = int(found[best, 0])
        sizes = {**sizes, top: sizes[top] - moved, new: moved}
    return splits, {f: n for f, n in sizes.items() if n}


def representatives(members: DataFrame, group: str, key: str, vector: str, k: int) -> DataFrame:
    """group, rank, key, score: the k members of each group nearest to its unit centroid by cosine (ties by key).

    The centroid is summed in the tasks first, and each task passes on its own k best of a group.
    """
    rows = members.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    long = rows.select("group", F.posexplode("v").alias("d", "x")).groupBy("group", "d").agg(F.sum("x").alias("x"))
    centre = long.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c")).withColumnRenamed("group", "of")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    size = F.sqrt(dot("v", "v") * dot("c", "c"))
    scored = rows.join(centre, F.col("group").eqNullSafe(F.col("of"))).select("group", "key", F.round(F.when(size == 0, 0.0).otherwise(dot("v", "c") / size), 6).alias("score"))
    order = Window.partitionBy("group").orderBy(F.desc("score"), "key")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("group").alias(group), "rank", F.col("key").alias(key), "score")


def topic_families(docs: DataFrame, key: str, text: str, families: int, min_df: int = 5, max_df: float = 0.98, max_features: int = 20_000, components: int = 100, stop_words: Sequence[str] = (), seed: int = 7, top_terms: int = 12, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """id, family of every text with a term of the vocabulary; and family, n, top_terms, representatives of the families.

    Texts of the same id count as one, without pairs across them.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null")
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("most")).first()
    found = coded_matrix(rows, ids["n"], min_df, max_df, max_features, stop_words) if ids["most"] == 1 else None
    words, blocks = found or term_rows(rows, ids["n"], min_df, max_df, max_features, stop_words)
    width = len(words)
    k = min(components, ids["n"] - 1, width - 1)
    if k < 2:
        raise ValueError("not enough texts or terms")
    _, vectors = truncated_svd(blocks, width, k, seed)
    space = cut(vector_blocks(blocks, vectors))
    release(blocks)
    splits, sizes = bisected(space, k, families, f"topics:{seed}")
    high = max(sizes) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((high, k))
        for _, _, x in vectors_in(batches, k):
            np.add.at(sums, families_of(normalised(x), splits), x)
        return sums

    sums = gathered(space, ["x"], part, lambda found: np.sum(found, axis=0)).reshape(high, k)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in vectors_in(batches, k):
            family = families_of(normalised(x), splits)
            c = sums[family]
            size = np.sqrt((x * x).sum(1) * (c * c).sum(1))
            score = np.round(np.where(size == 0, 0.0, (x * c).sum(1) / np.where(size == 0, 1.0, size)), 6)
            yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(family), pa.array(score)], ["id", "family", "score"])

    out = space.select("ids", "x").mapInArrow(placed, f"id {rows.schema['id'].dataType.simpleString()}, family long, score double")
    names = np.array(words["term"].to_pylist())
    # as many rows as families, and max_features scores each
    tops = [(f, n, names[np.argsort(-(sums[f] / n @ vectors.T), kind="stable")[:top_terms]].tolist()) for f, n in sorted(sizes.items())]
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("score"), "id"))
    near = out.withColumn("rank", rank).where(F.col("rank") <= examples)
    near = near.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("representatives"))
    profile = docs.sparkSession.createDataFrame(tops, "family long, n long, top_terms array<string>").join(near, "family")
    return out.select("id", "family"), profile


def coded_matrix(rows: DataFrame, n: int, min_df: int, max_df: float, max_features: int, stop_words: Sequence[str]) -> tuple[pa.Table, DataFrame] | None:
    """The vocabulary (in the order of j) and the blocks of the term matrix; rows: id (each once), text. None: more than WORDS words can be in it.

    A pair occurs at most as often, and in at most as many texts, as either of its words. So where
    max_features words are eligible, no pair is chosen whose words occur less often than the last of those.
    """
    spark = rows.sparkSession
    if rows.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:
        rows = spread(rows, "id")
    rows = rows.select("id", words_of(F.col("text"), stop_words).alias("words"))
    texts = cut(coded_texts(rows))
    counted = cut(word_counts(texts).where(F.col("df") >= min_df), shuffled=True)
    able = counted.where(F.col("times") >= least_times(counted, n, min_df, max_df, max_features)).select("term")
    if able.count() > WORDS:
        release(texts, counted)
        return None
    words = able.orderBy("term").toArrow()["term"].combine_chunks()
    terms = most_frequent(counted.unionByName(pair_counts(texts, words)), n, min_df, max_df, max_features).orderBy("j").toArrow()
    blocks = cut(matrix_blocks(texts, words, terms))
    release(texts, counted)
    return terms, blocks


def term_rows(rows: DataFrame, n: int, min_df: int, max_df: float, max_features: int, stop_words: Sequence[str]) -> tuple[pa.Table, DataFrame]:
    """The same for any ids and any number of words: every term of a text is a row."""
    rows = spread(rows, "id").select("id", terms(F.col("text"), stop_words).alias("terms"))
    # outer: the filter that Spark infers from a plain explode would take the texts apart before they are dealt
    counts = cut(rows.select("id", F.explode_outer("terms").alias("term")).where("term is not null").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")), shuffled=True)
    words = cut(vocabulary(counts, n, min_df, max_df, max_features), shuffled=True)
    blocks = cut(packed(term_matrix(counts, words)), shuffled=True)
    found = words.orderBy("j").toArrow()
    release(counts, words)
    return found, blocks
