r"""Phrase collocations: n-grams as rows, counted per language, scored against their parts.

Texts are lower-cased in A-Z, cut at punctuation and line ends into pieces, and these at blanks
into words. The n-grams of a batch of texts become rows (equal ones a row with its count, so that
a frequent word is one row a batch), dealt by (language, phrase) and aggregated. Words and pairs
come first. A longer phrase is only as frequent as the two that it holds, one word shorter; those
whose parts are not both frequent are not made rows, told by a Bloom filter of bounded size that
forgets none (a fuller filter costs time and changes no result).
A candidate has two words or more and at least ``least`` occurrences. Its parts occur at least as
often, so the table of frequent phrases holds them all, and two joins give a cut's counts l and r;
the lowest score over the cuts counts. A phrase that lies inside a longer candidate of at least
half its occurrences is dropped: the one-word extension with the most occurrences decides, as no
longer one occurs more often than the extensions that it holds.

Products are Decimal(38, 0), which holds 1000000 * a * a up to a = 10**16. The first ``top`` of a
language are found among the first of ``PARTS`` hashed parts, so that no task sorts a language.

Edge cases: null texts have no words, a null language is ``und``; repeated rows count as often as
they stand there; doc_id is not read; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import cut, map_arrow
from .textvec import LOWER, U64, buffers, mix, prefix, runs, span_hash

# fixed values of the contract
BREAK, INSIDE = np.zeros(256, bool), np.ones(256, bool)
BREAK[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
INSIDE[BREAK] = INSIDE[[32, 9]] = False
MAX_N, LEAST, SHARE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Parts of a language that are ranked apart before the whole is.
PARTS = 64
#: Bytes of text whose n-grams are counted together before they are rows, and rows of an Arrow batch.
BATCH_BYTES, OUT_ROWS = 4 << 20, 1 << 16


class Grams:
    """The n-grams of a batch of texts, level by level: distinct ones with their counts."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        data, offsets = buffers(texts)
        low = LOWER[data]
        a, b = runs(INSIDE[low], offsets)
        self.doc = np.searchsorted(offsets, a, side="right") - 1
        self.piece = np.cumsum(BREAK[low])[a] if len(a) else a
        flat, ends = low[INSIDE[low]], np.append(0, np.cumsum(b - a))
        words = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(ends), pa.py_buffer(flat)).dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        langs = langs.dictionary_encode()
        width = max(1, len(langs.dictionary))
        own = pa.array(self.code * width + langs.indices.to_numpy()[self.doc]).dictionary_encode()
        keys = own.dictionary.to_numpy()
        # of the level: a distinct n-gram's language and phrase, the place where each occurrence starts, and which n-gram it is
        self.size, self.at, self.of = 1, np.arange(len(a)), own.indices.to_numpy().astype(np.int64)
        self.lang, self.phrase = langs.dictionary.take(pa.array(keys % width)), self.words.take(pa.array(keys // width))

    def longer(self, kept: np.ndarray | None = None) -> None:
        """Go to the next level: n-grams and the word after them; kept: of the distinct n-grams, those that an occurrence must begin and end with."""
        n, last = self.size, len(self.code) - self.size
        open_ = (self.doc[: max(0, last)] == self.doc[n:]) & (self.piece[: max(0, last)] == self.piece[n:])
        now = np.full(len(self.code), -1)
        now[self.at] = self.of
        start = np.flatnonzero(open_ & (now[: max(0, last)] >= 0))
        if kept is not None:
            after = now[start + 1]
            start = start[kept[now[start]] & (after >= 0) & kept[after]]
        width = max(1, len(self.words))
        found = pa.array(now[start] * width + self.code[start + n]).dictionary_encode()
        keys = found.dictionary.to_numpy()
        before, word = pa.array(keys // width), pa.array(keys % width)
        self.size, self.at, self.of = n + 1, start, found.indices.to_numpy().astype(np.int64)
        self.lang, self.phrase = self.lang.take(before), pc.binary_join_element_wise(self.phrase.take(before), self.words.take(word), pa.scalar(" ", pa.large_string()))

    def rows(self) -> pa.RecordBatch:
        times = np.bincount(self.of, minlength=len(self.phrase))
        return pa.RecordBatch.from_arrays([self.lang.cast(pa.string()), self.phrase.cast(pa.string()), pa.array(times)], ["lang", "phrase", "times"])


def hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """64-bit hashes of phrases with their languages."""
    out = np.zeros(len(langs), U64)
    for column in (langs, phrases):
        data, offsets = buffers(column)
        out = mix(out * U64(3) + span_hash(prefix(data), offsets[:-1], offsets[1:]) + np.diff(offsets).astype(U64))
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """langs and texts of about BATCH_BYTES at a time (a longer text is not cut)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.column(1).nbytes for x in held) >= BATCH_BYTES:
            yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))
            held = []
    if held:
        yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))


def phrases(docs: DataFrame, sizes: range, known: Broadcast | None = None) -> DataFrame:
    """lang, phrase, times: a row for every n-gram of these sizes of a batch; and, with words, rows without a phrase that count them.

    known: a filter of the frequent n-grams one word shorter than sizes; only what begins and ends with such is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for langs, texts in gathered(batches):
            grams = Grams(texts, langs)
            for n in sizes:
                while grams.size < n:
                    grams.longer(bloom.maybe(known.value, hashes(grams.lang, grams.phrase)) if known is not None and grams.size == n - 1 else None)
                out = grams.rows()
                if n == 1:
                    for lang, times in zip(out.column(0).to_pylist(), out.column(2).to_pylist()):
                        words[lang] += times
                for i in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(i, OUT_ROWS)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words)), pa.nulls(len(words), pa.string()), pa.array(list(words.values()))], ["lang", "phrase", "times"])

    return map_arrow(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), run, "lang string, phrase string, times long")


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, size, phrase, f of all phrases with f >= least; and lang, n."""

    def level(sizes: range, known: Broadcast | None) -> DataFrame:
        rows = phrases(docs, sizes, known).repartition("lang", "phrase")  # equal phrases of a batch are one row already
        counts = rows.groupBy("lang", "phrase").agg(F.sum("times").alias("f"))
        return cut(counts.where((F.col("f") >= least) | F.col("phrase").isNull()).select("lang", F.size(F.split("phrase", " ")).alias("size"), "phrase", "f"), shuffled=True)

    first = level(range(1, min(2, max_n) + 1), None)
    n = first.where("phrase is null").select("lang", F.col("f").alias("n"))
    out = first.where("phrase is not null")
    for size in range(3, max_n + 1):

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(hashes(b.column(0), b.column(1)).view(np.int64))], ["h"])

        shorter = bloom.filter_of(map_arrow(out.where(F.col("size") == size - 1).select("lang", "phrase"), hashed, "h long"))
        out = out.unionAll(level(range(size, size + 1), shorter))
    return out, n


def scored(known: DataFrame) -> DataFrame:
    """lang, size, phrase, a, l, r, score of candidates, by the lowest-scoring cut; known: lang, size, phrase, f."""
    w = F.split("phrase", " ")
    cuts = known.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(w, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    part = known.select("lang", "phrase", "f")
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", F.lit(SCALE).cast("decimal(38,0)") * whole("a") * whole("a")).withColumn("under", whole("l") * whole("r"))
    best = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "best.l", "best.r", "best.score")


def inside(known: DataFrame) -> DataFrame:
    """lang, phrase, most: the highest count of a candidate that is phrase and one more word before or after it."""
    w = F.split("phrase", " ")
    subs = F.array(F.array_join(F.slice(w, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("size") - 1), " "))
    return known.where("size > 2").select("lang", F.explode(subs).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first top rows of each lang and their rank, by score, a and phrase."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top collocations of each language."""
    known, n = frequent(docs, max_n, least)
    longer = inside(known).where(F.col("most") >= least)
    rows = scored(known).join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    rows = ranked(rows, top).join(n, "lang")
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return rows.select("lang", *long("rank"), "phrase", *long("a", "l", "r", "n", "score"))
