"""Model calls as injected batch functions; the repository has deterministic fakes, no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[str], list[int]], list[str]]
Scorer = Callable[[list[str], list[str]], list[float]]


def fake_encoder(texts: list[str], width: int = 16) -> np.ndarray:
    out = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % width] += 1
    return out


def fake_generator(prompts: list[str], seeds: list[int]) -> list[str]:
    return [hashlib.sha256(f"{s}:{p}".encode()).hexdigest()[:16] for p, s in zip(prompts, seeds)]


def fake_scorer(left: list[str], right: list[str]) -> list[float]:
    words = lambda t: set(t.lower().split())
    return [len(words(a) & words(b)) / max(1, len(words(a) | words(b))) for a, b in zip(left, right)]


def embed(df: DataFrame, key: str, text: str, encoder: Encoder = fake_encoder) -> DataFrame:
    """key, vector; each distinct text is encoded once."""
    texts = df.select(F.coalesce(text, F.lit("")).alias("t")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(b.column(0).to_pylist()).tolist(), pa.list_(pa.float32()))], ["t", "vector"])

    done = texts.mapInArrow(run, "t string, vector array<float>")
    return df.select(key, F.coalesce(text, F.lit("")).alias("t")).join(done, "t").select(key, "vector")


def generate(jobs: DataFrame, key: str, prompt: str, seed: str, generator: Generator = fake_generator) -> DataFrame:
    """key, status, output: errors are rows, not failures of the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                out, status = generator(b.column(1).to_pylist(), b.column(2).to_pylist()), "ok"
            except Exception as e:  # noqa: BLE001  a failed call is a ledger row
                out, status = [str(e)] * b.num_rows, "error"
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([status] * b.num_rows), pa.array(out, pa.string())], [key, "status", "output"])

    return jobs.select(key, F.coalesce(prompt, F.lit("")), F.col(seed).cast("long")).mapInArrow(run, f"{key} {dict(jobs.dtypes)[key]}, status string, output string")


def score_pairs(pairs: DataFrame, left: str, right: str, scorer: Scorer = fake_scorer) -> DataFrame:
    """pairs with pair_score."""

    def run(frames):
        for pdf in frames:
            pdf["pair_score"] = scorer(pdf[left].tolist(), pdf[right].tolist())
            yield pdf

    return pairs.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in pairs.dtypes) + ", pair_score double")
