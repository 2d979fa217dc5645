"""Parts of generative rankers: vocabulary, latent statistics, sampling, beam search; models plug in as step functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sievetrace.sources.working import numbered

#: Ids of pad, begin, end and unknown (fixed values).
PAD, BEGIN, END, UNKNOWN = range(4)


def vocabulary(rows: DataFrame, col: str) -> DataFrame:
    """(char, id): the distinct characters in order, ids from 4."""
    chars = rows.select(F.explode(F.split(col, "")).alias("char")).filter("char <> ''").distinct()
    return chars.withColumn("id", (F.row_number().over(Window.orderBy("char")) + UNKNOWN).cast("int"))  # an alphabet: bounded


def encode(text: str, ids: dict[str, int], most: int | None = None, target: bool = False) -> list[int]:
    """Ids of a text; a target stands between begin and end, and keeps its end where it is cut."""
    out = [ids.get(c, UNKNOWN) for c in text]
    if target:
        out = [BEGIN, *out, END]
        return out if most is None or len(out) <= most else [*out[: most - 1], END]
    return out if most is None else out[:most]


def decode(ids: list[int], chars: dict[int, str]) -> str:
    """Text of ids up to the end mark, without special ids."""
    cut = ids.index(END) if END in ids else len(ids)
    return "".join(chars[i] for i in ids[:cut] if i in chars)


def truncated(rows: DataFrame, col: str, most: int) -> DataFrame:
    """One row: texts longer than a model's input, and all texts."""
    return rows.agg(F.count_if(F.length(col) > most).alias("truncated"), F.count("*").alias("n"))


def library(rows: DataFrame, col: str) -> DataFrame:
    """(idx, text): distinct texts in order, whose latents samples snap to."""
    texts = numbered(rows.select(F.col(col).alias("text")).distinct(), "idx", "text")
    return texts.select(F.col("idx").cast("int").alias("idx"), "text")


def latent_statistics(rows: DataFrame, vector: str) -> DataFrame:
    """(dim, mean, std): sample deviation, at least 0.001."""
    each = rows.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy("dim").agg(F.avg("x").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), F.lit(1e-3)).alias("std"))


def save(path: str, chars: DataFrame, statistics: DataFrame | None = None) -> None:
    """Write a model's alphabet and, if it has latents, their statistics."""
    chars.write.mode("overwrite").parquet(f"{path}/vocabulary")
    if statistics is not None:
        statistics.write.mode("overwrite").parquet(f"{path}/latents")


def load(spark: SparkSession, path: str) -> tuple[dict[str, int], list[tuple[float, float]]]:
    """A model's ids by character, and the mean and deviation of each latent dimension (none without statistics): both bounded by the model."""
    ids = {r.char: r.id for r in spark.read.parquet(f"{path}/vocabulary").collect()}
    try:
        rows = spark.read.parquet(f"{path}/latents").orderBy("dim").collect()
    except AnalysisException:
        rows = []
    return ids, [(r["mean"], r["std"]) for r in rows]


def by_frequency(samples: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n, rank): sampled texts by how often they came, then in their order."""
    counted = samples.groupBy(key, text).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), text)))


class Generator(Protocol):
    """A model for decoding: a state for a prompt, and log probabilities of the next id for states and last ids."""

    def start(self, prompt: str) -> np.ndarray: ...

    def step(self, states: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


def greedy(model: Generator, prompt: str, chars: dict[int, str], most: int) -> str:
    """The likeliest next id each time."""
    state, last, out = model.start(prompt)[None], np.array([BEGIN]), []
    for _ in range(most):
        state, log_p = model.step(state, last)
        last = log_p.argmax(axis=1)
        if last[0] == END:
            break
        out.append(int(last[0]))
    return decode(out, chars)


def beam(model: Generator, prompt: str, chars: dict[int, str], width: int, most: int, alpha: float = 0.7) -> list[tuple[str, float]]:
    """Distinct texts by length-normalised log probability, the best score of each; stops when nothing can still get among the best."""
    live = [([BEGIN], 0.0, model.start(prompt))]
    done: list[tuple[list[int], float]] = []
    norm = lambda ids, lp: lp / max(len(ids) - 1, 1) ** alpha
    for _ in range(most):
        states, log_p = model.step(np.stack([s for *_, s in live]), np.array([ids[-1] for ids, *_ in live]))
        total = np.array([lp for _, lp, _ in live])[:, None] + log_p
        places = np.argsort(-total, axis=None, kind="stable")[: 2 * width]
        grown = []
        for place in places:
            row, token = divmod(int(place), log_p.shape[1])
            ids, lp = [*live[row][0], token], float(total[row, token])
            if token == END:
                done.append((ids, norm(ids, lp)))
            elif len(grown) < width:
                grown.append((ids, lp, states[row]))
        live = grown
        if not live or len(done) >= width and max(lp for _, lp, _ in live) / most**alpha < sorted((s for _, s in done), reverse=True)[width - 1]:
            break  # no live text can still get among the best
    done += [(ids, norm(ids, lp)) for ids, lp, _ in live] if len(done) < width else []
    best: dict[str, float] = {}
    for ids, score in sorted(done, key=lambda d: -d[1]):
        best.setdefault(decode(ids[1:], chars), score)
    return list(best.items())[:width]


def predict(rows: DataFrame, prompt: str, make: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """Rows with ``predictions`` of a model that each worker makes once for a partition."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield batch.assign(predictions=[model(p) for p in batch[prompt]])[[*names, "predictions"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, predictions array<string>")


def noise(prompt: str, seed: int, n: int, dim: int) -> np.ndarray:
    """Starting noise of a prompt's samples, the same in every run."""
    return np.random.default_rng(seed ^ zlib.crc32(prompt.encode())).standard_normal((n, dim)).astype(np.float32)


def sample(prompt: str, velocity: Callable[[np.ndarray, float], np.ndarray], read: Callable[[np.ndarray], list[str]], n: int, dim: int, steps: int, seed: int = 0) -> list[tuple[str, int]]:
    """Texts of ``n`` latents after Euler steps from noise, by frequency, then in their order."""
    z = noise(prompt, seed, n, dim)
    for k in range(steps):
        z = z + velocity(z, k / steps) / steps
    counts: dict[str, int] = {}
    for text in read(z):
        counts[text] = counts.get(text, 0) + 1
    return sorted(counts.items(), key=lambda c: (-c[1], c[0]))


def snap(z: np.ndarray, library: np.ndarray, texts: list[str]) -> list[str]:
    """The library text nearest to each latent; ties by lowest index; empty for an empty library."""
    if not len(texts):
        return [""] * len(z)
    return [texts[int(((library - row) ** 2).sum(axis=1).argmin())] for row in z]
