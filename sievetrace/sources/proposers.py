"""Sources of proposals: a rule-based one, files, and hosted ones behind a remembered call."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetrace.functions.hashing import nul_ended_key
from sievetrace.functions.text import AUTOMATION, prompt
from sievetrace.sources.jsonl import candidates

#: Actions of the rule-based proposer (fixed values).
BANK = ("rfl", "exact h", "assumption", "trivial", "constructor", "intro h", "intros", "simp", "decide", "omega", "apply h", "rw [h]", "rcases h with ⟨a, b⟩")


def first_of(env: dict[str, str], *names: str) -> str | None:
    """The first of several variables that is set and not empty."""
    return next((env[n] for n in names if env.get(n)), None)


def as_number(text: str | None, default: float) -> float:
    """A number, or the default for none or something else."""
    try:
        return float(text) if text else default
    except ValueError:
        return default


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file, without comments and enclosing quotes; none for a missing file."""
    out: dict[str, str] = {}
    if not os.path.exists(path):
        return out
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if not sign or name.startswith("#"):
                continue
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].rstrip()
    return out


@dataclass(frozen=True)
class Settings:
    """Settings of a collection, from the environment and, for what isn't set there, a file."""

    source: str = "mock"
    backend: str = "mock"
    model: str = "mock"
    timeout_s: float = 10.0
    retries: int = 2
    command: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, path: str | None = None) -> Settings:
        env = (env_file(path) if path else {}) | dict(os.environ if env is None else env)
        named = lambda k, *more: first_of(env, f"SIEVETRACE_{k}", *more)
        return cls(
            named("SOURCE") or cls.source, named("BACKEND") or cls.backend, named("MODEL") or cls.model, as_number(named("TIMEOUT", "SIEVETRACE_TIMEOUT_S"), cls.timeout_s),
            int(as_number(named("RETRIES"), cls.retries)), named("COMMAND") or cls.command,
        )


def mock_proposals(name: Column, state: Column, k: int, style: str = "diverse", seed: int = 0) -> Column:
    """Array of ``k`` actions of the bank, in an order that depends on theorem and state alone, then a repeat of
    the first and one that cleaning must drop."""
    bank = [a for a in BANK if style != "no_automation" or a not in AUTOMATION]
    keyed = F.transform(F.array(*map(F.lit, bank)), lambda a: F.struct(F.xxhash64(name, state, F.lit(seed), a).alias("h"), a.alias("a")))
    chosen = F.transform(F.slice(F.sort_array(keyed), 1, k), lambda s: s["a"])
    return F.concat(chosen, F.slice(chosen, 1, 1), F.array(F.lit("sorry")))


def mock(states: DataFrame, k: int, style: str = "diverse", seed: int = 0) -> DataFrame:
    """Rows of proposals for states, as a proposals table."""
    made = states.withColumn("candidates", mock_proposals(F.col("theorem_name"), F.col("state"), k, style, seed))
    return made.select("theorem_name", F.col("state").alias("state_before"), "candidates", F.lit("mock").alias("source"), F.lit(style).alias("prompt_style"), F.lit(0).alias("_file_ord"), F.lit(0).cast("long").alias("_line_no"))


def manual(states: DataFrame, path: str) -> DataFrame:
    """Rows of proposals from a file, whatever the states are; which of them a state gets is ``lookup.prioritised``'s."""
    return candidates(states.sparkSession, path)


def retried(call: Callable[[str], str], times: int, wait_s: float = 0.5) -> Callable[[str], str]:
    """A call that is made again after an exception, a number of times, with growing pauses."""

    def run(request: str) -> str:
        for k in range(times + 1):
            try:
                return call(request)
            except Exception:
                if k == times:
                    raise
                time.sleep(wait_s * 2**k)
        raise AssertionError

    return run


def hosted(states: DataFrame, call: Callable[[str], str], known: DataFrame, model: str, k: int, style: str = "diverse") -> tuple[DataFrame, DataFrame]:
    """(states with ``raw_output``, new rows to remember): each distinct request that isn't known is called once."""
    request = prompt(F.col("theorem_name"), F.col("theorem_statement"), F.col("state"), k, style)
    asked = states.withColumn("request", request).withColumn("cache_key", nul_ended_key(F.lit(model), F.lit(style), F.col("request")))
    todo = asked.select("cache_key", "request").join(known.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "raw_output": [call(r) for r in batch["request"]]})

    new = todo.mapInPandas(run, "cache_key string, raw_output string")
    return asked.join(known.select("cache_key", "raw_output").union(new), "cache_key", "left").drop("request"), new


SOURCES = {"mock": mock, "manual-file": manual, "hosted": hosted}


def source(name: str) -> Callable:
    """A source by name, in any spelling; ValueError for an unknown one."""
    key = name.strip().lower().replace("_", "-")
    key = {"anthropic": "hosted", "openai": "hosted", "manual": "manual-file", "file": "manual-file"}.get(key, key)
    if key not in SOURCES:
        raise ValueError(f"unknown source {name!r}; there are {sorted(SOURCES)}")
    return SOURCES[key]
