"""Verifiers: a rule-based one in column expressions, a subprocess one, sessions, and the memory of verdicts."""

from __future__ import annotations

import os
import subprocess
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sievetrace.functions.hashing import nul_joined_key
from sievetrace.functions.text import DIAGNOSTICS_LIMIT, NO_GOALS, PLACEHOLDER_STATE, count_goals, render_template, strip
from sievetrace.operators.lookup import unknown
from sievetrace.schema import ACTION_SLOT, VERDICTS

#: Heads that close a goal for the rule-based verifier (fixed values).
FINISHERS = ("rfl", "decide", "trivial", "omega", "norm_num")
RESULT = "next_state string, proof_finished boolean, num_goals int, error string, elapsed_ms double"


def mock_verdict(state: Column, action: Column) -> Column:
    """Struct of next_state, proof_finished, num_goals, error and success, by the rule-based verifier's rules."""
    token = F.regexp_extract(F.coalesce(action, F.lit("")), r"(?U)^\s*(\S+)", 1)
    state = F.coalesce(state, F.lit(""))
    goals = count_goals(state)
    blocks = F.filter(F.split(state, "\n\n"), lambda b: F.length(strip(b)) > 0)
    intro = F.regexp_replace(F.regexp_replace(state, "^([\\s\\S]*?)⊢ ∀", "$1⊢"), "^([\\s\\S]*?)⊢ →", "$1⊢")
    intro = F.when(intro == state, F.concat(state, F.lit("\nh : _"))).otherwise(intro)
    finishes = token.isin(*FINISHERS) | ((token == "simp") & (goals <= 1))
    rest = F.array_join(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), "\n\n")
    after = F.when(finishes, NO_GOALS).when(token.isin("intro", "intros"), intro).when(token == "simp", rest)
    error = F.when(after.isNull(), F.concat(F.lit("mock: unknown tactic '"), token, F.lit("'")))
    return F.struct(after.alias("next_state"), F.coalesce(finishes, F.lit(False)).alias("proof_finished"), F.when(error.isNotNull(), goals).otherwise(count_goals(after)).alias("num_goals"), error.alias("error"), error.isNull().alias("success"))


class Session(Protocol):
    """A verifier that a worker opens once for each theorem."""

    def start(self, theorem: dict) -> str: ...

    def run(self, state: str, action: str) -> dict: ...

    def close(self) -> None: ...


class Live:
    """A session over a backend with state objects: states are known by their printed form.

    ``backend.start(theorem)`` gives a state, ``backend.run(state, action)`` one of: an object with ``error``; one with
    ``pp``, a state; one whose ``finished`` is true.  An action on a printed form that wasn't seen is an error.
    """

    def __init__(self, backend: Any) -> None:
        self.backend = backend
        self.states: dict[str, Any] = {}

    def start(self, theorem: dict) -> str:
        return self._seen(self.backend.start(theorem))

    def _seen(self, state: Any) -> str:
        self.states[state.pp] = state
        return state.pp

    def run(self, state: str, action: str) -> dict:
        if state not in self.states:
            return {"error": "unknown state", "num_goals": None}
        result = self.backend.run(self.states[state], action)
        if getattr(result, "error", None):
            return {"error": str(result.error), "num_goals": max(1, state.count("⊢"))}
        if getattr(result, "finished", False):
            return {"next_state": NO_GOALS, "proof_finished": True, "num_goals": 0}
        if getattr(result, "pp", None) is None:
            return {"error": f"unexpected result {type(result).__name__}", "num_goals": None}
        return {"next_state": self._seen(result), "proof_finished": False, "num_goals": max(1, result.pp.count("⊢"))}

    def close(self) -> None:
        self.states.clear()
        getattr(self.backend, "close", lambda: None)()


def cut(said: str, limit: int = DIAGNOSTICS_LIMIT) -> str:
    """Output up to a number of characters, marked where it is cut."""
    return said if len(said) <= limit else said[:limit] + "...[truncated]"


class Subprocess:
    """Checks a whole rendered file with an external command, one process for each distinct row."""

    def __init__(self, command: list[str], timeout_s: float = 10.0, suffix: str = ".lean") -> None:
        self.command, self.timeout_s, self.suffix = command, timeout_s, suffix

    def check(self, source: str) -> dict:
        """Verdict of a source text; a missing command, a timeout and a failure are errors."""
        began = time.monotonic()
        with tempfile.NamedTemporaryFile("w", suffix=self.suffix, delete=False) as f:
            f.write(source)
        try:
            done = subprocess.run([*self.command, f.name], capture_output=True, text=True, timeout=self.timeout_s)
            said = "\n".join(x.strip() for x in (done.stderr, done.stdout) if x.strip())
            error = None if done.returncode == 0 else cut(said) or f"exit code {done.returncode}"
        except subprocess.TimeoutExpired:
            error = "timeout"
        except FileNotFoundError:
            error = f"command not found: {self.command[0]}"
        finally:
            os.unlink(f.name)
        return {"success": error is None, "error": error, "elapsed_ms": (time.monotonic() - began) * 1000}


VERDICT = "success boolean, error string, elapsed_ms double"


def check_sources(rows: DataFrame, source: str, checker: Callable[[str], dict]) -> DataFrame:
    """Rows with the verdict of ``checker`` for their source text."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([checker(s) for s in batch[source]], columns=["success", "error", "elapsed_ms"], index=batch.index)
            yield pd.concat([batch, found], axis=1)[[*names, "success", "error", "elapsed_ms"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, {VERDICT}")


def within(seconds: float | None, work: Callable[[], dict]) -> dict:
    """The result of ``work``, or an error for a timeout or an exception; a thread that is late is left behind."""
    found: list[dict] = []

    def run() -> None:
        try:
            found.append(work())
        except Exception as e:  # a verifier's crash is that action's error
            found.append({"error": f"exception: {e}", "num_goals": 0})

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    return found[0] if found else {"error": "timeout", "num_goals": 0}


def run_sessions(rows: DataFrame, open_session: Callable[[], Session], timeout_s: float | None = None, order: str | None = None) -> DataFrame:
    """Results of actions on states (theorem_name, state, tactic), a session for each theorem, closed when the next one comes.

    A theorem's rows meet in one task, by ``order`` if that is given; its session stays open over Arrow batches.
    """
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, theorem = None, object()
        try:
            for batch in batches:
                out = []
                for row, own in zip(batch.itertuples(index=False), batch.to_dict("records"), strict=True):
                    if own["theorem_name"] != theorem:
                        if session is not None:
                            session.close()
                        session, theorem = open_session(), own["theorem_name"]
                        session.start(own)
                    result = within(timeout_s, lambda s=own["state"], t=own["tactic"], on=session: on.run(s, t))
                    out.append((*row, result.get("next_state"), bool(result.get("proof_finished")), result.get("num_goals"), result.get("error"), result.get("elapsed_ms")))
                yield pd.DataFrame(out, columns=[*names, "next_state", "proof_finished", "num_goals", "error", "elapsed_ms"])
        finally:
            if session is not None:
                session.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sort = ["theorem_name", *([order] if order else [])]
    return rows.repartition("theorem_name").sortWithinPartitions(*sort).mapInPandas(run, f"{schema}, {RESULT}")


def runnable(seeds: DataFrame) -> DataFrame:
    """``problem``: why a seed can't be rendered (no template, or no place for the action in it); null if it can."""
    slot = F.coalesce("placeholder", F.lit(ACTION_SLOT))
    missing = F.coalesce(F.length("template"), F.lit(0)) == 0
    return seeds.withColumn("problem", F.when(missing, "no template").when(~F.col("template").contains(slot), "no placeholder in the template"))


def example_source(statement: Column, action: Column) -> Column:
    """The file that checks an action for a bare statement."""
    return F.concat(F.lit("example "), statement, F.lit(" := by\n  "), action, F.lit("\n"))


def verifier(backend: str, **options):
    """What checks actions for a backend in any spelling: column rules, a command, or sessions; ValueError for another."""
    name = backend.strip().lower().replace("_", "-")
    if name == "mock":
        return mock_verdict
    if name == "lean-cli":
        return Subprocess(**options).check
    if name == "leandojo":
        return lambda rows: run_sessions(rows, **options)
    raise ValueError(f"unknown backend {backend!r}")


# -- what a collection asks: rows with theorem_name, state and tactic, which get the struct ``result``

_RESULT = "struct<next_state:string,proof_finished:boolean,num_goals:int,error:string,success:boolean>"


def by_column(verdict: Callable[[Column, Column], Column] = mock_verdict) -> Callable[[DataFrame], DataFrame]:
    """Attempts judged by a column expression of state and action."""
    return lambda rows: rows.withColumn("result", verdict(F.col("state"), F.col("tactic")))


def by_checker(checker: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    """Attempts judged as whole files, rendered from the seed's template; each distinct file is checked once.

    A seed without a template, or without a place for the action in it, fails with that as its error.
    """

    def run(rows: DataFrame) -> DataFrame:
        given = runnable(rows)
        source = render_template(F.col("template"), F.coalesce("placeholder", F.lit(ACTION_SLOT)), F.col("tactic"), F.col("imports"))
        given = given.withColumn("_source", F.when(F.col("problem").isNull(), source))
        checked = check_sources(given.select("_source").filter("_source is not null").distinct(), "_source", checker)
        told = given.join(checked, "_source", "left")
        ok, error = F.coalesce("success", F.lit(False)), F.coalesce("problem", "error")
        result = F.struct(F.when(ok, F.lit(PLACEHOLDER_STATE)).alias("next_state"), ok.alias("proof_finished"), F.when(ok, 0).otherwise(count_goals(F.col("state"))).alias("num_goals"), F.when(~ok, error).alias("error"), ok.alias("success"))
        return told.select(*rows.columns, result.cast(_RESULT).alias("result"))

    return run


def by_sessions(open_session: Callable[[], Session], timeout_s: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """Attempts judged in sessions."""

    def run(rows: DataFrame) -> DataFrame:
        done = run_sessions(rows, open_session, timeout_s)
        result = F.struct("next_state", "proof_finished", "num_goals", "error", F.col("error").isNull().alias("success"))
        return done.select(*rows.columns, result.alias("result"))

    return run


def attempts(backend: str, **options) -> Callable[[DataFrame], DataFrame]:
    """How a collection's attempts are judged, by a backend's name in any spelling; ValueError for another."""
    name = backend.strip().lower().replace("_", "-")
    if name == "mock":
        return by_column()
    if name == "lean-cli":
        return by_checker(Subprocess(**options).check)
    if name == "leandojo":
        return by_sessions(**options)
    raise ValueError(f"unknown backend {backend!r}")


# -- memory


def verdict_key(name: str = "theorem_name", action: str = "tactic") -> Column:
    """The key that a verdict is remembered by."""
    return nul_joined_key(F.col(name), F.col(action))


def with_memory(asked: DataFrame, known: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(asked with verdicts, verdicts to remember): each distinct unknown action is checked once; timeouts aren't remembered.

    ``verify`` gets distinct rows with ``cache_key`` and adds success, error and elapsed_ms.  Write what it
    returns before using it twice: a verifier isn't deterministic.
    """
    keyed = asked.withColumn("cache_key", verdict_key())
    new = verify(unknown(keyed, known)).select("cache_key", "theorem_statement", "success", "error", "elapsed_ms")
    every = known.select(*new.columns).union(new)
    return keyed.join(every.drop("theorem_statement"), "cache_key", "left"), new.filter("error is null or error <> 'timeout'")


def remembered(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts that :func:`check_all` has left in a folder, each key once; none if there is no such folder."""
    try:
        found = spark.read.schema(f"{VERDICTS}, kept boolean, run string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], VERDICTS)
    return found.filter("kept").drop("kept", "run").dropDuplicates(["cache_key"])


def check_all(asked: DataFrame, verify: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """``asked`` (theorem_name, theorem_statement, tactic) with verdicts; new ones are appended to the folder of earlier runs.

    Each distinct unknown action is checked once and written before it is used, so nothing is checked again for a
    second use, a lost executor's finished work or a later run.  Timeouts are written, too, but not remembered.
    """
    spark, run = asked.sparkSession, uuid.uuid4().hex
    keyed = asked.withColumn("cache_key", verdict_key())
    known = remembered(spark, path)
    new = verify(unknown(keyed, known)).select("cache_key", "theorem_statement", "success", "error", "elapsed_ms")
    new.withColumn("kept", F.coalesce(F.col("error") != "timeout", F.lit(True))).withColumn("run", F.lit(run)).write.mode("append").partitionBy("kept", "run").parquet(path)
    every = spark.read.schema(f"{VERDICTS}, kept boolean, run string").parquet(path).filter((F.col("run") == run) | F.col("kept"))
    every = every.dropDuplicates(["cache_key"]).select("cache_key", "success", "error", "elapsed_ms")
    return keyed.join(every, "cache_key", "left")
