"""Collection: propose, clean, verify, and record every attempt; one step or a bounded depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetrace.functions.hashing import state_hash
from sievetrace.functions.text import clean_candidates, count_goals
from sievetrace.operators.lookup import prioritised
from sievetrace.operators.verify import by_column
from sievetrace.sources.working import written


RENDERED = ("template", "placeholder", "imports")


def utc_now() -> F.Column:
    """The time in ISO form, in UTC whatever the session's time zone."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def start_states(seeds: DataFrame) -> DataFrame:
    """Seeds with their first state, step 0 and no parent."""
    first = F.coalesce(F.nullif("initial_state", F.lit("")), F.concat(F.lit("⊢ "), "theorem_statement"))
    given = [c for c in RENDERED if c in seeds.columns]  # what a backend that checks whole files renders
    return seeds.select("theorem_name", "theorem_statement", *given, first.alias("state"), F.lit(0).alias("step_index"), F.lit(None).cast("string").alias("parent_state_hash"))


def step(states: DataFrame, proposals: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None, most: int | None = None, backend: str = "mock") -> DataFrame:
    """One attempt for each kept proposal of each state, as trace rows; ``judge`` (see ``verify.attempts``) adds their results."""
    asked = prioritised(states, proposals, most)
    cleaned = asked.withColumn("cleaned", clean_candidates(F.col("candidates")))
    tried = cleaned.select(*states.columns, "source", "prompt_style", F.posexplode("cleaned.kept").alias("place", "tactic"))
    tried = (judge or by_column())(tried)
    after = F.col("result.next_state")
    return tried.select(
        "theorem_name", "theorem_statement", F.col("state").alias("state_before"), "tactic", after.alias("state_after"), "result.success", "result.proof_finished",
        count_goals(F.col("state")).alias("num_goals_before"), F.col("result.num_goals").alias("num_goals_after"),
        (F.coalesce(F.length(after) > 0, F.lit(False)) & F.coalesce(after != F.col("state"), F.lit(False))).alias("state_changed"), F.col("result.error").alias("error"),
        F.coalesce(F.col("result.error") == "timeout", F.lit(False)).alias("timeout"), "source", F.lit(backend).alias("model"), F.lit(backend).alias("backend"), "prompt_style",
        utc_now().alias("timestamp"), "step_index", "parent_state_hash", "place",
    )


def next_states(traces: DataFrame, visited: DataFrame) -> DataFrame:
    """Unfinished states that successes led to and that weren't visited, each once (by its first parent's hash)."""
    new = traces.filter("success and not proof_finished and length(state_after) > 0")
    own = [c for c in RENDERED if c in visited.columns]
    given = visited.select("theorem_name", *own).dropDuplicates(["theorem_name"])
    new = new.groupBy("theorem_name", F.col("state_after").alias("state")).agg(F.min("theorem_statement").alias("theorem_statement"), (F.min("step_index") + 1).alias("step_index"), F.min(state_hash(F.col("state_before"))).alias("parent_state_hash"))
    new = new.join(visited.select("theorem_name", "state"), ["theorem_name", "state"], "left_anti").join(given, "theorem_name")
    return new.select("theorem_name", "theorem_statement", *own, "state", "step_index", "parent_state_hash")


def collect(seeds: DataFrame, proposals: DataFrame, depth: int = 1, keep: Callable[[DataFrame], DataFrame] = written, **options) -> DataFrame:
    """Traces of all states up to a depth, level by level: a state is expanded once, at its least depth.

    ``keep`` writes a level before the next one reads it, so no attempt is made twice.
    """
    states = visited = start_states(seeds)
    out = None
    for level in range(depth):
        found = step(states, proposals, **options)
        found = keep(found) if depth > 1 else found
        out = found if out is None else out.union(found)
        if level + 1 < depth:
            states = keep(next_states(found, visited))
            visited = visited.union(states)
    return out


def report(traces: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: attempts, successes, finished, timeouts, the success rate and, if given, the seconds that it took."""
    hits = F.count_if("success")
    told = traces.agg(F.count("*").alias("attempted"), hits.alias("succeeded"), F.count_if("proof_finished").alias("finished"), F.count_if("timeout").alias("timeouts"), F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)).alias("success_rate"))
    return told if seconds is None else told.withColumn("elapsed_s", F.lit(round(seconds, 3)))


def drops(seeds: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: proposals that fell away as copies or for forbidden words."""
    cleaned = prioritised(start_states(seeds), proposals).select(clean_candidates(F.col("candidates")).alias("c"))
    total = lambda c: F.coalesce(F.sum(f"c.{c}"), F.lit(0)).alias(c)
    return cleaned.agg(total("raw"), total("clean"), total("duplicates"), total("forbidden"))
