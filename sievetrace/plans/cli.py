"""Command line: collect, summarise, audit, build and evaluate over line-delimited JSON.

Exit codes: 0 done, 1 a backend failed, 2 bad input.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetrace.operators import audit, collect, dataset, evaluate, metrics, rank, summary, verify
from sievetrace.operators.lookup import verified_sets, with_verified
from sievetrace.sources import corpus, jsonl, proposers
from sievetrace.sources.working import written

#: Rows of a report that are shown; all are in the files that a command writes.
MOST_SHOWN = 100


def _show(df: DataFrame, title: str = "", human: bool = False) -> None:
    """Rows as JSON lines, or as a table of names and values for readers."""
    rows = df.limit(MOST_SHOWN + 1).collect()
    if human:
        print(f"== {title or 'report'}")
    for r in rows[:MOST_SHOWN]:
        if human and len(rows) == 1:
            width = max(map(len, df.columns))
            print("\n".join(f"  {c:<{width}}  {_value(v)}" for c, v in r.asDict().items()))
        elif human:
            print("  " + "  ".join(f"{c}={_value(v)}" for c, v in r.asDict().items()))
        else:
            print(json.dumps(r.asDict(True), default=str, ensure_ascii=False))
    if len(rows) > MOST_SHOWN:
        print(json.dumps({"more": f"only the first {MOST_SHOWN} rows are shown"}))


def _value(v) -> str:
    return f"{v:.4g}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)


def _warn(rows: DataFrame) -> None:
    """Say which lines of trace files were skipped."""
    for r in jsonl.malformed(rows).orderBy(*jsonl.ORDER).limit(MOST_SHOWN).collect():
        print(json.dumps({"file": r._file_ord, "warning": r.warning}), file=sys.stderr)


def _traces(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = jsonl.traces(spark, jsonl.expand(spark, paths))
    _warn(rows)
    return rows


def _collect(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.monotonic()
    own = proposers.Settings.from_env(path=a.env)
    backend = a.backend or own.backend
    seeds = jsonl.seeds(spark, a.seeds, a.max_seeds)
    if a.candidates:
        offers = jsonl.candidates(spark, a.candidates)
    else:
        offers = proposers.source("mock")(collect.start_states(seeds), a.num_candidates or 8)
    command = a.command or own.command
    judge = verify.attempts(backend, **({"command": command.split(), "timeout_s": a.timeout or own.timeout_s} if backend not in ("mock", "leandojo") else {}))
    traces = collect.collect(seeds, offers, a.depth, most=a.num_candidates, judge=judge, backend=backend)
    traces = written(traces) if a.dry_run else traces
    if not a.dry_run:
        jsonl.write_routed(traces, a.out)
        traces = jsonl.read_routed(spark, a.out)
    _show(collect.drops(seeds, offers), "proposals", a.human)
    _show(collect.report(traces, time.monotonic() - began), "collection", a.human)


def _summarise(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _traces(spark, a.traces)
    _show(summary.summarise(rows), "summary", a.human)
    _show(summary.top_heads(rows), "heads of successful actions", a.human)


def _audit(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _traces(spark, a.traces)
    by = audit.by_theorem(rows)
    reports = {
        "theorems by success rate": by.orderBy("success_rate", F.desc("attempts")).limit(a.top), "theorems without success": audit.never(by).orderBy("name").limit(a.top),
        "heads": audit.by_head(rows).orderBy(F.desc("attempts"), "name").limit(a.top), "errors": audit.top_errors(rows, a.top),
    }
    if a.seeds and a.splits:
        families, splits = jsonl.families(jsonl.seeds(spark, a.seeds)), jsonl.splits(spark, a.splits)
        reports |= {"families": audit.by_family(rows, families, splits).orderBy("family"), "coverage": audit.coverage(families, splits).orderBy("kind", "subject")}
    for title, df in reports.items():
        _show(df, title, a.human)


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    backends = (*a.backends, "mock") if a.allow_mock and "mock" not in a.backends else tuple(a.backends)
    f = dataset.Filters(backends, a.allow_mock, a.include_failed, not a.exclude_finished, a.max_tactic, a.max_state, not a.keep_copies)
    s = dataset.Splits(*a.fractions, a.seed)
    found = dataset.classify(jsonl.traces(spark, jsonl.expand(spark, a.traces)), f, s)
    dataset.write(found, a.out, s)
    _show(dataset.summary(found))


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(f"{a.dataset}/next_tactic")
    if rows.isEmpty():
        raise ValueError("the dataset is empty")
    every = dataset.examples(rows)
    train, held = dataset.train_and_eval(every, a.split)
    train = train.withColumn("train_id", F.col("_line_no") + F.col("_file_ord").cast("long") * (1 << 40))
    held = held.withColumn("row_id", F.col("_line_no") + F.col("_file_ord").cast("long") * (1 << 40)).withColumnRenamed("tactic", "ground_truth_tactic")
    ranker = {"majority": rank.Majority, "retrieval": rank.Retrieval, "log-linear": rank.LogLinear}[a.ranker]()
    found = written(ranker.fit(train).transform(held, metrics.top_k(a.top_k)))
    if hasattr(ranker, "trained"):
        ranker.save(f"{a.out}/model")
    if a.command:
        verdicts = evaluate.example_checker(verify.Subprocess(a.command.split(), a.timeout).check)
        seeds = jsonl.seeds(spark, a.seeds) if a.seeds else None
        families, actions = (jsonl.families(seeds), jsonl.families_of_actions(seeds)) if seeds is not None else (None, None)
        done = evaluate.evaluate(found, every, verdicts, a.memory or f"{a.out}/verdicts", families=families, actions=actions)
        done.predictions.write.mode("overwrite").json(f"{a.out}/predictions")
        done.failures.write.mode("overwrite").json(f"{a.out}/failures")
        told = done.metrics
        for name, df in (("families", done.families), ("confusion", done.confused)):
            if df is not None:
                jsonl.write(df, f"{a.out}/{name}")
                _show(spark.read.json(f"{a.out}/{name}"), name, a.human)
    else:
        flagged = metrics.flags(with_verified(found, verified_sets(every)))
        flagged.write.mode("overwrite").json(f"{a.out}/predictions")
        told = metrics.metrics(flagged)
    told = written(told)
    jsonl.to_json(told).coalesce(1).write.mode("overwrite").text(f"{a.out}/metrics")
    _show(told, "metrics", a.human)


def _corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, df in (("seeds", corpus.seeds(spark)), ("candidates", corpus.proposals(spark))):
        jsonl.write(df, f"{a.out}/{name}", order=jsonl.ORDER)


def parser() -> argparse.ArgumentParser:
    """The commands and their options."""
    top = argparse.ArgumentParser(prog="sievetrace", description=__doc__)
    sub = top.add_subparsers(required=True)

    def add(name, run):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--human", action="store_true", help="reports for readers instead of JSON lines")
        return p.add_argument

    o = add("collect", _collect)
    o("--seeds", required=True), o("--candidates", help="a file of proposals; the rule-based ones without it"), o("--out", required=True), o("--max-seeds", type=int), o("--num-candidates", type=int), o("--depth", type=int, default=1), o("--dry-run", action="store_true")
    o("--backend"), o("--command", help="checks a file whose name follows"), o("--timeout", type=float), o("--env", default=".env", help="a file of settings")
    add("summarise", _summarise)("traces", nargs="+")
    o = add("audit", _audit)
    o("traces", nargs="+"), o("--top", type=int, default=10), o("--seeds"), o("--splits")
    o = add("build", _build)
    o("traces", nargs="+"), o("--out", required=True), o("--backends", nargs="+", default=["lean-cli", "leandojo"]), o("--seed", type=int, default=42), o("--fractions", type=float, nargs=3, default=[0.8, 0.1, 0.1])
    o("--max-tactic", type=int), o("--max-state", type=int), [o(f"--{x}", action="store_true") for x in ("allow-mock", "include-failed", "exclude-finished", "keep-copies")]
    o = add("evaluate", _evaluate)
    o("dataset"), o("--out", required=True), o("--split", default="val"), o("--ranker", default="retrieval", choices=["majority", "retrieval", "log-linear"]), o("--top-k", type=int, default=5)
    o("--command", help="checks a file whose name follows; verdicts are remembered"), o("--timeout", type=float, default=30.0), o("--memory", help="the folder of verdicts"), o("--seeds", help="for rates by family")
    add("corpus", _corpus)("--out", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sievetrace").getOrCreate()
    try:
        args.run(spark, args)
    except (FileNotFoundError, ValueError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    except RuntimeError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
