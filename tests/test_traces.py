"""Scans, datasets, audits, summaries and collection over small record files."""

import json

import pytest
from pyspark.sql import functions as F

from sievetrace.operators import audit, collect, dataset, lookup, summary, verify
from sievetrace.sources import jsonl, proposers


def trace(**own):
    base = {"theorem_name": "alpha", "theorem_statement": "s", "state_before": "⊢ p", "tactic": "rfl", "state_after": "<verified by lean-cli>", "success": True, "proof_finished": True, "backend": "lean-cli"}
    return base | own


def written(tmp_path, name, rows, head="# header\n\n"):
    path = tmp_path / name
    path.write_text(head + "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_scan(spark, tmp_path):
    path = written(tmp_path, "a.jsonl", ['{"theorem_name": "x"}', "   ", "{broken", '  {"theorem_name": "y", "extra": 1}  '])
    rows = jsonl.records(spark, [path], "theorem_name string").orderBy("_line_no").collect()
    assert [(r.theorem_name, r._line_no, r._corrupt is None) for r in rows] == [("x", 3, True), (None, 5, False), ("y", 6, True)]
    assert jsonl.records(spark, [str(tmp_path / "none.jsonl")], "theorem_name string").count() == 0
    with pytest.raises(FileNotFoundError):
        jsonl.expand(spark, [str(tmp_path / "*.none")])
    second = written(tmp_path, "b.jsonl", ['{"theorem_name": "z"}'])
    both = jsonl.records(spark, [second, path], "theorem_name string").orderBy(*jsonl.ORDER).collect()
    assert [r.theorem_name for r in both] == ["z", "x", None, "y"] and [r._file_ord for r in both] == [0, 1, 1, 1]


def test_lines_of_split_files(spark, tmp_path):
    paths = [written(tmp_path, f"{k}.jsonl", [{"theorem_name": f"{k}-{n}"} for n in range(3000)]) for k in "ab"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = jsonl.records(spark, paths, "theorem_name string")
        assert rows.rdd.getNumPartitions() > 5
        got = {(r._file_ord, r._line_no): r.theorem_name for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f, n + 3): f"{'ab'[f]}-{n}" for f in range(2) for n in range(3000)}


def test_validity(spark, tmp_path):
    whole = trace()
    path = written(tmp_path, "t.jsonl", [whole, {k: v for k, v in whole.items() if k != "state_after"}, whole | {"state_after": None}, whole | {"unknown_key": 1}, whole | {"tactic": None}, "{no"])
    rows = jsonl.traces(spark, [path]).orderBy("_line_no").collect()
    assert [r._valid for r in rows] == [True, False, True, True, False, False]
    assert rows[0].source == "llm" and rows[0].timeout is False
    seeds = written(tmp_path, "s.jsonl", [{"theorem_name": f"t{k}", "theorem_statement": "p"} for k in range(5)] + [{"theorem_name": "bad", "theorem_statement": "p", "surprise": 1}])
    assert [r.theorem_name for r in jsonl.seeds(spark, seeds, 2).collect()] == ["t0", "t1"]
    assert jsonl.seeds(spark, seeds).count() == 5
    with pytest.raises(ValueError):
        jsonl.seeds(spark, written(tmp_path, "e.jsonl", []))


def classified(spark, tmp_path, rows, *args):
    return dataset.classify(jsonl.traces(spark, [written(tmp_path, "rows.jsonl", rows)]), *args)


def counts(df):
    return {r.reason: r.n for r in dataset.reasons(df).collect()}


def test_reasons(spark, tmp_path):
    rows = [trace(), trace(), trace(backend="mock", tactic="a"), trace(success=False, tactic="b")]
    found = classified(spark, tmp_path, rows)
    assert counts(found) == {"duplicate": 1, "failed_excluded": 1, "backend_filter": 1} and dataset.included(found).count() == 1
    assert dataset.included(classified(spark, tmp_path, rows, dataset.Filters(dedup=False))).count() == 2
    assert counts(classified(spark, tmp_path, [trace(backend="mock")], dataset.Filters(backends=("mock",)))) == {"mock_disallowed": 1}
    row = dataset.included(classified(spark, tmp_path, [trace(backend="mock")], dataset.Filters(backends=("mock",), allow_mock=True))).first()
    assert row.verification_quality == "mock"
    row = dataset.included(classified(spark, tmp_path, [trace(success=False)], dataset.Filters(include_failed=True))).first()
    assert not row.state_after_is_real and row.verification_quality == "theorem-level"
    lost = [trace(backend="leandojo"), trace(backend="leandojo", success=False, state_after=None), trace(backend="odd"), trace(backend=""), trace(tactic="x" * 99), trace(state_before="y" * 99)]
    f = dataset.Filters(include_failed=True, most_tactic_chars=50, most_state_chars=50)
    assert counts(classified(spark, tmp_path, lost, f)) == {"unverifiable_classification": 2, "unknown_backend:odd": 1, "unknown_backend:<empty>": 1, "tactic_too_long": 1, "state_too_long": 1}
    assert counts(classified(spark, tmp_path, [trace()], dataset.Filters(include_finished=False))) == {"proof_finished_excluded": 1}


def test_real_states(spark, tmp_path):
    row = dataset.included(classified(spark, tmp_path, [trace(backend="LeanDojo", state_after="⊢ q")])).first()
    assert row.state_after_is_real and row.verification_quality == "real" and row.backend == "LeanDojo"


def test_split_is_stable_and_partition_free(spark, tmp_path):
    rows = [trace(theorem_name=f"t{k % 9}", tactic=f"x{k % 20}") for k in range(60)]
    traces = jsonl.traces(spark, [written(tmp_path, "r.jsonl", rows)])
    one, many = (dataset.included(dataset.classify(traces.repartition(n))).drop("_file_ord") for n in (1, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and one.count() == 60 - (60 - len({(r["theorem_name"], r["tactic"]) for r in rows}))
    few = {r.theorem_name: r.split for r in dataset.included(dataset.classify(traces.filter("theorem_name = 't1'"))).collect()}
    assert few["t1"] == {r.theorem_name: r.split for r in one.collect()}["t1"]


def test_artifacts(spark, tmp_path):
    found = classified(spark, tmp_path, [trace(), trace(tactic="rfl\n  done", theorem_name="b")])
    for k, df in enumerate((found, found.limit(0))):
        out = str(tmp_path / f"out{k}")
        dataset.write(df, out)
        assert spark.read.json(f"{out}/summary").first().records_included == (2, 0)[k]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out0/plain_tactics").collect()) == ["rfl", "rfl\\n  done"]
    with pytest.raises(ValueError):
        dataset.Splits(train=2.0)


def test_leak(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "test")], "theorem_name string, split string")
    with pytest.raises(ValueError, match="leakage"):
        dataset.train_and_eval(rows, "val")
    train, held = dataset.train_and_eval(rows, "test")
    assert (train.count(), held.count()) == (1, 1)


def test_audit(spark):
    rows = [("alpha", "exact h", True), ("alpha", "exact x", True), ("alpha", "exact y", False), ("beta", "rfl", False), ("beta", None, False), ("", "rfl", True)]
    df = spark.createDataFrame([(n, t, s, "e" if not s else None, 0, k) for k, (n, t, s) in enumerate(rows)], "theorem_name string, tactic string, success boolean, error string, _file_ord int, _line_no bigint")
    assert {r.name: (r.attempts, r.successes) for r in audit.by_theorem(df).collect()} == {"alpha": (3, 2), "beta": (2, 0), "<unknown>": (1, 1)}
    assert [r.name for r in audit.never(audit.by_theorem(df)).collect()] == ["beta"]
    assert {r.name: (r.attempts, r.successes) for r in audit.by_head(df).collect()} == {"exact": (3, 2), "rfl": (2, 1), "<empty>": (1, 0)}
    dup = audit.duplicates(df.withColumn("tactic", F.lit("x" * 200)), ["tactic"], "tactic", 5).collect()
    assert [(r.n, len(r.preview)) for r in dup] == [(6, 63)]
    assert [tuple(r) for r in audit.top_errors(df, 3).collect()] == [("e", 3)]


def test_families(spark):
    traces = spark.createDataFrame([("imp_p", True), ("imp_q", False), ("and_x", True), ("stray", True)], "theorem_name string, success boolean")
    fam = spark.createDataFrame([("imp_p", "imp"), ("imp_q", "imp"), ("and_x", "and")], "theorem_name string, family string")
    spl = spark.createDataFrame([("imp_p", "train"), ("imp_q", "val"), ("and_x", "test")], "theorem_name string, split string")
    got = {r.family: (r.attempts, r.successes, r.theorems, r.train, r.val, r.test) for r in audit.by_family(traces, fam, spl).collect()}
    assert got == {"imp": (2, 1, 2, 1, 1, 0), "and": (1, 1, 1, 0, 0, 1)}
    assert sorted((r.kind, r.subject) for r in audit.coverage(fam, spl).collect()) == [("no_relative", "and_x"), ("only_eval", "and")]


def test_summary(spark, tmp_path):
    rows = [trace(model="mock"), trace(model="mock"), trace(success=False, proof_finished=False, tactic="simp", model="mock", num_goals_before=3), trace(tactic="omega", model="mock", num_goals_before=2)]
    df = jsonl.traces(spark, [written(tmp_path, "t.jsonl", rows)])
    s = summary.summarise(df).first()
    assert (s.total, s.successful, s.duplicates, s.unique_tactics) == (4, 3, 1, 3)
    assert s.avg_goals_before == pytest.approx(2 / 3) and s.success_rate == 0.75 and s.automation_tactic_ratio == pytest.approx(1 / 3)
    assert len(s.warnings) == 3
    empty = summary.summarise(df.limit(0)).first()
    assert empty.success_rate == 0 and empty.warnings == ["no records"]
    assert {r.value: r.n for r in summary.distribution(df, F.col("model")).collect()} == {"mock": 4}
    nulls = spark.sql("select * from values (null), ('a'), (null) as t(v)")
    assert nulls.agg(summary.distinct_with_null(F.col("v"))).first()[0] == 2 and {r.value: r.n for r in summary.distribution(nulls, F.col("v")).collect()} == {"None": 2, "a": 1}


def offers(spark, rows):
    return spark.createDataFrame([(n, s, c, "file", "x", 0, k) for k, (n, s, c) in enumerate(rows)], "theorem_name string, state_before string, candidates array<string>, source string, prompt_style string, _file_ord int, _line_no int")


def asked(spark, *rows):
    return spark.createDataFrame(rows, "theorem_name string, state string")


def test_priority(spark):
    given = offers(spark, [("t", "⊢A", ["a1"]), ("t", "⊢B", ["b1", "b2"]), ("t", "⊢B", ["late"]), ("solo", "⊢x", ["s"]), ("dup", "1", ["d"]), ("dup", "2", ["e"])])
    got = {(r.theorem_name, r.state): r.candidates for r in lookup.prioritised(asked(spark, ("t", "⊢B"), ("solo", "⊢other"), ("dup", "3"), ("none", "x")), given).collect()}
    assert got == {("t", "⊢B"): ["b1", "b2"], ("solo", "⊢other"): ["s"], ("dup", "3"): [], ("none", "x"): []}
    assert lookup.prioritised(asked(spark, ("t", "⊢B")), given, 1).first().candidates == ["b1"]


def test_collect(spark):
    seeds = spark.createDataFrame([("t", "True", None)], "theorem_name string, theorem_statement string, initial_state string")
    traces = collect.collect(seeds, offers(spark, [("t", "⊢ True", ["trivial", "rfl", "exact h", "rfl", "sorry"])]))
    got = {r.tactic: (r.success, r.proof_finished, r.source, r.error) for r in traces.collect()}
    assert got == {"trivial": (True, True, "file", None), "rfl": (True, True, "file", None), "exact h": (False, False, "file", "mock: unknown tactic 'exact'")}
    assert collect.report(traces).first().attempted == 3
    d = collect.drops(seeds, offers(spark, [("t", "⊢ True", ["rfl", "rfl", "sorry"])])).first()
    assert (d.duplicates, d.forbidden) == (1, 1)


def test_collect_deeper(spark):
    seeds = spark.createDataFrame([("t", "p", "⊢ ∀ x, p")], "theorem_name string, theorem_statement string, initial_state string")
    traces = collect.collect(seeds, offers(spark, [("t", "anything", ["intro x", "rfl"])]), depth=3).collect()
    assert sorted((r.step_index, r.state_before) for r in traces if r.tactic == "rfl") == [(0, "⊢ ∀ x, p"), (1, "⊢ x, p"), (2, "⊢ x, p\nh : _")]
    assert all((r.parent_state_hash is None) == (r.step_index == 0) for r in traces)


def test_mock_verdicts(spark):
    rows = [("⊢ ∀ x, p", "intro x"), ("⊢ → q", "intros"), ("h\n⊢ q", "intro y"), ("⊢ p", "simp"), ("⊢ p\n\n⊢ q", "simp only"), ("⊢ p", "omega"), ("⊢ p\n\n⊢ q", "apply h"), ("⊢ p", None)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "i int, s string, t string")
    got = [(r.next_state, r.proof_finished, r.num_goals, r.success) for r in df.select("i", verify.mock_verdict(F.col("s"), F.col("t")).alias("r")).orderBy("i").select("r.*").collect()]
    assert got == [("⊢ x, p", False, 1, True), ("⊢ q", False, 1, True), ("h\n⊢ q\nh : _", False, 1, True), ("no goals", True, 0, True), ("⊢ p", False, 1, True), ("no goals", True, 0, True), (None, False, 2, False), (None, False, 1, False)]


def test_memory(spark, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")
    rows = spark.createDataFrame([("t", "s", "a"), ("t", "s", "a"), ("t", "s", "b"), ("u", "s", "slow")], "theorem_name string, theorem_statement string, tactic string")
    where = str(log)

    def checker(source):
        with open(where, "a") as f:
            f.write(source + "\n")
        return {"success": source == "a", "error": {"a": None, "slow": "timeout"}.get(source, "no"), "elapsed_ms": 1.0}

    def check(df):
        return verify.check_sources(df, "tactic", checker)

    ddl = "cache_key string, theorem_statement string, success boolean, error string, elapsed_ms double"
    none = spark.createDataFrame([], ddl)
    done, new = lookup_all(verify.with_memory(rows, none, check))
    assert sorted(log.read_text().split()) == ["a", "b", "slow"] * 1 and len(done) == 4 and {r.tactic: r.success for r in done} == {"a": True, "b": False, "slow": False}
    log.write_text("")
    known = spark.createDataFrame([(r.cache_key, r.theorem_statement, r.success, r.error, r.elapsed_ms) for r in done if r.error != "timeout"], ddl).dropDuplicates(["cache_key"])
    lookup_all(verify.with_memory(rows, known, check))
    assert log.read_text().split() == ["slow"]  # a timeout isn't remembered


def lookup_all(pair):
    return pair[0].collect(), pair[1]


def test_subprocess_and_sessions(spark):
    assert verify.Subprocess(["true"]).check("x")["success"] and verify.Subprocess(["false"]).check("x")["error"] == "exit code 1"
    assert "not found" in verify.Subprocess(["no-such-command-here"]).check("x")["error"]
    assert verify.Subprocess(["sh", "-c", "sleep 5"], timeout_s=0.2).check("x")["error"] == "timeout"

    class Echo:
        def start(self, theorem):
            return "⊢"

        def run(self, state, action):
            if action == "crash":
                raise RuntimeError("gone")
            return {"next_state": state + action, "proof_finished": action == "end", "num_goals": 1}

        def close(self):
            pass

    rows = spark.createDataFrame([("t", "s", "x"), ("t", "s", "crash"), ("u", "s", "end")], "theorem_name string, state string, tactic string")
    got = {r.tactic: (r.next_state, r.proof_finished, r.error) for r in verify.run_sessions(rows, Echo).collect()}
    assert got == {"x": ("sx", False, None), "crash": (None, False, "exception: gone"), "end": ("send", True, None)}


def test_backends(spark):
    assert verify.verifier("Mock") is verify.mock_verdict and verify.verifier("lean_cli", command=["true"])("x")["success"]
    with pytest.raises(ValueError):
        verify.verifier("other")
    assert verify.within(0.1, lambda: __import__("time").sleep(3)) == {"error": "timeout", "num_goals": 0}
    seeds = spark.createDataFrame([("by __TACTIC__", None), ("by X", "X"), ("by X", None), (None, None)], "template string, placeholder string")
    assert [r.problem for r in verify.runnable(seeds).collect()] == [None, None, "no placeholder in the template", "no template"]
    assert spark.range(1).select(verify.example_source(F.lit(": True"), F.lit("trivial"))).first()[0] == "example : True := by\n  trivial\n"


def test_proposers(spark):
    states = spark.createDataFrame([("t", "s", "⊢ p"), ("u", "s", "⊢ p")], "theorem_name string, theorem_statement string, state string")
    first, again = ([r.candidates for r in proposers.mock(states, 4).orderBy("theorem_name").collect()] for _ in range(2))
    assert first == again and all(len(c) == 6 and c[-1] == "sorry" and c[4] == c[0] for c in first)
    assert not {"simp", "decide", "omega"} & {a for r in proposers.mock(states, 20, "no_automation").collect() for a in r.candidates}
    none = spark.createDataFrame([], "cache_key string, raw_output string")
    out, new = proposers.hosted(states, lambda request: request[-1], none, "m", 3)
    assert out.count() == 2 and new.count() == 2 and proposers.hosted(states, lambda r: r, new, "m", 3)[1].count() == 0
    assert proposers.source("Mock") is proposers.mock and proposers.source("open_ai".replace("_", "")) is proposers.hosted
    with pytest.raises(ValueError):
        proposers.source("nobody")
    assert proposers.Settings.from_env({"SIEVETRACE_TIMEOUT": "x", "SIEVETRACE_MODEL": "m"}) == proposers.Settings(model="m")


def toy():
    """A backend for workers: ``go`` adds a mark, ``end`` finishes, ``bad`` fails, ``odd`` gives something else."""
    from types import SimpleNamespace as N

    class Toy:
        def start(self, theorem):
            return N(pp="⊢ " + theorem["theorem_name"])

        def run(self, state, action):
            return {"go": N(pp=state.pp + "!"), "end": N(finished=True), "bad": N(error="no"), "odd": N()}[action]

    return lambda: verify.Live(Toy())


def test_live_sessions_over_batches(spark):
    rows = [(n, "⊢ " + n + "!" * k, t, k) for n in "ab" for k, t in enumerate(["go", "go", "bad", "end", "odd"][:5]) if k < 3 or n == "a"] + [("a", "⊢ never seen", "go", 9)]
    rows = [(n, "⊢ a!!" if t in ("end", "odd") else s, t, k) for n, s, t, k in rows]
    df = spark.createDataFrame(rows, "theorem_name string, state string, tactic string, k int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r.theorem_name, r.k): (r.next_state, r.proof_finished, r.num_goals, r.error) for r in verify.run_sessions(df, toy(), order="k").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got["a", 0] == ("⊢ a!", False, 1, None) and got["a", 1] == ("⊢ a!!", False, 1, None)  # the second state was seen in the batch before
    assert got["a", 2] == (None, False, 1, "no") and got["a", 3] == ("no goals", True, 0, None) and got["a", 4][3] == "unexpected result SimpleNamespace"
    assert got["a", 9][3] == "unknown state" and got["b", 1] == ("⊢ b!!", False, 1, None)


def test_memory_that_stays(spark, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "memory")
    log.write_text("")
    where = str(log)

    def checker(source):
        with open(where, "a") as f:
            f.write(source + "\n")
        return {"success": source == "a", "error": {"a": None, "slow": "timeout"}.get(source, "no"), "elapsed_ms": 1.0}

    check = lambda df: verify.check_sources(df, "tactic", checker)
    rows = spark.createDataFrame([("t", "s", "a"), ("t", "s", "a"), ("t", "s", "b"), ("u", "s", "slow")], "theorem_name string, theorem_statement string, tactic string")
    assert verify.remembered(spark, path).count() == 0
    for calls in (["a", "b", "slow"], ["slow"], ["slow"]):  # a timeout isn't remembered
        done = verify.check_all(rows, check, path)
        assert done.count() == 4 and sorted((r.tactic, r.error) for r in done.collect()) == [("a", None), ("a", None), ("b", "no"), ("slow", "timeout")]
        assert sorted(log.read_text().split()) == calls
        log.write_text("")
    assert verify.remembered(spark, path).count() == 2


def test_backends_of_a_collection(spark):
    seeds = spark.createDataFrame([("t", "p", None, "by __TACTIC__", None, ["import A"]), ("u", "p", None, None, None, [])], "theorem_name string, theorem_statement string, initial_state string, template string, placeholder string, imports array<string>")
    given = offers(spark, [(n, "x", ["rfl", "exact h"]) for n in "tu"])
    judge = verify.attempts("Lean_CLI", command=["grep", "-q", "import A.*rfl\\|by rfl"])
    got = {(r.theorem_name, r.tactic): r for r in collect.collect(seeds, given, judge=judge, backend="lean-cli").collect()}
    assert (got["t", "rfl"].success, got["t", "rfl"].proof_finished, got["t", "rfl"].state_after, got["t", "rfl"].backend) == (True, True, "<verified by lean-cli>", "lean-cli")
    assert got["t", "exact h"].error == "exit code 1" and got["u", "rfl"].error == "no template" and not got["u", "rfl"].success
    assert got["t", "rfl"].timestamp.endswith("+00:00")
    live = verify.attempts("leandojo", open_session=toy())
    deep = spark.createDataFrame([("t", "p", "⊢ t")], "theorem_name string, theorem_statement string, initial_state string")
    one = collect.collect(deep, offers(spark, [("t", "x", ["go", "end"])]), judge=live).collect()
    assert {r.tactic: (r.success, r.proof_finished, r.state_after) for r in one} == {"go": (True, False, "⊢ t!"), "end": (True, True, "no goals")}
    with pytest.raises(ValueError):
        verify.attempts("nobody")
    assert verify.cut("x" * 2000) == "x" * 1500 + "...[truncated]"


def test_levels_are_made_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")
    where = str(log)

    def judge(rows):
        def mark(batches):
            for b in batches:
                with open(where, "a") as f:
                    f.write("x" * len(b))
                yield b

        schema = rows.schema
        return verify.by_column()(rows.mapInPandas(mark, schema))

    seeds = spark.createDataFrame([("t", "p", "⊢ ∀ x, p")], "theorem_name string, theorem_statement string, initial_state string")
    traces = collect.collect(seeds, offers(spark, [("t", "any", ["intro x", "rfl"])]), depth=3, judge=judge)
    assert traces.count() == 6 and traces.count() == 6 and len(log.read_text()) == 6


def test_settings_and_sources(spark, tmp_path):
    path = tmp_path / ".env"
    path.write_text("# comment\nexport SIEVETRACE_MODEL='quoted # kept'\nSIEVETRACE_TIMEOUT=7.5 # seconds\nSIEVETRACE_RETRIES=x\nnonsense\n\n")
    got = proposers.Settings.from_env({"SIEVETRACE_BACKEND": "lean-cli"}, str(path))
    assert got == proposers.Settings(model="quoted # kept", backend="lean-cli", timeout_s=7.5)
    assert proposers.Settings.from_env({"SIEVETRACE_TIMEOUT": "1"}, str(path)).timeout_s == 1 and proposers.env_file(str(tmp_path / "none")) == {}
    file = written(tmp_path, "c.jsonl", [{"theorem_name": "t", "state_before": "s", "candidates": ["a"]}, "{broken"])
    assert [r.candidates for r in proposers.source("manual-file")(asked(spark, ("t", "s")), file).collect()] == [["a"]]
    assert [(r._line_no, r.warning) for r in jsonl.malformed(jsonl.records(spark, [file], "theorem_name string")).collect()] == [(4, "line 4: not a JSON object, skipped")]
    left = [2]

    def flaky(request):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return request

    assert proposers.retried(flaky, 2, 0.0)("r") == "r"
    left[0] = 2
    with pytest.raises(OSError):
        proposers.retried(flaky, 1, 0.0)("r")


def test_sinks_count(spark, tmp_path):
    out = str(tmp_path / "lines")
    assert jsonl.append(spark.range(3), out) == 3 and jsonl.append(spark.range(4), out) == 4 and spark.read.text(out).count() == 7
    assert jsonl.write(spark.range(2), out) == 2
    skeleton = jsonl.skeleton(spark.createDataFrame([("t", "s")], "theorem_name string, initial_state string")).first()
    assert (skeleton.theorem_name, skeleton.state_before, skeleton.candidates) == ("t", "s", [])
