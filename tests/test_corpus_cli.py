"""The built-in corpus, and the commands end to end."""

import json
from collections import Counter

from pyspark.sql import functions as F

from sievetrace.functions.hashing import hash_split
from sievetrace.plans import cli
from sievetrace.sources import corpus, jsonl


def test_corpus(spark):
    rows = corpus.entries()
    sizes = Counter(e["family"] for e in rows)
    assert len(rows) == 134 and len(sizes) == 21 and min(sizes.values()) >= 5
    assert all(e["correct"] and set(e["correct"]) <= set(e["candidates"]) for e in rows)
    seeds = corpus.seeds(spark)
    assert {r.split: r["count"] for r in seeds.select(hash_split(F.col("theorem_name")).alias("split")).groupBy("split").count().collect()} == {"train": 102, "val": 16, "test": 16}
    one = seeds.filter("theorem_name = 'imp_compose_pqr'").first()
    assert one.theorem_statement == "(p q r : Prop) (h1 : p → q) (h2 : q → r) : p → r" and one.initial_state.endswith("h2 : q → r\n⊢ p → r")
    fams = {r.theorem_name: r.family for r in jsonl.families(seeds).collect()}
    assert fams["nat_succ"] == "nat_rfl" and len(fams) == 134
    actions = {r.tactic: r.families for r in jsonl.families_of_actions(seeds).collect()}
    assert actions["rfl"] == ["eq_refl", "nat_rfl"] and actions["exact h.1"] == ["and_elim_left"]


def test_commands(spark, tmp_path, capsys):
    out = str(tmp_path / "corpus")
    assert cli.main(["corpus", "--out", out], spark) == 0
    traces = str(tmp_path / "traces")
    assert cli.main(["collect", "--seeds", f"{out}/seeds/part-*", "--candidates", f"{out}/candidates/part-*", "--out", traces], spark) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["attempted"] == sum(len(e["candidates"]) for e in corpus.entries())
    rows = jsonl.read_routed(spark, traces)
    jsonl.write(rows.withColumn("backend", F.lit("lean-cli")), str(tmp_path / "lines"))
    lines = f"{tmp_path}/lines/part-*"
    assert cli.main(["summarise", lines], spark) == 0 and cli.main(["audit", lines], spark) == 0
    built = str(tmp_path / "built")
    assert cli.main(["build", lines, "--out", built], spark) == 0
    capsys.readouterr()
    for ranker in ("majority", "retrieval"):
        assert cli.main(["evaluate", built, "--out", str(tmp_path / ranker), "--ranker", ranker], spark) == 0
        m = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert m["n"] > 0 and m["oracle_coverage"] == 1.0 and "pass_at_1" not in m
    out_dir = tmp_path / "checked"
    for _ in range(2):  # the second time from memory
        assert cli.main(["evaluate", built, "--out", str(out_dir), "--command", "grep -q exact", "--seeds", f"{out}/seeds/part-*", "--memory", str(tmp_path / "memory")], spark) == 0
        m = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert m["checks"] >= m["verified_checks"] > 0 and 0 < m["pass_at_1"] <= m["pass_at_5"] <= 1
    said = {(r.theorem_name, r.tactic) for r in spark.read.json(str(out_dir / "failures")).collect()}
    assert said and all("exact" not in t for _, t in said)
    assert spark.read.json(str(out_dir / "families")).count() > 3 and spark.read.json(str(out_dir / "confusion")).count() > 0
    assert cli.main(["summarise", lines, "--human"], spark) == 0 and "== summary" in capsys.readouterr().out
    (tmp_path / "bad.jsonl").write_text("{no\n")
    assert cli.main(["summarise", str(tmp_path / "bad.jsonl")], spark) == 0 and "line 1" in capsys.readouterr().err
    assert cli.main(["collect", "--seeds", f"{out}/seeds/part-*", "--out", str(tmp_path / "x"), "--backend", "lean-cli", "--command", "grep -q rfl", "--max-seeds", "3", "--num-candidates", "4", "--dry-run"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["attempted"] == 12
    assert cli.main(["summarise", str(tmp_path / "none*")], spark) == 2
    assert cli.main(["collect", "--seeds", str(tmp_path / "no"), "--candidates", "x", "--out", traces], spark) == 2
