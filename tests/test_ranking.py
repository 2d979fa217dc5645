"""Rankers, metrics and generation parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetrace.operators import generate, lookup, metrics, rank

EXAMPLES = "train_id bigint, theorem_name string, theorem_statement string, state_before string, tactic string"


def test_majority(spark):
    df = spark.createDataFrame([(t,) for t in ["rfl"] * 3 + ["exact h"] * 2 + ["trivial"] * 2 + ["omega"]], "tactic string")
    assert [r.tactic for r in rank.majority(df, 4).collect()] == ["rfl", "exact h", "trivial", "omega"] == ["rfl", "exact h", "trivial", "omega"]
    assert rank.Majority().fit(df).transform(spark.range(1), 2).first().predictions == ["rfl", "exact h"]


def test_retrieval(spark):
    train = spark.createDataFrame([(0, "a", "s", "zzz qqq", "t0"), (1, "b", "s", "goal one", "t1"), (2, "c", "s", "goal one x", "t2"), (3, "d", "s", "goal one", "t1"), (4, "e", "s", "www", "t4")], EXAMPLES)
    rows = spark.createDataFrame([(9, "s", "goal one"), (8, "日", "本")], "row_id bigint, theorem_statement string, state_before string")
    got = {r.row_id: r for r in rank.Retrieval().fit(train).transform(rows, 3).collect()}
    assert got[9].predictions[:2] == ["t1", "t2"] and got[9].source_theorem[0] == "b" and got[9].score[0] == pytest.approx(1)
    assert got[8].predictions == ["t0", "t1", "t2"]  # nothing in common but padding: training order


def test_loglinear(spark):
    rows = [(k, f"n{k}", "s", f"⊢ {'and' if k % 2 else 'or'} {k}", "split" if k % 2 else "left") for k in range(30)]
    train = spark.createDataFrame(rows, EXAMPLES)
    asked = spark.createDataFrame([(1, "s", "⊢ and 99"), (2, "s", "⊢ or 77")], "row_id bigint, theorem_statement string, state_before string")
    got = {r.row_id: r.predictions for r in rank.LogLinear(iterations=20, buckets=256).fit(train).transform(asked, 2).collect()}
    assert got == {1: ["split", "left"], 2: ["left", "split"]}


def test_loglinear_saved(spark, tmp_path):
    train = spark.createDataFrame([(k, "n", "s", f"⊢ {'and' if k % 2 else 'or'}", "split" if k % 2 else "left") for k in range(8)], EXAMPLES)
    rank.LogLinear(iterations=5, buckets=64).fit(train).save(str(tmp_path / "m"))
    asked = spark.createDataFrame([(1, "s", "⊢ and")], "row_id bigint, theorem_statement string, state_before string")
    assert rank.LogLinear(buckets=64).load(str(tmp_path / "m")).transform(asked, 1).first().predictions == ["split"]
    told = rank.LogLinear(buckets=64).load(str(tmp_path / "m")).trained.first()
    assert (told.classes, told.buckets, told.max_iterations, told.train_top1) == (2, 64, 5, 1.0)


def test_model_artifacts(spark, tmp_path):
    chars = generate.vocabulary(spark.createDataFrame([("ba",)], "t string"), "t")
    stats = generate.latent_statistics(spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>"), "v")
    generate.save(str(tmp_path / "m"), chars, stats)
    ids, latents = generate.load(spark, str(tmp_path / "m"))
    assert ids == {"a": 4, "b": 5} and latents[0][0] == 2.0 and latents[1] == (5.0, 0.001)
    generate.save(str(tmp_path / "n"), chars)
    assert generate.load(spark, str(tmp_path / "n"))[1] == []


def test_evaluation(spark, tmp_path):
    from sievetrace.operators import evaluate

    rows = spark.createDataFrame([(1, "t", "p", "s", "a", ["x", "a", "x"]), (2, "t", "p", "s2", "b", ["x"]), (3, "u", "q", "s", "c", [])], "row_id bigint, theorem_name string, theorem_statement string, state_before string, ground_truth_tactic string, predictions array<string>")
    every = spark.createDataFrame([("t", "s", "a"), ("u", "s", "c")], "theorem_name string, state_before string, tactic string")
    fam = spark.createDataFrame([("t", "eq_refl"), ("u", "other")], "theorem_name string, family string")
    acts = spark.createDataFrame([("x", ["eq_symm"])], "tactic string, families array<string>")
    check = evaluate.example_checker(lambda source: {"success": ":= by\n  a\n" in source, "error": None if "  a" in source else "no", "elapsed_ms": 0.0})
    done = evaluate.evaluate(rows, every, check, str(tmp_path / "memory"), families=fam, actions=acts)
    m = done.metrics.first()
    assert (m.n, m.checks, m.verified_checks) == (3, 3, 1) and m.pass_at_1 == 0 and m.pass_at_3 == pytest.approx(1 / 3) and m.any_verified_at_3 == pytest.approx(1 / 3)
    assert sorted((r.row_id, r.tactic) for r in done.failures.collect()) == [(1, "x"), (2, "x")]
    assert {r.family: r.pass_at_3 for r in done.families.collect()} == {"eq_refl": 0.5, "other": 0.0}
    assert [(r.true_family, r.predicted_family, r.n) for r in done.confused.collect()] == [("eq_refl", "eq_symm", 2)]
    off = evaluate.offline(rows).first()
    assert (off.n, off.unique_predictions, off.top1_exact) == (3, 2, 0.0) and off.top5_contains == pytest.approx(1 / 3) and off.avg_distinct == 1.0


def test_tfidf(spark):
    corpus = spark.createDataFrame([(0, "exact h"), (1, "intro x"), (2, "exact y")], "item int, t string")
    rows = rank.word_gram_rows(corpus, "item", F.col("t"))
    assert {r.gram for r in rows.filter("item = 0").collect()} == {" e", "ex", "xa", "ac", "ct", "t ", " ex", "exa", "xac", "act", "ct ", " exa", "exac", "xact", "act ", " h", "h ", " h "}
    q = rank.word_gram_rows(spark.createDataFrame([(9, "exact h")], "q int, t string"), "q", F.col("t"))
    got = {r.item: r.score for r in rank.gram_cosine(rank.tfidf(q, rows, "q"), rank.tfidf(rows, rows, "item"), "q", "item").collect()}
    assert got[0] == pytest.approx(1) and 0 < got[2] < 1 and 1 not in got


def test_failures(spark):
    rows = spark.createDataFrame([(1, "t", ["a", "b", "a"]), (2, "t", ["b"])], "row_id int, theorem_name string, predictions array<string>")
    verdicts = spark.createDataFrame([("t", "a", "no"), ("t", "b", None)], "theorem_name string, tactic string, error string")
    assert [(r.row_id, r.tactic) for r in metrics.failures(rows, verdicts).collect()] == [(1, "a")]


def test_nearest(spark):
    lib = spark.createDataFrame([(0, "zero", [0.0, 0.0]), (1, "ten", [10.0, 10.0]), (2, "neg", [-5.0, -5.0]), (3, "zero again", [0.0, 0.0])], "i int, text string, v array<double>")
    asked = spark.createDataFrame([(1, [0.1, -0.1]), (2, [-4.0, -6.0])], "q int, z array<double>")
    assert {r.q: r.text for r in rank.nearest(asked, lib, "z", "v", "q", "i", "text").collect()} == {1: "zero", 2: "neg"}
    assert generate.snap(np.array([[0.1, -0.1], [-4, -6]]), np.array([[0, 0], [10, 10], [-5, -5]]), ["zero", "ten", "neg"]) == ["zero", "neg"] and generate.snap(np.zeros((1, 2)), np.zeros((0, 2)), []) == [""]


def flagged(spark, rows):
    df = spark.createDataFrame(rows, "theorem_name string, predictions array<string>, ground_truth_tactic string, verified array<string>, accepted array<string>")
    return metrics.flags(df, accepted="accepted")


def test_flags(spark):
    rows = [("a", ["wrong", "still_wrong", "exact h"], "exact h", ["exact h", "assumption"], ["exact h"]), ("b", [], "x", ["x"], ["x"]), ("c", ["w", "w", "w", "v", "ok"], "ok", [], ["ok"])]
    got = {r.theorem_name: r for r in flagged(spark, rows).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.any_1, a.any_3, a.pass_1, a.pass_3, a.top1_exact) == (False, True, False, True, False)
    assert not any((b.any_1, b.any_5, b.pass_5, b.top1_exact))
    assert (c.any_5, c.pass_3) == (False, True)  # pass counts distinct predictions, any the raw ones
    m = metrics.metrics(flagged(spark, rows)).first()
    assert (m.n, m.small_sample) == (3, True) and m.oracle_coverage == pytest.approx(2 / 3) and m.pass_at_3 == pytest.approx(2 / 3)
    empty = metrics.metrics(flagged(spark, rows).limit(0)).first()
    assert (empty.n, empty.top1_exact_rate, empty.small_sample) == (0, 0.0, True)
    assert "pass_at_1" not in metrics.metrics(flagged(spark, rows).drop("pass_1", "pass_3", "pass_5")).columns
    assert metrics.top_k(2) == 5


def test_families_and_confusion(spark):
    rows = [("and_left_pq", ["x"], "x", ["x"], ["x"]), ("and_left_ab", ["y"], "x", ["x"], ["x"]), ("or_inl_pq", ["z"], "z", ["z"], ["z"])]
    fam = spark.createDataFrame([("and_left_pq", "and_elim_left"), ("and_left_ab", "and_elim_left"), ("or_inl_pq", "or_intro_left")], "theorem_name string, family string")
    got = {r.family: (r.n_rows, r.pass_at_1) for r in metrics.by_family(flagged(spark, rows), fam).collect()}
    assert got == {"and_elim_left": (2, 0.5), "or_intro_left": (1, 1.0)}
    actions = spark.createDataFrame([("h.1", ["and_elim_left"]), ("h.2", ["and_elim_right"]), ("rfl", ["eq_refl", "nat_rfl"])], "tactic string, families array<string>")
    pairs = spark.createDataFrame([("and_elim_left", "h.1"), ("and_elim_left", "h.2"), ("and_elim_right", "rfl"), ("other", "h.1")], "true_family string, top1 string")
    confused = metrics.confusion(lookup.unique_family(pairs, actions, "top1"))
    assert sorted((r.true_family, r.predicted_family, r.n) for r in confused.collect()) == [("and_elim_left", "and_elim_left", 1), ("and_elim_left", "and_elim_right", 1), ("and_elim_right", "<ambiguous/other>", 1)]
    assert [(r.group, r.accuracy) for r in metrics.group_accuracy(confused).collect()] == [("and_elim", pytest.approx(1 / 3))]


def test_generation(spark):
    rows = spark.createDataFrame([(["a", "n", "a"], ["n"]), ([""], [])], "predictions array<string>, accepted array<string>")
    g = metrics.generation(rows, spark.createDataFrame([("a",)], "tactic string")).first()
    assert (g.novel_verified, g.rows_by_novel, g.avg_distinct, g.empty_rate) == (1, 1, 1.5, 0.5) and g.novel_rate == 0.5 and g.invalid_rate == 0.75
    log = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.5, 1.0), (3, 0.5, 1.0)], "epoch int, val_exact double, val_loss double")
    assert metrics.first_best(log).first().epoch == 2


class Toy:
    """Prefers 'a' twice, then the end."""

    def start(self, prompt):
        return np.zeros(1)

    def step(self, states, last):
        p = np.full((len(states), 6), -9.0)
        p[:, 4] = np.where(states[:, 0] < 2, -0.1, -5.0)
        p[:, 5] = -2.0
        p[:, generate.END] = np.where(states[:, 0] < 2, -4.0, -0.1)
        return states + 1, p


def test_decoding():
    chars = {4: "a", 5: "b"}
    assert generate.greedy(Toy(), "", chars, 5) == "aa"
    found = generate.beam(Toy(), "", chars, 3, 6)
    assert found[0][0] == "aa" and len({t for t, _ in found}) == len(found) <= 3
    assert generate.decode([0, 1, 4, 3, 5], chars) == "ab" and generate.decode([4, 2, 5], chars) == "a"
    assert generate.encode("ab?", {"a": 4, "b": 5}, target=True) == [1, 4, 5, 3, 2] and generate.encode("abab", {"a": 4, "b": 5}, 4, True) == [1, 4, 5, 2]
    again = [generate.sample("p", lambda z, t: -z, lambda z: ["x" if v > 0 else "y" for v in z[:, 0]], 16, 2, 4) for _ in range(2)]
    assert again[0] == again[1] and sum(n for _, n in again[0]) == 16


def test_vocabulary_and_latents(spark):
    got = {r.char: r.id for r in generate.vocabulary(spark.createDataFrame([("ba",), ("ac",)], "t string"), "t").collect()}
    assert got == {"a": 4, "b": 5, "c": 6}
    stats = generate.latent_statistics(spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>"), "v").orderBy("dim").collect()
    assert [(r.mean, round(r.std, 6)) for r in stats] == [(2.0, 1.414214), (5.0, 0.001)]
    ranked = generate.by_frequency(spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "k int, t string"), "k", "t")
    assert [(r.t, r["rank"]) for r in ranked.orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    model = generate.predict(spark.createDataFrame([("ab",)], "p string"), "p", lambda: lambda prompt: [prompt[::-1]])
    assert model.first().predictions == ["ba"]
    assert [(r.idx, r.text) for r in generate.library(spark.createDataFrame([("b",), ("a",), ("b",)], "t string"), "t").orderBy("idx").collect()] == [(0, "a"), (1, "b")]
    assert tuple(generate.truncated(spark.createDataFrame([("abc",), ("a",)], "t string"), "t", 2).first()) == (1, 2)


def test_loglinear_query_uses_the_defaults(spark, monkeypatch):
    from sievetrace.plans import registry

    made = []
    own = rank.LogLinear.__init__

    def record(self, *args, **options):
        own(self, *args, **options)
        made.append((self.iterations, self.buckets))
        raise InterruptedError

    monkeypatch.setattr(rank.LogLinear, "__init__", record)
    with pytest.raises(InterruptedError):
        registry.queries()["loglinear_fit"](spark, "/root/testdata/sf0.001")
    assert made == [(50, rank.BUCKETS)]
