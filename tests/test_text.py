"""Text functions on the vectors of the fixtures."""

import pytest
from pyspark.sql import functions as F

from sievetrace.functions import text


def one(spark, c, *values):
    """Results of a column function over single values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", c(F.col("v")).alias("out")).orderBy("i").collect()]


def cleaned(spark, raw, blocks=False):
    return one(spark, lambda v: text.clean_candidates(text.split_proposals(v, blocks)), raw)[0]


def test_clean(spark):
    assert cleaned(spark, "1. intro h\n- simp\n* rfl\n2) exact h").kept == ["intro h", "simp", "rfl", "exact h"]
    assert cleaned(spark, "intro h -- explanation\nsimp -- another").kept == ["intro h", "simp"]
    assert cleaned(spark, "\"simp\"\n'rfl'\n`exact h`\n").kept == ["simp", "rfl", "exact h"]
    assert cleaned(spark, "```lean\nrfl\n```\n/- a\nblock -/ trivial").kept == ["rfl", "trivial"]
    blocks = cleaned(spark, "1. intro h\n  exact h\n\nconstructor\n  rfl", True)
    assert blocks.kept == ["intro h\n  exact h", "constructor\n  rfl"]
    assert cleaned(spark, None).kept == [] and cleaned(spark, "").raw == 0


def test_clean_counts(spark):
    df = spark.sql("select array('rfl', 'rfl', 'sorry', 'exact h', null, ' ') as a").select(text.clean_candidates(F.col("a")).alias("c"))
    c = df.first().c
    assert (c.kept, c.raw, c.clean, c.duplicates, c.forbidden) == (["rfl", "exact h"], 6, 4, 1, 1)


def test_forbidden(spark):
    assert one(spark, text.contains_forbidden, "rcases h with sorry_like_name", "  sorry  ", "⊢sorry", "ésorry", "SORRY!", None, "unsafe") == [False, True, True, False, True, False, True]


def test_heads(spark):
    assert one(spark, text.head, "simp only [foo]", "exact?", "  exact h", "(((", "(rfl, x)", "", None, "exact,; h") == ["simp", "exact?", "exact", "", "rfl", "", "", "exact"]
    assert one(spark, text.is_automation, "simp only", "exact? x", "exact h") == [True, True, False]


def test_white_space(spark):
    assert one(spark, text.strip, "\t a \n\u00a0") == ["a"]
    assert one(spark, F.length, "⊢𝕜p") == [3]
    assert one(spark, text.lines, "a\x0bb", "a\r\nb\u2028c") == [["a", "b"], ["a", "b", "c"]]


def test_errors(spark):
    assert one(spark, text.normalise_error, "/tmp/attempt_abc12.lean:2:8: error: Type mismatch\n  q", r"C:\Users\x\attempt_zxc.lean:2:2: error(lean.unknownIdentifier): no", None) == ["error: Type mismatch", "error(lean.unknownIdentifier): no", None]


def test_preview_and_diagnostics(spark):
    assert [len(x) for x in one(spark, text.preview, "x" * 200, "x" * 60)] == [63, 60]
    long = one(spark, lambda v: text.diagnostics(v, F.lit("out")), "e" * 2000)[0]
    assert len(long) == 1500 + len("...[truncated]")
    assert one(spark, lambda v: text.diagnostics(v, F.lit(" out ")), " err ", None, "") == ["err\nout", "out", "out"]


def test_goals(spark):
    assert one(spark, text.count_goals, None, "", "no goals", "⊢ p", "⊢ p\n\n⊢ q", "\n\n") == [0, 0, 0, 1, 2, 1]
    assert one(spark, text.count_turnstiles, "⊢ a\n⊢ b", "x", "", None) == [2, 1, None, None]
    assert one(spark, text.goal_line, "p q : Prop\nh : p ∧ q\n⊢ q", " whole ") == ["⊢ q", "whole"]


def test_render(spark):
    df = spark.sql("select 'by T, T' as t, array('import A', ' ') as i, array() as none")
    r = df.select(text.render_template(F.col("t"), F.lit("T"), F.lit("rfl"), F.col("i")).alias("a"), text.render_template(F.col("t"), F.lit("T"), F.lit("rfl"), F.lit(None).cast("array<string>")).alias("b")).first()
    assert r.a == "import A\n\nby rfl, rfl\n" and r.b == "by rfl, rfl\n"
    assert one(spark, text.backend_name, " Lean_CLI ") == ["lean-cli"]


@pytest.mark.parametrize("style", [None, "conservative", "unknown"])
def test_prompt(spark, style):
    out = one(spark, lambda v: text.prompt(F.lit("n"), F.lit("s"), v, 4, style), "⊢ p")[0]
    assert out.startswith("Theorem: n\nStatement:\ns\n\nCurrent proof state:\n⊢ p\n\n") and "4" in out
