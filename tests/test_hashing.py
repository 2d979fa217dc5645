"""Keys, splits, grams and arithmetic."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from sievetrace.functions import arithmetic, hashing
from sievetrace.sources import corpus

# Published members of the held-out splits (fixed values).
VAL = "and_comm_pq and_right_qt eq_trans_alpha eq_trans_gamma exists_nat_5 exists_nat_7 false_elim_s iff_mp_qt iff_mp_rs imp_compose_abc imp_id_q nat_lit10 or_inl_ab or_inl_su or_self_p true_const_r".split()
TEST = "and_intro_ab and_left_rs eq_symm_alpha eq_symm_gamma exists_nat_0 iff_intro_ab iff_intro_pr iff_mpr_rs mp_qt nat_add11 nat_lit5 or_inl_pq or_inl_qt or_inl_rs or_inr_ab or_self_q".split()


def test_keys(spark):
    r = spark.range(1).select(hashing.nul_ended_key(F.lit("a"), F.lit("b")).alias("e"), hashing.nul_joined_key(F.lit("a"), F.lit("b")).alias("j"), hashing.state_hash(F.lit("s")).alias("s")).first()
    assert r.e == hashlib.sha256(b"a\0b\0").hexdigest() and r.j == hashlib.sha256(b"a\0b").hexdigest() and r.s == hashlib.sha1(b"s").hexdigest()[:16]


def test_published_split(spark):
    names = [e["name"] for e in corpus.entries()]
    got = {r.name: r.split for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", hashing.hash_split(F.col("name")).alias("split")).collect()}
    assert len(got) == 134 and got == {n: "val" if n in VAL else "test" if n in TEST else "train" for n in names}


def test_split_fractions(spark):
    names = spark.range(400).select(F.concat(F.lit("t"), "id").alias("n"))
    got = {r.n: r.s for r in names.select("n", hashing.hash_split(F.col("n"), 123, 0.6, 0.2, 0.2).alias("s")).collect()}
    again = {r.n: r.s for r in names.limit(10).select("n", hashing.hash_split(F.col("n"), 123, 3 * 0.2, 0.2, 0.2).alias("s")).collect()}
    assert set(got.values()) == {"train", "val", "test"} and all(got[n] == s for n, s in again.items())
    for bad in ((1.2, 0, 0), (0, 0, 0), (-0.1, 0.5, 0.6)):
        with pytest.raises(ValueError):
            hashing.check_fractions(*bad)


def test_grams(spark):
    r = spark.range(1).select(hashing.padded_trigrams(F.lit("⊢ P")).alias("t"), hashing.bounded_ngrams(F.lit("ab")).alias("b"), hashing.bucket("F", F.lit("ab")).alias("c"), hashing.ngrams(F.lit("a"), 3).alias("none")).first()
    assert r.t == ["  ⊢", " ⊢ ", "⊢ p", " p ", "p  "]
    assert r.b == ["^a", "ab", "b$", "^ab", "ab$", "^ab$"] and r.none == []
    assert r.c == zlib.crc32(b"F\x1fab") % 8192


def test_vectors(spark):
    df = spark.sql("select array(1.0D, 2.0D, 3.0D) a, array(0.0D, 0.0D, 0.0D) z")
    a, z = F.col("a"), F.col("z")
    r = df.select(
        arithmetic.cosine(a, a).alias("same"), arithmetic.cosine(a, z).alias("none"), arithmetic.distance(a, z).alias("far"), arithmetic.softmax(a).alias("soft"), arithmetic.argmax(a).alias("best"), arithmetic.argmax(z).alias("first"),
        arithmetic.interpolate(z, a, 0.5).alias("half"), arithmetic.interpolate(z, a, 0.0).alias("start"), arithmetic.euler(z, lambda x, t: arithmetic.velocity(z, a), 5).alias("end"),
        arithmetic.unstandardise(arithmetic.standardise(a, z, a), z, a).alias("back"), arithmetic.ratio(F.lit(1), F.lit(0)).alias("zero"), arithmetic.time_embedding(F.lit(0.5), 7).alias("odd"), arithmetic.time_embedding(F.lit(0.5), 32).alias("even"),
        arithmetic.beam_score(F.lit(-4.0), F.lit(5), 0.5).alias("score"), arithmetic.beam_score(F.lit(-4.0), F.lit(1), 0.5).alias("one"),
    ).first()
    assert r.same == pytest.approx(1) and r.none == 0 and r.far == pytest.approx(math.sqrt(14)) and sum(r.soft) == pytest.approx(1) and (r.best, r.first) == (2, 0)
    assert r.half == [0.5, 1.0, 1.5] and r.start == [0, 0, 0] and r.end == pytest.approx([1, 2, 3]) and r.back == [1, 2, 3] and r.zero == 0
    assert len(r.odd) == 7 and r.odd[-1] == 0 and len(r.even) == 32 and r.score == -2 and r.one == -4
    with pytest.raises(ValueError):
        arithmetic.euler(a, lambda x, t: x, 0)
