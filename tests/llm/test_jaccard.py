"""N-gram Jaccard join against a brute-force version."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("sievetrace.llm")
from pyspark.sql import functions as F

from sievetrace.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Sorted (doc_id, class_id, n_links); the classes by repeated relabelling."""
    sets = []
    for i, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and i is not None else frozenset())
    n = len(rows)
    near = [[b for b in range(n) if b != a and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in range(n)]
    label = [i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for a in range(n):
            for b in near[a]:
                if label[b] < label[a]:
                    label[a], moved = label[b], True
    return sorted(((i, label[k], len(near[k])) for k, (i, _) in enumerate(rows)), key=str)


def planted(n_hot=40):
    rng = random.Random(4)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]
    rows, ids = [], iter(rng.sample(range(10**6), 1000))
    common = words(30)
    for _ in range(30):
        base = words(rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = words(1)[0]
            rows.append((next(ids), rng.choice(" \n").join(w)))
    hot = words(150)
    for k in range(n_hot):
        w = list(hot)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = words(1)[0]
        rows.append((next(ids), " ".join(w)))
        rows.append((next(ids), " ".join(words(100) + common)))
    rows += [(next(ids), rows[0][1]) for _ in range(5)] + [(next(ids), " ".join(hot))] * 2
    rows += [(next(ids), t) for t in ("one", "one", "one two", "", " ", None, "one two three four five six", "one two three four five six seven")]
    return rows + [(None, rows[0][1]), (None, None)]


@pytest.mark.parametrize("block", [None, 16])
def test_planted(spark, monkeypatch, block):
    if block:  # plan literals on the driver: hot groups are dealt in blocks
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
        monkeypatch.setattr(jaccard, "VERIFY_BLOCK", block)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("node", F.lit("x")).withColumn("set_key", F.lit(1))
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(docs).collect()), key=str)
    assert got == brute(rows)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, c, _ in got if c is not None} | {None}, key=str) + [None] * 1


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(docs).collect()), key=str)
    assert got == brute(rows)
    assert any(n for *_, n in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.classes(docs).count() == jaccard.keep_first(docs).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """Sets of similarity 0.8 pass the pruning; unrelated ones don't."""
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(300):
        own = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        a, b = own[:900], np.concatenate([own[:800], own[900:]])
        values = np.stack([np.frombuffer(jaccard.short_values(jaccard.minhash(x)), np.uint8) for x in (a, b, rng.integers(0, 2**63, 900, dtype=np.uint64))])
        none = np.zeros(3, bool)
        labels = jaccard.surviving(np.zeros(3, int), np.zeros(3, int), none, np.full(3, 900), values)
        lost += labels[1] != 0
        assert labels[2] == 2
    assert not lost


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    match = []
    for _ in range(200):
        own = rng.integers(0, 2**63, 1100, dtype=np.uint64)
        match.append(np.mean(jaccard.minhash(own[:1000]) == jaccard.minhash(np.concatenate([own[:700], own[1000:]]))))
    assert abs(np.mean(match) - 700 / 1100) < 0.01


def test_exact_links():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.permutation(56)[:50]).astype(np.uint64) for _ in range(30)]
    want = [[a != b and 5 * len({*x.tolist()} & {*y.tolist()}) >= 4 * len({*x.tolist()} | {*y.tolist()}) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    assert jaccard.linked(sets).tolist() == want and any(map(any, want))
    assert jaccard.linked(sets[:2]).tolist() == [r[:2] for r in want[:2]]


def test_same_id_different_texts(spark):
    """Rows that share an id are documents of their own where their texts differ: one row of each class stays."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(100), words(60), words(60)
    near = " ".join([*a[:-1], "other"])
    a, b, c = " ".join(a), " ".join(b), " ".join(c)
    rows = [(3, near, "s"), (7, a, "s"), (7, b, "s"), (7, b, "r"), (9, c, "s"), (9, b, "s"), (5, "", "s"), (5, None, "s"), (5, c, "s"), (None, a, "s")]
    want = sorted([(3, near, "s"), (7, b, "r"), (5, "", "s"), (5, None, "s"), (5, c, "s"), (None, a, "s")], key=str)
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(3)
        assert sorted(map(tuple, jaccard.keep_first(docs).collect()), key=str) == want
