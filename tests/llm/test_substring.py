"""Substring deduplication against a brute-force version."""

import hashlib
import random
import re

import pytest

pytest.importorskip("sievetrace.llm")
from pyspark.sql import functions as F

from sievetrace.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, n_words, n_removed, kept digest) of each (doc_id, text)."""
    first, split = {}, [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(4000))
    words = lambda n: [word() for _ in range(n)]
    passage, other = words(80), words(50)
    rows = []
    for i in range(60):
        w = words(rng.randrange(200))
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(31) :][: rng.randrange(50, 81)]
        if i % 7 == 0:
            w[:0] = other
        if i % 11 == 0:
            w += other[:49]
        rows.append((rng.randrange(10**6) * 100 + i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(rows[5][0] + 1, rows[5][1]), (rows[0][0], rows[0][1]), (7, "é " * 500), (8, "é " * 120), (9, "x y " * 90), (3, None), (4, ""), (None, rows[0][1]), (2, " \n"), (-5, " ".join(passage)), (6, "z " * 30_000 + " ".join(passage))]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"slice_words": 300, "range_bytes": 2000}, {"slice_words": 3000, "range_bytes": 30_000}, {"slice_words": 500, "range_bytes": 3000, "fan": 4}, {"slice_words": 500, "range_bytes": 3000, "fan": 4, "deal": 2}])
def test_planted(spark, sizes):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    docs = docs.withColumn("packed", F.lit(1)).withColumn("words", F.lit("x"))  # names that the operator uses
    assert sorted(map(tuple, substring.digests(docs, **sizes).collect()), key=str) == brute(rows)


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, substring.digests(docs).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_text_keeps_its_white_space(spark):
    w = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(w), "s"), (2, "before\n\n" + "\n".join(w) + "\tafter  end", "s"), (3, None, None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in substring.dedup(docs).collect()}
    assert got[2].text == "before\n\nafter  end" and got[2].words.n_removed == 60 and got[3].text is None
    assert substring.dedup(docs).columns == ["doc_id", "text", "source", "words"]
    assert substring.dedup(docs.limit(0)).count() == 0


def test_packing_of_entries():
    import numpy as np

    e = substring.Entries(np.array([5, 1 << 39, 7], "u8"), np.array([-3, -3, 1 << 60], "i8"), np.array([9, 70_000, 2], "u4"), np.array([1, 0, 3], "u1"))
    for a, b in zip(substring.unpack(substring.pack(e, 5)), e):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize("sizes", [{}, {"slice_words": 300, "range_bytes": 2000}])
def test_same_id_different_texts(spark, sizes):
    """Each row is judged on its own text, whatever other rows have its id."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = words(70), words(60)
    rows = [(1, passage + words(20)), (7, words(10) + passage + words(5)), (7, words(120)), (7, words(40) + passage), (9, passage + words(3)), (7, other + words(9)), (4, other), (8, words(75)), (8, other + passage), (7, words(5))]
    rows += [rows[1], rows[5], *((100 + k % 5, words(k) + passage[k:] + words(30)) for k in range(15))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(7, None), (None, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, substring.digests(docs, **sizes).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"slice_words": 400, "range_bytes": 3000}, {"slice_words": 400, "range_bytes": 2000, "fan": 3, "deal": 1}])
def test_periodic_texts(spark, sizes):
    """Texts that repeat themselves, alone and in others: every place of a window goes if its first one does."""
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    chorus, two = words(13), words(70)
    rows = [(k, w) for k, w in enumerate([
        ["la"] * 900, ["la"] * 55, ["la"] * 49, ["lo"] * 3000, chorus * 30, words(9) + chorus * 6 + words(9) + chorus * 5, two + words(30) + two + words(7) + two, words(3) + two, two * 3,
        ["a", "b"] * 400, ["b", "a"] * 30, ["a", "b", "c"] * 100, words(60) * 4, words(25) * 2 + words(40) + words(25), ["lo"] * 40 + words(4) + ["lo"] * 60,
    ])]
    rows += [(3, ["la"] * 200), (3, ["la"] * 200), (200, words(60) * 2), (5, ["lo"] * 500), (-1, ["b"] + ["a", "b"] * 26)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, substring.digests(docs, **sizes).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 2000


def test_a_repeated_word_is_sent_once():
    import numpy as np

    n = 100_000
    e = substring.Entries(np.full(n, 7, "u8"), np.full(n, 3, "i8"), np.arange(n, dtype="u4"), (np.arange(n) % 25 == 0).astype("u1"))
    marked, sent = substring.combine_probes(e)
    first, waiting = substring.once_each(sent)
    assert len(marked.key) == 0 and len(first.key) == 1 and len(waiting.key) == n - 1
    together = substring._join([waiting, first])
    assert len(substring.awaited(together, together.key).key) == n and len(substring.awaited(waiting, waiting.key).key) == 0
    both = substring._join([e, e._replace(doc=np.full(n, 4, "i8"))])
    marked, sent = substring.combine_probes(both)
    assert len(marked.key) == 2 * n and len(sent.key) == 1
    again, later = substring.combine_probes(substring._join([sent, sent._replace(doc=np.array([9], "i8")), first._replace(doc=np.array([11], "i8"))]))
    assert again.doc.tolist() == [11] and len(later.key) == 1  # what was marked isn't marked again
