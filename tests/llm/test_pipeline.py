"""The pipeline's stages against brute force, each on its own input."""

import math
import re
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_jaccard import brute as brute_classes
from test_native import brute_quality
from test_rows_alone import check_packing
from test_substring import brute as brute_substring

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_kept(rows, no_host=False):
    """Ids that pass their own rules and whose host's failure rates aren't all but surely above their limits."""
    fails, hosts = {}, defaultdict(list)
    for i, text, source in rows:
        n, chars, symbols, dup, repeat = brute_quality(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        fails[i] = (n < 20, 100 * repeat > 30 * n, 10 * symbols > chars, 100 * dup > 30 * lines)
        if not (no_host and source is None):  # a null host is no host
            hosts[source].append(fails[i])
    bad = set()
    for rule in range(4):
        rates = {h: sum(f[rule] for f in own) / len(own) for h, own in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        var = sum((r - mean) ** 2 for r in rates.values()) / len(rates)
        weight = min(max(mean * (1 - mean) / var - 1, 2.0), 1000.0) if var > 0 else 1000.0
        limit = max(0.5, mean + 2 * math.sqrt(mean * (1 - mean) / (weight + 1)))
        for h, own in hosts.items():
            x, n = (rates[h] * len(own) + mean * weight) / (len(own) + weight), len(own) + weight + 1
            bad |= {h} if x - 2 * math.sqrt(x * (1 - x) / n) > limit else set()
    return {i for i, _, source in rows if not any(fails[i][:2]) and source not in bad}


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        seen[name] = len(after)
        if name != "packing":
            assert docs.columns == COLUMNS
            assert all(r.n_chars == len(r.text) for r in after)
        ids = {r.doc_id for r in after}
        if name == "quality rules":
            assert ids == brute_kept([(r.doc_id, r.text, r.source) for r in before]) and len(after) == len(ids)
        elif name == "n-gram Jaccard join":
            assert ids == {c for _, c, _ in brute_classes([(r.doc_id, r.text) for r in before])} and len(after) == len(ids)
            assert len(after) < len(before)
        elif name == "substring dedup":
            gone = {i: m for i, _, m, _ in brute_substring([(r.doc_id, r.text) for r in before])}
            words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
            assert {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after} == {i: words[i] - gone[i] for i in words}
        elif name == "secret scans":
            assert {r.doc_id: re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', "[SECRET]", r.text) for r in before} == {r.doc_id: r.text for r in after}
        else:
            check_packing([r.text for r in before], after)
    assert corpus_pipeline.run(spark, folder).count() == seen["packing"]


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, ids with several texts, clashing names."""
    import random

    rng = random.Random(21)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    passage, hot = words(60), words(200)
    texts = [(k, " ".join(words(40) + passage[k % 3 :] + words(k))) for k in range(1, 9)]
    texts += [(20 + k, " ".join([*hot[: -1 - k], *words(1 + k)])) for k in range(6)]  # near copies of each other
    texts += [(30, " ".join(words(300_000))), (31, "z" * 300_000 + " " + " ".join(words(30))), (32, "la " * 40_000)]
    texts += [(40, None), (41, ""), (42, " \n\t"), (None, " ".join(words(50))), (None, None), (43, "few words"), (44, " ".join(hot))]
    texts += [(7, " ".join(words(70))), (7, " ".join(words(35) + passage)), texts[0], texts[0], texts[3], (50, 'it was token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" ' + " ".join(words(30)))]
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"h{n % 3}", None if t is None else len(t), n, "q", 1.5, None, [n]) for n, (i, t) in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, words string, `own key` double, node string, row array<int>"
    return spark.createDataFrame(rows, schema).repartition(4)


def test_stages_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = [(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else []
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars is None or r.n_chars == len(r.text) for r in docs.collect()) or name in ("quality rules", "n-gram Jaccard join")
        if name == "quality rules":
            kept = brute_kept([(n, t, r) for n, (t, r) in enumerate((x.text, x.source) for x in odd_documents(spark).collect())], True)
            assert sorted(after, key=str) == sorted((before_row for n, before_row in enumerate((x.doc_id, x.text) for x in odd_documents(spark).collect()) if n in kept), key=str)
        elif name == "n-gram Jaccard join":
            classes = [c for _, c, _ in brute_classes(before)]
            assert len({i for i, _ in after if i is not None} - set(classes)) == 0
            assert sum(i is None for i, _ in after) == sum(i is None for i, _ in before)
            assert {t for i, t in before if i == 7} == {t for i, t in after if i == 7}  # texts of one id that differ all stay
        elif name == "substring dedup":
            import hashlib

            told = lambda t: hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode()).hexdigest()
            assert sorted(((i, d) for i, _, _, d in brute_substring(before)), key=str) == sorted(((i, told(t)) for i, t in after), key=str)
        elif name == "secret scans":
            assert len(after) == len(before) and sum("[SECRET]" in (t or "") for _, t in after) >= 1
            assert all("0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" not in (t or "") for _, t in after)
        else:
            check_packing([t for _, t in before], docs.collect())


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
