"""Properties of the parts without Spark."""

import numpy as np
import pytest

pytest.importorskip("sievetrace.llm")
from hypothesis import given, settings
from hypothesis import strategies as st

from sievetrace.llm import matroska, packing, substring, wordhash

few = settings(max_examples=60, deadline=None)


@few
@given(st.lists(st.binary(max_size=600), min_size=1, max_size=9), st.sampled_from([1, 3]))
def test_lacing(frames, form):
    body = matroska.lace(frames, form)
    assert [body[a:b] for a, b in matroska.unlace(body, 0, len(body), form)] == frames


@few
@given(st.binary(max_size=9000))
def test_files(payload):
    payload = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
    found = matroska.parse(matroska.write(payload))
    assert len(found["packets"]) == -(-len(payload) // matroska.FRAME)


@few
@given(st.binary(max_size=400))
def test_junk_is_an_error_or_a_file(data):
    try:
        matroska.parse(data)
    except ValueError:
        pass


IDS = [getattr(matroska, n) for n in ("EBML", "DOC_TYPE", "SEGMENT", "INFO", "TIMESTAMP_SCALE", "DURATION", "TRACKS", "TRACK_ENTRY", "TRACK_NUMBER", "CODEC_ID", "DEFAULT_DURATION", "CLUSTER", "CLUSTER_TIME", "SIMPLE_BLOCK", "BLOCK_GROUP", "BLOCK", "REFERENCE_BLOCK", "CUES", "CUE_POINT", "CUE_TIME", "CUE_POSITIONS", "CUE_TRACK", "CUE_CLUSTER")]
LEAF = st.tuples(st.sampled_from(IDS), st.one_of(st.binary(max_size=12), st.binary(min_size=4, max_size=30).map(lambda b: b"\x81" + b)))
TREE = st.recursive(LEAF, lambda inner: st.tuples(st.sampled_from(IDS), st.lists(inner, max_size=4)), max_leaves=12)


def encoded(node):
    """A tree of (id, bytes or children) as elements."""
    ident, body = node
    return matroska.element(ident, body if isinstance(body, bytes) else b"".join(map(encoded, body)))


@settings(max_examples=600, deadline=None)
@given(st.lists(TREE, max_size=4), st.lists(TREE, max_size=4), st.lists(TREE, max_size=4), st.booleans())
def test_odd_contents_of_whole_elements(top, inside, blocks, unknown):
    """Well-formed elements in any order with any contents: packets in the file, or a ValueError."""
    cluster = b"".join(map(encoded, blocks))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster if unknown else matroska.element(matroska.CLUSTER, cluster)
    data = b"".join(map(encoded, top)) + matroska.element(matroska.SEGMENT, b"".join(map(encoded, inside)) + cluster)
    try:
        found = matroska.parse(data)
    except ValueError:
        return
    assert all(0 <= p.track < 1 << 56 and 0 <= p.byte_start <= p.byte_end <= len(data) for p in found["packets"])
    matroska.features(data, found)


@few
@given(st.integers(0, (1 << 56) - 2))
def test_sizes(n):
    raw = matroska.size_vint(n)
    assert matroska._vint(raw, 0) == (n, len(raw))


@few
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([(8, 16, 32, 64), (4, 8)]), st.integers(1, 400))
def test_packing(lengths, tiers, pool):
    packer = packing.Packer(3, tiers, pool)
    docs = [np.arange(n, dtype="<u4") + 1000 * k for k, n in enumerate(lengths)]
    for k, ids in enumerate(docs):
        packer.add(k, ids)
    packer.finish()
    seqs: dict[int, list] = {}
    got: dict[int, list] = {k: [] for k in range(len(docs))}
    for key, start, length, total, seq, offset, tier, _, raw in packer.rows:
        assert total == len(docs[key]) and len(raw) == 4 * length and length > 0
        got[key].append((start, np.frombuffer(raw, "<u4")))
        seqs.setdefault(seq, []).append((offset, length, tier))
    for k, ids in enumerate(docs):
        assert np.concatenate([x for _, x in sorted(got[k], key=lambda p: p[0])] or [ids[:0]]).tolist() == ids.tolist()
    short = 0
    for pieces in seqs.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at <= tier
        short += at < tier
    assert short <= 1  # all sequences but the last are full


@few
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\xa0abé\U0001f642", max_size=80))
def test_word_spans(text):
    import re

    raw = text.encode()
    starts, ends = wordhash.spans(raw)
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = wordhash.words(raw)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert [a == b for a in hashes for b in hashes] == [a == b for a in words for b in words]
    pairs = wordhash.windows(hashes, 2)
    two = list(zip(words, words[1:]))
    assert [a == b for a in pairs for b in pairs] == [a == b for a in two for b in two]


@few
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-3, 3), st.integers(0, 4)), min_size=1, max_size=60))
def test_matching(rows):
    key, doc, pos = (np.array(c) for c in zip(*rows))
    e = substring.Entries(key.astype("u8"), doc.astype("i8"), pos.astype("u4"), np.ones(len(rows), "u1"))
    want = sorted(r for r in rows if any(k == r[0] and d != r[1] for k, d, _ in rows))
    marked, sent = substring.combine_probes(e)
    later = substring.match_probes(sent)
    assert sorted(zip(marked.key.tolist(), marked.doc.tolist(), marked.pos.tolist())) == want and not len(later.key)
    whole = substring.match_probes(e)
    assert sorted(zip(whole.key.tolist(), whole.doc.tolist(), whole.pos.tolist())) == want
    repeated = substring.match_windows(e)
    assert sorted(zip(repeated.key.tolist(), repeated.doc.tolist(), repeated.pos.tolist())) == sorted(r for r in rows if any(k == r[0] and d < r[1] for k, d, _ in rows))
