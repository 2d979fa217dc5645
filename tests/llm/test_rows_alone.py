"""Operators that treat each row alone: byte-level BPE, Matroska, packing."""

import base64
import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("sievetrace.llm")
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from sievetrace.llm import byte_bpe, matroska, packing

TEXTS = [
    None, "", " ", "\n\n  x", "it's 12 o'clock...  \n\tYes!", "a\x1cb \x1f c", "naïve Ünïcödé ßtraße ﬁ 漢字 🙂🙂", "x" * 5000, "the " * 3000, "tab\tand  two  spaces ", " nb em\u0085nel",
    "<|endoftext|> and <|startoftext|> inside", "é combining ΑΣ ΣΑΣ.", "the quick brown fox " * 700, "\0nul\0",
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "own", i, i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 0, 0), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, media int, length int")


def test_bpe_matches_the_rank_file_library(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.digests(docs).collect()
    assert len(got) == docs.count()
    texts = {**dict(enumerate(TEXTS)), None: "no id"}
    for r in got:
        text = texts[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_the_corpus(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids_sha256 for r in byte_bpe.digests(docs).collect()}
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        assert got[r.doc_id] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_bpe_on_odd_texts():
    """Chunked and remembered encoding is that of the whole text, on odd white space and letters."""
    rng = random.Random(8)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    parts = ["the", "Thing", "ção", "e\u0301", "'s", "'ll", "'", "...", "$$$", "12", "٣", "日本", "_", "\u00a0", "\u2003", "\u0085", "\x1c", "\x1f", "\u180e", "\u200b", "\n", "\r\n", "\t", " ", "  ", "🙂", "\0", "\ufeff"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        ids = own.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_media_round_trip(docs):
    got = matroska.digests(docs).collect()
    texts = {**dict(enumerate(TEXTS)), None: "no id"}
    assert len(got) == docs.count()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-64:])


def test_media_packets_of_every_lacing():
    data = bytes(i % 251 for i in range(200_000))
    found = matroska.parse(matroska.write(data))
    assert {p.lacing for p in found["packets"]} == set(matroska.LACING)
    assert found["clusters"] == len(found["cues"]) > 1
    assert [p.timestamp_ms for p in found["packets"]] == [k * 128.0 for k in range(len(found["packets"]))]
    assert all(p.cued and p.keyframe and p.track == 1 for p in found["packets"])


def test_media_unknown_sizes_groups_and_faults():
    e = matroska.element
    block = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x81\x00\x05\x00abc"))
    clusters = b"".join(matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + e(matroska.CLUSTER_TIME, t) + block for t in (10, 20))
    file = e(matroska.EBML, e(matroska.DOC_TYPE, "webm")) + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + clusters
    found = matroska.parse(file)
    assert [(p.timestamp_ms, file[p.byte_start : p.byte_end]) for p in found["packets"]] == [(15.0, b"abc"), (25.0, b"abc")]
    for bad in (b"", b"\0\0", matroska.write(b"x" * 64)[:-9]):
        with pytest.raises(ValueError):
            matroska.parse(bad)


def malformed():
    """Files that go wrong in one place each."""
    e, m = matroska.element, matroska
    seg = lambda *parts: e(m.SEGMENT, b"".join(parts))
    cluster = lambda *parts: e(m.CLUSTER, e(m.CLUSTER_TIME, 1) + b"".join(parts))
    return [
        seg(cluster(e(m.BLOCK_GROUP, e(m.REFERENCE_BLOCK, 1)))),  # a group without a block
        seg(e(m.INFO, e(m.TIMESTAMP_SCALE, b"\x01" * 200)), cluster(e(m.SIMPLE_BLOCK, b"\x81\0\0\0x"))),  # an integer of 200 bytes
        seg(e(m.INFO, e(m.DURATION, b"abc"))), seg(e(m.TRACKS, e(m.TRACK_ENTRY, e(m.CODEC_ID, "x")))), seg(e(m.CUES, e(m.CUE_POINT, e(m.CUE_POSITIONS, e(m.CUE_TRACK, 1))))),
        seg(cluster(e(m.SIMPLE_BLOCK, b"\x81\0"))), seg(cluster(e(m.SIMPLE_BLOCK, b"\xff\0\0\0x"))), seg(cluster(e(m.SIMPLE_BLOCK, b"\x81\0\0\x06\x02\0"))),
        e(m.EBML, e(m.DOC_TYPE, b"\xff\xfe")) + seg(cluster()),
    ]


def test_demux_reports_faults(spark):
    bad = malformed()
    rows = [(1, bytearray(matroska.write(b"y" * 64)), "mine", 1), (2, bytearray(b"junk"), None, 2), (3, None, None, 3), *((4 + k, bytearray(f), None, 0) for k, f in enumerate(bad))]
    df = spark.createDataFrame(rows, "doc_id bigint, media binary, Error string, payload int")
    found = matroska.demux(df)
    assert found.columns == [*df.columns, "packets", "payload_", "feature", "error_"]
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].payload_ == b"y" * 64 and got[1].error_ is None and got[1].Error == "mine" and got[2].payload == 2 and len(got[1].packets) == 1
    assert all(got[k].packets is None and got[k].payload_ is None and got[k].error_ for k in range(2, 4 + len(bad)))


def test_large_track_numbers_and_keyframes(spark):
    e, m = matroska.element, matroska
    block = m.size_vint((1 << 40) + 5) + b"\0\0"
    file = e(m.SEGMENT, e(m.CLUSTER, e(m.CLUSTER_TIME, 3) + e(m.BLOCK_GROUP, e(m.BLOCK, block + b"\0a")) + e(m.BLOCK_GROUP, e(m.BLOCK, block + b"\0b") + e(m.REFERENCE_BLOCK, 1)) + e(m.SIMPLE_BLOCK, block + b"\x80c") + e(m.SIMPLE_BLOCK, block + b"\0d")))
    row = m.demux(spark.createDataFrame([(bytearray(file),)], "media binary")).first()
    assert [(p.track, p.keyframe) for p in row.packets] == [((1 << 40) + 5, k) for k in (True, False, True, False)] and row.payload == b"abcd"


def read_alone(data):
    """(payload, number of blocks, clusters) of a file by a reader of its own: known sizes, ids by their first byte."""
    def elements(a, b):
        while a < b:
            k = 9 - data[a].bit_length()
            ident, a = data[a : a + k], a + k
            k = 9 - data[a].bit_length()
            n, a = int.from_bytes(data[a : a + k], "big") - (1 << 7 * k), a + k
            yield ident, a, a + n
            a += n

    def frames(a, b):
        form, a = data[a + 3] >> 1 & 3, a + 4
        if form == 0:
            return data[a:b]
        n, a = data[a], a + 1  # sizes of all frames but the last
        if form == 1:
            for _ in range(n):
                while data[a] == 255:
                    a += 1
                a += 1
        elif form == 3:
            for _ in range(n):
                a += 9 - data[a].bit_length()
        return data[a:b]

    (_, _, head_end), (ident, a, b) = elements(0, len(data))
    assert ident == b"\x18\x53\x80\x67" and b == len(data) and a > head_end
    clusters = [(x, y) for i, x, y in elements(a, b) if i == b"\x1f\x43\xb6\x75"]
    blocks = [(x, y) for c in clusters for i, x, y in elements(*c) if i == b"\xa3"]
    return b"".join(frames(*x) for x in blocks), len(blocks), len(clusters)


def test_stored_form_by_another_reader(docs):
    """media_sha256 and feature are of a file that a second reader reads back to the same payload."""
    texts = {**dict(enumerate(TEXTS)), None: "no id", "long": "word " * 60_000}
    media = {r.doc_id: bytes(r.media) for r in matroska.mux(docs).collect()}
    media["long"] = matroska.write(texts["long"].encode().ljust(300_032, b"\0"))
    digests = {r.doc_id: r for r in matroska.digests(docs).collect()}
    for key, file in media.items():
        payload, blocks, clusters = read_alone(file)
        raw = (texts[key] or "").encode()
        assert payload == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        told = dict(x.split("=") for x in matroska.features(file, matroska.parse(file)).split(";")[1:])
        forms = {f: int(told[f]) for f in matroska.LACING}
        assert int(told["clusters"]) == int(told["cues"]) == clusters and int(told["packets"]) == sum(forms.values()) == -(-len(payload) // matroska.FRAME)
        assert float(told["duration_ms"]) == pytest.approx(len(payload) / 8, rel=1e-5) and float(told["last_ms"]) == pytest.approx(128 * (int(told["packets"]) - 1), rel=1e-5)
        if key != "long":
            assert digests[key].media_sha256 == hashlib.sha256(file).hexdigest() and digests[key].media_bytes == len(file)


def test_writing_takes_time_in_proportion():
    import time

    took = []
    for size in (4_000_000, 32_000_000):
        began = time.process_time()
        file = matroska.write(bytes(size))
        took.append(time.process_time() - began)
        assert len(file) > size
    assert took[1] < 24 * max(took[0], 0.02)  # 8 times the size; its square would be 64 times


def check_packing(texts, rows):
    """texts: (row's text); rows: pieces. Whole, gapless, and little padding."""
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    own.encode_special_tokens = True
    want = [[*own.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
    padding = 0
    for own_rows in seqs.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return want, padding


def test_packing_is_whole(docs):
    rows = packing.pieces(docs.coalesce(1)).collect()
    want, padding = check_packing([*TEXTS, TEXTS[3], "no id"], rows)
    assert padding < 4096
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, ids in enumerate(want[: len(TEXTS)]):
        if i == 3:
            continue  # a repeated row
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)


def test_words_are_tokenised_as_texts():
    """Remembered stems give the tokenizer's own ids, on texts of odd letters and punctuation."""
    rng = random.Random(6)
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    own.encode_special_tokens = True
    parts = ["the", "Thing", "ção", "ß", "İ", "ΑΣ", "é", "e\u0301", "ﬁ", "'s", "'S", "...", ",", "$$$", "###", "12", "٣", "日本", "x_y", "\u00a0", "\u2003", "\x1c", "-", "ŉ", "Ǆ", "K", "!", "¼", "\n", "\t", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", ". "]) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    tokens = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    for text, ids in zip(texts, tokens.encode(texts)):
        assert ids.tolist() == [*own.encode(text, add_special_tokens=False).ids, packing.END_ID], repr(text)


def test_packing_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pieces(docs).collect()
    _, padding = check_packing([r.text for r in docs.collect()], rows)
    assert padding < 4096 * docs.rdd.getNumPartitions()
    tiers = {r.tier for r in rows}
    assert tiers == set(packing.TIERS)
    steps = defaultdict(int)
    for r in rows:
        steps[r.step_group] += r["length"]
    assert max(steps.values()) <= packing.STEP_TOKENS
    assert sum(v == packing.STEP_TOKENS for v in steps.values()) > len(steps) - 2 * len(packing.TIERS)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert byte_bpe.digests(none).count() == matroska.digests(none).count() == packing.pieces(none).count() == 0


def test_step_groups_of_many_partitions(spark):
    """Step groups go over partitions: each holds one tier, and at most one of each tier isn't full."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4, "doc_id")
    rows = packing.pieces(docs).collect()
    windows, tiers, parts = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in rows:
        windows[r.step_group].add(r.sequence_id)
        tiers[r.step_group].add(r.tier)
        parts[r.step_group].add(r.sequence_id >> 32)
    assert len({p for own in parts.values() for p in own}) == 4 and any(len(own) > 1 for own in parts.values())
    assert all(len(t) == 1 for t in tiers.values())
    tokens = {g: len(w) * min(tiers[g]) for g, w in windows.items()}
    assert max(tokens.values()) == packing.STEP_TOKENS
    assert sum(t < packing.STEP_TOKENS for t in tokens.values()) <= len(packing.TIERS)


def test_packed_ids(docs):
    """The pieces' ids are those that their checksums are of."""
    rows = packing.pack(docs.coalesce(2)).collect()
    for r in rows:
        assert len(r.ids) == 4 * r["length"]
    crc = lambda r: zlib.crc32(r.ids) if "ids" in r else r.ids_crc32
    key = lambda r: (str(r.doc_id), r.start, r["length"], r.doc_tokens, r.sequence_id, r.offset, r.tier, crc(r), r.step_group)
    assert sorted(map(key, rows)) == sorted(map(key, packing.pieces(docs.coalesce(2)).collect()))
