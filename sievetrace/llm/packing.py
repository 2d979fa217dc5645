"""Hierarchical multi-length packing of tokenised documents.

Documents are routed by their number of tokens to context-size tiers (512, 1024, 2048, 4096).  A tier's
window is opened by one of its documents, its gap is filled with the longest documents of the shorter
tiers that fit, and with a cut from a shorter one where none fits; the shortest tier joins documents
and cuts at its window.  So a sequence ends exactly at its tier, a power of two, and isn't padded.
What is left when a partition ends is cut to full windows of falling tiers; at most one sequence for
each partition is padded to the longest window.  Sequences of a tier form step groups of equally many
tokens, so every step of a mixed-length schedule has the same work.  They are numbered over all partitions,
by prefix sums of each partition's sequences: at most one step group of each tier isn't full.

Each partition packs for itself, in one pass with a bounded pool: no shuffle of texts, and a lost executor's
partition is packed again to the same sequences.  The pieces are written once to the shared folder, and one
row for each partition and tier is added up.  Sequence ids hold the partition's number.

Defined cases: null text is the empty text (its end token alone); ids are never joined, so repeated or
null ids are packed as rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievetrace.llm.runtime import small_batches, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
TIERS = (512, 1024, 2048, 4096)
#: Tokens of a full step group, a multiple of every tier.
STEP_TOKENS = 32_768
#: Tokens that wait in a partition for windows, beyond which windows are closed.
POOL_TOKENS = 1_000_000
#: Words after which a Python worker's memory becomes the older of two generations.
CACHE_WORDS = 350_000
SLICE = 256

#: Characters that Python counts as white space and the tokenizer doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters beyond those that are composed and have one lower case letter at any place.
_ODD_LETTER = re.compile("[^\x00-\u012f\u0131-\u017f]")
#: Punctuation between a letter or digit and white space or the end.
_TAIL = re.compile(r"[.,!?;:%&$*#|](?<=[^\W_].)[.,!?;:%&$*#|]*(?=\s|\Z)")
_BYTES_ONLY = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_END = struct.pack("<I", END_ID)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it.

    Each word's ids are remembered.  Before a text is cut at its white space, if its letters all have one lower
    case letter at any place they are lowered, as the tokenizer does, and a tail of punctuation after a letter or
    digit, which the tokenizer splits off as well, is set apart; so most words are stems that were seen before.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True  # their strings in a text are ordinary text
        bare = json.loads(self.own.to_str()) | {"normalizer": None, "pre_tokenizer": _BYTES_ONLY}
        self.stems = Tokenizer.from_str(json.dumps(bare))  # the same for lower-case letters: nothing to normalise or split
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: set[str], lowered: bool) -> None:
        """Remember the ids of words, from the older generation or newly encoded; ``lowered`` ones hold no odd letter."""
        seen, older = self.seen, self.older
        if older:
            seen.update((w, older[w]) for w in words if w in older)
        plain, other = [], []
        for w in words:
            if w not in seen:
                (plain if w.isalpha() and (lowered or w.islower() and not _ODD_LETTER.search(w)) else other).append(w)
        for own, new in ((self.stems, plain), (self.own, other)):
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                seen.update(zip(part, [array("I", e.ids).tobytes() for e in own.encode_batch_fast(part, add_special_tokens=False)], strict=True))

    def _words(self, text: str | None) -> tuple[list[str] | None, bool]:
        """White-space cut words, None for a text whose white space Python sees otherwise; whether they were lowered."""
        if not text:
            return [], False
        if _ODD_SPACE.search(text):
            return None, False
        if _ODD_LETTER.search(text):
            return text.split(), False
        return _TAIL.sub(r" \g<0>", text.lower()).split(), True

    def forget(self) -> None:
        """Let the older words go: a worker that waits for its next task keeps the newer ones only."""
        self.older = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids and the end id of each text."""
        if len(self.seen) > CACHE_WORDS:
            self.older, self.seen = self.seen, {}
        get = self.seen.get
        out = []
        for text in texts:
            words, lowered = self._words(text)
            if words is None:
                raw = array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                ids = list(map(get, words))
                if None in ids:
                    self._learn({w for w, x in zip(words, ids, strict=True) if x is None}, lowered)
                    ids = map(get, words)
                raw = b"".join(ids)
            out.append(np.frombuffer(raw + _END, "<u4"))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


class Pool:
    """Pieces that wait, by length; the longest that fits is found by bisection."""

    def __init__(self) -> None:
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def put(self, piece: tuple) -> None:
        n = piece[3] - piece[2]
        own = self.by_length.setdefault(n, [])
        if not own:
            insort(self.lengths, n)
        own.append(piece)
        self.tokens += n

    def take(self, most: int | None = None) -> tuple | None:
        """The longest piece of at most ``most`` tokens, or None."""
        k = len(self.lengths) if most is None else bisect_right(self.lengths, most)
        if not k:
            return None
        n = self.lengths[k - 1]
        own = self.by_length[n]
        piece = own.pop()
        if not own:
            del self.lengths[k - 1], self.by_length[n]
        self.tokens -= n
        return piece


class Packer:
    """Packs the documents of a partition; a piece is (row key, ids, start, end)."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS) -> None:
        self.tiers, self.pool_tokens = tiers, pool_tokens
        self.pools = {t: Pool() for t in tiers}
        self.base, self.made = partition << 32, 0
        self.of_tier = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        """Full windows of the longest tier at once; the rest waits in its tier."""
        at, longest = 0, self.tiers[-1]
        while len(ids) - at >= longest:
            self._emit([(key, ids, at, at + longest)], longest)
            at += longest
        if at < len(ids):
            self._route((key, ids, at, len(ids)))
        if sum(p.tokens for p in self.pools.values()) > self.pool_tokens:
            self._close(keep=self.pool_tokens // 4)

    def _route(self, piece: tuple) -> None:
        n = piece[3] - piece[2]
        self.pools[next(t for t in self.tiers if n <= t)].put(piece)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        offset, seq = 0, self.base | self.made
        for key, ids, a, b in pieces:
            self.rows.append((key, a, b - a, len(ids), seq, offset, tier, self.of_tier[tier], ids[a:b].tobytes()))
            offset += b - a
        self.made += 1
        self.of_tier[tier] += 1

    def _fill(self, pieces: list[tuple], gap: int, tiers: tuple[int, ...]) -> int:
        """Fill a gap from the pools of ``tiers``: whole pieces that fit, longest first, then one cut; what is left."""
        while gap:
            best = max((t for t in tiers if self.pools[t].lengths and self.pools[t].lengths[0] <= gap), default=0)
            piece = self.pools[best].take(gap) if best else None
            if piece is None:
                whole = next((self.pools[t].take() for t in tiers if self.pools[t].lengths), None)
                if whole is None:
                    return gap
                key, ids, a, b = whole
                piece = (key, ids, a, a + gap)
                self._route((key, ids, a + gap, b))
            pieces.append(piece)
            gap -= piece[3] - piece[2]
        return 0

    def _close(self, keep: int = 0) -> None:
        """Close windows, the longest tier first, until ``keep`` tokens of the shortest tier wait or nothing fills a gap."""
        for n in range(len(self.tiers) - 1, -1, -1):
            tier, pool = self.tiers[n], self.pools[self.tiers[n]]
            shorter = self.tiers[: n or 1]
            while pool.tokens > (0 if n else max(keep, tier)):
                pieces = [pool.take()]
                gap = self._fill(pieces, tier - (pieces[0][3] - pieces[0][2]), shorter)
                if gap:
                    for p in pieces:
                        self._route(p)
                    break
                self._emit(pieces, tier)

    def finish(self) -> None:
        """Close all windows; the rest becomes one stream, cut to falling tiers, its end padded to the longest window."""
        self._close()
        left = []
        for pool in self.pools.values():
            while (piece := pool.take()) is not None:
                left.append(piece)
        total = sum(p[3] - p[2] for p in left)
        left.reverse()
        while total:
            tier = max((t for t in self.tiers if t <= total), default=0)
            want, pieces = tier or total, []
            while want:
                key, ids, a, b = left.pop()
                cut = min(b - a, want)
                pieces.append((key, ids, a, a + cut))
                if cut < b - a:
                    left.append((key, ids, a + cut, b))
                want -= cut
                total -= cut
            self._emit(pieces, tier or self.tiers[-1])


_FIELDS = (("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary()))


def _packed(docs: DataFrame, tokenizer_path: str | None, id_col: str, text_col: str, tiers: tuple[int, ...]) -> DataFrame:
    """Pieces with ``nth``, the number of their sequence among those of its tier and partition."""
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, kind = tokenizer(path), Packer(TaskContext.get().partitionId(), tiers), None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * 9
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _FIELDS, strict=True))], [id_col, *(n for n, _ in _FIELDS)])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                for key, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(key, ids)
                if packer.rows:
                    yield out()
        packer.finish()
        own.forget()
        if packer.rows:
            yield out()

    kept = docs.select(F.col(id_col), F.col(text_col))
    return small_batches(kept).mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, tier int, nth bigint, ids binary")


def _in_steps(rows: DataFrame, step_tokens: int) -> DataFrame:
    """Written pieces with ``step_group`` in place of ``nth``: the tier and the number of a group of its sequences over all partitions."""
    part = F.shiftrightunsigned("sequence_id", 32).alias("part")
    made = rows.groupBy(part, "tier").agg((F.max("nth") + 1).alias("made"))  # a row for each partition and tier
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    made = made.select("part", "tier", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("before"))
    names = [c for c in rows.columns if c != "nth"]
    group = F.floor((F.col("before") + F.col("nth")) * F.col("tier") / step_tokens).cast("long")
    placed = rows.withColumn("part", part).join(made, ["part", "tier"])
    return placed.select(*(F.col(f"`{c}`") for c in names), (F.shiftleft(F.col("tier").cast("long"), 44) + group).alias("step_group"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: ``id_col``, start, length, doc_tokens, sequence_id, offset, tier, the piece's ids (binary,
    little-endian unsigned 32-bit) and step_group.  ``tiers`` are powers of two, ``step_tokens`` a multiple of each."""
    return _in_steps(table(_packed(docs, tokenizer_path, id_col, text_col, tiers)), step_tokens)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    rows = _packed(docs, tokenizer_path, id_col, text_col, tiers)
    rows = rows.select(F.col(f"`{id_col}`"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "nth")
    return _in_steps(table(rows), step_tokens)
