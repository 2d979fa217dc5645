"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each vocabulary entry becomes a sentencepiece piece whose characters stand for bytes (printable
Latin-1 bytes for themselves, the others for the code points from 256 on), scored by its negative
rank, with identity normalisation: sentencepiece then merges the adjacent pair with the best score,
leftmost first, which is the rank order of the vocabulary.  Pre-tokens come from the split pattern;
a pre-token that is itself an entry is that entry, as in the rank file's own library.  Decoding maps
ids to pieces and the pieces' characters back to bytes.

Defined cases: null text is the empty text (no ids, empty bytes); rows are independent, so repeated
or null ids are kept as they are; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetrace.llm.runtime import small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries that one Python worker remembers; it starts again when they are reached.
CACHE_ENTRIES = 600_000
#: Documents' ids that are decoded and sent together.
SLICE = 256

#: Splits a text so that no match of the pre-token pattern crosses a cut: runs of non-space with the
#: one space before them, and white space as the pattern itself would cut it.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Characters that Python counts as white space and the pattern's library doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """A printable character for each byte, by the rule of byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with piece ``rank + 1`` for each entry and an unknown piece at 0."""
    alphabet = byte_alphabet()
    unknown = "⁇".encode()  # no mapped byte has this character
    pieces = [_field(1, unknown) + _field(2, 0.0) + _field(3, 2)]
    for n, (entry, rank) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        if n != rank:
            raise ValueError(f"ranks have a gap at {n}")
        pieces.append(_field(1, "".join(alphabet[b] for b in entry).encode()) + _field(2, -float(rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43)) + _field(45, unknown)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, vocab_path: str, pattern: str) -> None:
        with open(vocab_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.alphabet = dict(enumerate(byte_alphabet()))
        back = {c: b for b, c in self.alphabet.items()}
        self.entries = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(1, self.model.get_piece_size())]
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, bytes] = {}

    def _pieces(self, text: str) -> bytes:
        """Little-endian ids of a text, pre-token by pre-token."""
        out = []
        for token in self.pattern.findall(text):
            raw = token.encode()
            own = self.ranks.get(raw)
            if own is not None:
                out.append(own)
            else:
                out.extend(i - 1 for i in self.model.encode("".join(map(self.alphabet.__getitem__, raw))))
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._pieces(text)
        chunks = _CHUNK.findall(text)
        seen = self.seen
        try:
            return b"".join([seen[c] for c in chunks])
        except KeyError:
            pass
        if len(seen) > CACHE_ENTRIES:
            seen.clear()
        out = []
        for c in chunks:
            ids = seen.get(c)
            if ids is None:
                ids = self._pieces(c)
                if len(c) <= 64:
                    seen[c] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        """Bytes of little-endian ids."""
        if not ids:
            return b""
        return b"".join(map(self.entries.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(vocab_path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(vocab_path, pattern)


def _where(vocab_path: str | None) -> str:
    return vocab_path or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, vocab_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary, little-endian unsigned 32-bit) of each row; no shuffle."""
    path = _where(vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.encode(t) for t in part.column(1).to_pylist()], pa.binary())], [id_col, "ids"])

    kept = docs.select(F.col(id_col), F.col(text_col))
    return small_batches(kept).mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocab_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (binary) of each row of :func:`encode`; no shuffle."""
    path = _where(vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([own.decode(x) for x in part.column(1).to_pylist()], pa.binary())], [id_col, "ids", "decoded"])

    kept = encoded.select(id_col, "ids")
    return small_batches(kept).mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text."""
    return decode(encode(docs, **options), **{k: v for k, v in options.items() if k != "text_col"}).select(
        options.get("id_col", "doc_id"),
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
