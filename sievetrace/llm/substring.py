"""Substring deduplication with fixed-block anchors.

A window of 50 consecutive words is removed from a document if the same words stand in a document with a
smaller id.  Blocks of 25 words at multiples of 25 are the index: any 50-word window holds one of them
whole.  Every rolling window of 25 words of every document probes that index.  A hit, a block that also
stands in another document, is extended along the neighbouring shared windows to its maximal exact repeat;
the 50-word windows of the repeats are then compared as wholes, and each document's windows that a smaller
id has too are removed.  Windows are judged on the input, not on what is left.

Probes travel packed: one compressed row for each slice of documents and hash range instead of a row for
each word, so the shuffle is about the size of the texts.  Within a slice copies are combined before that:
what several documents of the slice share is marked at once and sent on as one entry, so a passage in a
third of all documents costs a hash range one entry for each slice.  A window that stands often in one
document is sent once, too: its other places wait with the document for what becomes of the first, so a text
of one repeated word is no hot key.  No pairs of documents are formed.  Beyond ``FAN`` ranges packets go to as
many coarse ranges first, each dealt to as many tasks as its size asks for, where they are combined again and
packed anew, so that packets hold hundreds of entries however many ranges there are.

Anchors are compared by 32 bits of a hash within one of the hash ranges, repeats by runs of 26 such
anchors and a 64-bit key of the two that make up a window; words aren't compared again.  A false cut needs
two different windows of equal key whose halves both stand in other documents: among n such windows about
n * n / 2**65 are expected, 0.03 for a billion.  Defined cases: null text has no words; a null id has no order, so such rows stay
as they are; rows with the same id don't remove from each other, and each loses its own repeats: where their texts differ, the
texts stand at places of their own in one range of word positions (at most 4 GB of different texts for an id, else an error);
texts of fewer than 50 words stay; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievetrace.llm import wordhash
from sievetrace.llm.runtime import small_batches, table, text_bytes

WINDOW = 50
#: Any window of 50 words holds a whole block of 25 that starts at a multiple of 25.
BLOCK = 25
#: Words whose probes are combined and packed together.
SLICE_WORDS = 1_200_000
#: Bytes of text for each hash range: a range's probes are held in one task's memory.
RANGE_BYTES = 16_000_000
#: Ranges that a slice is cut into at once, and partitions of a shuffle.
FAN, MOST_PARTITIONS = 2048, 50_000
#: Ranges whose bytes one task packs anew, where there are coarse ones.
DEAL_RANGES = 128
#: Word positions of a document.
MOST_POSITIONS = (1 << 31) - 1
_ANCHOR, _MARKED, _WAITS = 1, 2, 4


class Entries(NamedTuple):
    """Windows: hash key, document, position in words, bits."""

    key: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    bits: np.ndarray

    def take(self, which: np.ndarray) -> Entries:
        return Entries(*(x[which] for x in self))


def _join(parts: list[Entries]) -> Entries:
    return Entries(*map(np.concatenate, zip(*parts, strict=True))) if parts else Entries(*(np.zeros(0, t) for t in ("u8", "i8", "u4", "u1")))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte by byte: planes of zeros compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T.tobytes()


def _unplanes(raw: bytes, n: int, width: int, kind: str) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view(kind).ravel()


def pack(e: Entries, key_bytes: int) -> bytes:
    """Entries, ordered by document and position, as compressed bytes."""
    step = lambda x, kind: np.diff(x.astype(kind), prepend=np.zeros(1, kind))
    body = _planes(step(e.doc, "i8"), 8) + _planes(step(e.pos, "u4"), 4) + e.bits.tobytes()
    keys = _planes(e.key, key_bytes)  # random: not worth a compressor's time
    packed = zstandard.ZstdCompressor(level=1).compress(body)
    return len(e.key).to_bytes(4, "little") + bytes([key_bytes]) + keys + packed


def unpack(raw: bytes) -> Entries:
    """Entries of :func:`pack`."""
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    end = 5 + n * width
    body = zstandard.ZstdDecompressor().decompress(raw[end:])
    doc = np.cumsum(_unplanes(body[: 8 * n], n, 8, "i8"))
    pos = np.cumsum(_unplanes(body[8 * n : 12 * n], n, 4, "u4"), dtype="u4")
    return Entries(_unplanes(raw[5:end], n, width, "u8"), doc, pos, np.frombuffer(body[12 * n :], np.uint8))


class Groups(NamedTuple):
    """Entries ordered by key: the order, each ordered entry's group and each group's first place."""

    order: np.ndarray
    group: np.ndarray
    first: np.ndarray


def _groups(key: np.ndarray) -> Groups:
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return Groups(order, np.cumsum(new) - 1, np.flatnonzero(new))


def _shared(e: Entries, g: Groups) -> tuple[np.ndarray, np.ndarray]:
    """For each ordered entry: whether its key stands in several documents, and whether one of them is an index block."""
    doc = e.doc[g.order]
    several = np.minimum.reduceat(doc, g.first) != np.maximum.reduceat(doc, g.first)
    bits = np.bitwise_or.reduceat(e.bits[g.order], g.first)
    several |= bits & _MARKED > 0  # one entry stands for several documents, its own among them
    return several[g.group], (bits & _ANCHOR)[g.group]


def combine_probes(e: Entries) -> tuple[Entries, Entries]:
    """(marked, to send) of a slice: what several of its documents share is marked, if it wasn't, and sent as one entry."""
    g = _groups(e.key)
    several, anchor = _shared(e, g)
    own = e.take(g.order)
    lead = np.zeros(len(own.key), bool)
    lead[g.first] = True
    new = several & (own.bits & _MARKED == 0)
    marked = own.take(new)._replace(bits=np.full(int(new.sum()), _ANCHOR, np.uint8))
    sent = own._replace(bits=np.where(several, anchor | _MARKED, own.bits)).take(~several | lead)
    return marked, sent


def once_each(e: Entries) -> tuple[Entries, Entries]:
    """(first, waiting) of entries to send, which are ordered by key and of one document for each key: the first of each key, and its other places."""
    lead = np.ones(len(e.key), bool)
    lead[1:] = e.key[1:] != e.key[:-1]
    if lead.all():
        return e, e.take(slice(0, 0))
    first = e.take(lead)._replace(bits=np.bitwise_or.reduceat(e.bits, np.flatnonzero(lead)))
    return first, e._replace(bits=e.bits | np.uint8(_WAITS)).take(~lead)


def awaited(e: Entries, first: np.ndarray) -> Entries:
    """Entries of documents without those that wait in vain: ``first`` tells, for each, the entry of its document that it
    waits for, by the same number that this has itself."""
    waits = e.bits & _WAITS > 0
    if not waits.any():
        return e
    of = wordhash.mix(wordhash.mix(e.doc.view(np.uint64)) ^ first.astype(np.uint64))
    keep = ~waits
    keep[waits] = np.isin(of[waits], of[~waits])
    return e._replace(bits=e.bits & np.uint8(~_WAITS & 0xFF)).take(keep)


def match_probes(e: Entries) -> Entries:
    """Entries whose key stands in several documents and that weren't marked before; the bit tells hits of the index."""
    g = _groups(e.key)
    several, anchor = _shared(e, g)
    own = e.take(g.order)
    new = several & (own.bits & _MARKED == 0)
    return own._replace(bits=anchor).take(new)


def combine_windows(e: Entries) -> tuple[Entries, Entries]:
    """(repeated, to send) of a slice: only the smallest document's windows may still be first."""
    g = _groups(e.key)
    own = e.take(g.order)
    later = own.doc > np.minimum.reduceat(own.doc, g.first)[g.group]
    return own.take(later), own.take(~later)


def match_windows(e: Entries) -> Entries:
    """Windows that a smaller document has too."""
    return combine_windows(e)[0]


_PACKED = "part int, marked boolean, packed binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("marked", pa.bool_()), ("packed", pa.binary())])


class Route(NamedTuple):
    """How entries reach the task that compares them: hash ranges for probes, groups of documents for marked ones.

    ``whole`` are the bytes of a key, ``short`` those that tell keys of a range apart, ``marked`` those of
    a marked entry's key; the lowest 24 bits of a key give its range.
    """

    ranges: int
    fan: int
    slice_words: int
    whole: int
    short: int
    marked: int
    deal: int = DEAL_RANGES


def _probe_route(ranges: int, fan: int, slice_words: int, deal: int) -> Route:
    return Route(ranges, fan, slice_words, 7, 4, 7, deal)


def _window_route(ranges: int, fan: int, slice_words: int, deal: int) -> Route:
    return Route(ranges, fan, slice_words, 8, 8, 0, deal)


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return (key & np.uint64(0xFFFFFF)) % np.uint64(ranges)


def _coarse(number, r: Route):
    return number * r.fan // r.ranges if r.ranges > r.fan else number


def _send(e: Entries, marked: bool, r: Route, fine: bool = False, key_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows of entries, one for each range or group of documents; coarse ones where there are many, unless ``fine``."""
    number = wordhash.mix(e.doc.view(np.uint64)) % np.uint64(r.ranges) if marked else _range_of(e.key, r.ranges)
    width = key_bytes or (r.marked if marked else r.whole)
    if r.ranges > r.fan and not fine:
        number = number * np.uint64(r.fan) // np.uint64(r.ranges)
    elif not marked and r.short < r.whole:
        e, width = e._replace(key=e.key >> np.uint64(24)), r.short
    order = np.lexsort((e.pos, e.doc, number))
    e, number = e.take(order), number[order]
    starts = np.flatnonzero(np.diff(number.view(np.int64), prepend=-1)).tolist()
    ends = [*starts[1:], len(number)]
    for k in range(0, len(starts), 256):
        own = [e.take(slice(a, b)) for a, b in zip(starts[k : k + 256], ends[k : k + 256], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(number[starts[k : k + 256]].astype(np.int32)), pa.array([marked] * len(own)), pa.array([pack(x, width) for x in own], pa.binary())], schema=_SCHEMA)


def _deal(packed: DataFrame, r: Route, combine: Callable[[Entries], tuple[Entries, Entries]] | None = None) -> DataFrame:
    """Packets of coarse ranges combined and packed anew for the fine ones; as they are if there are few.

    A coarse range is dealt to several tasks if it is large; each does a part of it alone.
    """
    if r.ranges <= r.fan:
        return packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entries]] = {}  # marked ones by the width of their keys, the others as -1
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for width, parts in held.items():
                if not parts:
                    continue
                e = _join(parts)
                if width < 0 and combine:
                    marked, e = combine(e)
                    yield from _send(marked, True, r, True)
                yield from _send(e, width >= 0, r, True, max(width, 0))
                parts.clear()

        for batch in batches:
            for marked, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                e = unpack(raw)
                held.setdefault(raw[4] if marked else -1, []).append(e)
                n += len(e.doc)
                if n >= r.slice_words:
                    yield from flush()
                    n = 0
        yield from flush()

    shards = math.ceil(r.ranges / r.fan / r.deal)
    dealt = packed.withColumn("task", F.col("part") * shards + F.spark_partition_id() % shards)
    return dealt.repartitionById(r.fan * shards, F.col("task")).mapInArrow(run, _PACKED)


def _by_part(packed: DataFrame, r: Route) -> DataFrame:
    """A partition for each range, or as many ranges for each: hashing would put several into one and none into others."""
    return packed.repartitionById(min(r.ranges, MOST_PARTITIONS), F.col("part"))


def _probes(docs: DataFrame, r: Route) -> DataFrame:
    """Rolling windows of every document: marked ones by documents, the others by hash range."""

    def flush(held: list[Entries]) -> Iterator[pa.RecordBatch]:
        whole = lambda e: e._replace(key=e.key >> np.uint64(32) << np.uint64(24) | _range_of(e.key, r.ranges))
        marked, sent = combine_probes(_join(held))
        sent, waiting = once_each(sent)
        yield from _send(whole(marked), True, r)
        yield from _send(whole(waiting), True, r)
        yield from _send(whole(sent), False, r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                h = wordhash.words(text.as_buffer().to_pybytes())
                if len(h) < WINDOW:
                    continue
                h = wordhash.windows(h, BLOCK)
                pos = np.arange(len(h), dtype=np.uint32)
                held.append(Entries(h, np.full(len(h), doc, np.int64), pos + np.uint32(at), (pos % BLOCK == 0).astype(np.uint8)))
                n += len(h)
                if n >= r.slice_words:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return small_batches(docs).mapInArrow(run, _PACKED)


def _meet(packed: DataFrame, r: Route, match: Callable[[Entries], Entries], combine: Callable[[Entries], tuple[Entries, Entries]]) -> DataFrame:
    """Marked rows: what ``match`` finds in each hash range, and those that were marked before or wait."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        done, sent = rows.filter(rows.column("marked")), rows.filter(pc.invert(rows.column("marked")))
        done = done.set_column(0, "part", pa.array([_coarse(part, r)] * done.num_rows, pa.int32()))
        found: list[pa.RecordBatch] = []
        if sent.num_rows:
            e = match(_join([unpack(x) for x in sent.column("packed").to_pylist()]))
            found = list(_send(e._replace(key=e.key << np.uint64(24) | np.uint64(part)) if r.short < r.whole else e, True, r))
        return pa.concat_tables([done.cast(_SCHEMA), pa.Table.from_batches(found, _SCHEMA)])

    return _by_part(_deal(packed, r, combine), r).groupBy("part").applyInArrow(run, _PACKED)


def _in_order(packed: list[bytes], by_place: bool) -> Entries:
    """Entries by document and position, each once; others wait for the first of a key, or for the place that their key names."""
    e = _join([unpack(x) for x in packed])
    e = awaited(e, np.where(e.bits & _WAITS > 0, e.key, e.pos) if by_place else e.key)
    e = e.take(np.lexsort((~e.bits, e.pos, e.doc)))
    new = np.ones(len(e.pos), bool)
    new[1:] = (e.doc[1:] != e.doc[:-1]) | (e.pos[1:] != e.pos[:-1])
    return e.take(new)


def _repeats(hits: DataFrame, of: Route, r: Route) -> DataFrame:
    """From documents' hits (routed by ``of``): 50-word windows of maximal repeats, repeated ones by documents, others by hash range."""

    def run(rows: pa.Table) -> pa.Table:
        e = _in_order(rows.column("packed").to_pylist(), False)
        new = np.ones(len(e.pos), bool)
        new[1:] = (e.doc[1:] != e.doc[:-1]) | (e.pos[1:] != e.pos[:-1] + 1)
        run_of = np.cumsum(new) - 1  # runs of consecutive shared windows: maximal repeats
        hit = np.zeros(int(new.sum()), bool)
        hit[run_of[e.bits & _ANCHOR > 0]] = True
        k = max(0, len(e.pos) - BLOCK)
        whole = (run_of[:k] == run_of[BLOCK:]) & hit[run_of[:k]]
        key = wordhash.mix(wordhash.mix(e.key[:k][whole]) * np.uint64(0x9FB21C651E98DF25) + e.key[BLOCK:][whole])
        found: list[pa.RecordBatch] = []
        if len(key):
            repeated, sent = combine_windows(Entries(key, e.doc[:k][whole], e.pos[:k][whole], np.zeros(len(key), np.uint8)))
            first, waiting = once_each(sent)
            if len(waiting.key):  # their keys become the places of the first ones
                place = first.pos[np.searchsorted(first.key, waiting.key)]
                found += _send(waiting._replace(key=place.astype(np.uint64)), True, r, key_bytes=4)
            found += [*_send(repeated, True, r), *_send(first, False, r)]
        return pa.Table.from_batches(found, _SCHEMA)

    return _by_part(_deal(hits, of), of).groupBy("part").applyInArrow(run, _PACKED)


def _spans(found: DataFrame, r: Route) -> DataFrame:
    """(doc_id, spans): the word ranges that each document loses."""

    def run(rows: pa.Table) -> pa.Table:
        e = _in_order(rows.column("packed").to_pylist(), True)
        new = np.ones(len(e.pos), bool)
        other = np.ones(len(e.pos), bool)
        other[1:] = e.doc[1:] != e.doc[:-1]
        new[1:] = other[1:] | (e.pos[1:] > e.pos[:-1] + WINDOW)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(e.pos))[: len(first)] - 1
        spans = pa.StructArray.from_arrays([pa.array(e.pos[first].astype(np.int32)), pa.array(e.pos[last].astype(np.int32) + np.int32(WINDOW))], ["start", "stop"])
        cuts = np.append(np.flatnonzero(other[first]), len(first))
        return pa.table({"doc_id": e.doc[np.flatnonzero(other)], "spans": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans)})

    return _by_part(_deal(found, r), r).groupBy("part").applyInArrow(run, "doc_id bigint, spans array<struct<start:int,stop:int>>")


def _places(texts: DataFrame) -> DataFrame | None:
    """(doc_id, text_key, at): the first word position of texts that share an id with others, if not 0; None if no id has several."""
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_key"), (F.octet_length("text") / 2 + WINDOW + 1).cast("long").alias("room"))
    several = table(keyed.groupBy("doc_id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low < high").select("doc_id"))
    if several.isEmpty():
        return None
    each = keyed.join(several, "doc_id", "left_semi").groupBy("doc_id", "text_key").agg(F.max("room").alias("room"))
    end = F.sum("room").over(Window.partitionBy("doc_id").orderBy("text_key"))
    places = table(each.withColumn("end", end).select("doc_id", "text_key", (F.col("end") - F.col("room")).alias("at"), "end"))
    if not places.filter(F.col("end") > MOST_POSITIONS).isEmpty():
        raise ValueError("the different texts of one id hold more words than a document has positions")
    return places.filter("at > 0").drop("end")


def _placed(rows: DataFrame, key: str, text: str, places: DataFrame | None) -> DataFrame:
    """Rows with ``at``, the first word position of their text."""
    if places is None:
        return rows.withColumn("at", F.lit(0).cast("long"))
    own = places.select(F.col("doc_id").alias(key), F.col("text_key").alias("own text key"), F.col("at").alias("own place"))
    placed = rows.withColumn("own text key", F.xxhash64(text)).join(own, [key, "own text key"], "left")
    return placed.withColumn("at", F.coalesce("own place", F.lit(0))).drop("own text key", "own place")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_words: int = SLICE_WORDS, range_bytes: int = RANGE_BYTES, fan: int = FAN, deal: int = DEAL_RANGES, places: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans): the word ranges that are removed, one row for each document that has some; positions by ``places``."""
    texts = _texts(docs, id_col, text_col)
    ranges = max(1, math.ceil(text_bytes(texts, "text") / range_bytes))
    probes, windows = _probe_route(ranges, fan, slice_words, deal), _window_route(ranges, fan, slice_words, deal)
    placed = _placed(texts, "doc_id", "text", places).select("doc_id", "text", "at")
    hits = _meet(_probes(placed, probes), probes, match_probes, combine_probes)
    return _spans(_meet(_repeats(hits, probes, windows), windows, match_windows, combine_windows), windows)


def own_spans(spans: list[dict] | None, at: int, words: int) -> list[dict] | None:
    """Of a document's ranges those of the text at a position, counted from its first word."""
    return spans and [{"start": s["start"] - at, "stop": s["stop"] - at} for s in spans if at <= s["start"] < at + words]


def cut(raw: bytes, spans: list[dict] | None, at: int = 0) -> tuple[bytes, int, int]:
    """A text without the words of some ranges (and the white space after them), its words and those removed."""
    starts, _ = wordhash.spans(raw)
    spans = own_spans(spans, at, len(starts))
    if not spans:
        return raw, len(starts), 0
    bounds = [*starts.tolist(), len(raw)]
    out, at, gone = [], 0, 0
    for span in spans:
        a, b = (min(span[k], len(starts)) for k in ("start", "stop"))
        out.append(raw[at : bounds[a]])
        at = bounds[b]
        gone += b - a
    return b"".join([*out, raw[at:]]), len(starts), gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "words", **sizes: int) -> DataFrame:
    """All columns of each row, the text without its repeated windows, and the struct ``out``: n_words, n_removed.

    Rows are only joined to the windows that they lose; ``sizes`` go to :func:`removed_spans`.
    """
    names = docs.columns
    places = _places(_texts(docs, id_col, text_col))
    spans = removed_spans(docs, id_col, text_col, **sizes, places=places)
    key = "own key"
    joined = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).cast("long").alias(key), F.col(text_col).alias("own text"))
    joined = _placed(joined, key, "own text", places).join(spans.withColumnRenamed("doc_id", key).hint("merge"), key, "left").select("row", "own text", "spans", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, lost, at in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if not text.is_valid:
                    new, n, m = None, 0, 0
                else:
                    new, n, m = cut(text.as_buffer().to_pybytes(), lost.as_py(), at)
                texts.append(new)
                counts.append(n)
                gone.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["row", "new", "n_words", "n_removed"])

    schema = StructType([joined.schema["row"], *StructType.fromDDL("new string, n_words bigint, n_removed bigint")])
    done = joined.mapInArrow(run, schema)
    columns = [F.col("new").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]
    return done.select(*columns, F.struct("n_words", "n_removed").alias(out))


def digests(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of each row."""
    clean = dedup(docs.select("doc_id", "text"), **sizes)
    text = F.coalesce("text", F.lit(""))
    kept = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return clean.select("doc_id", "words.n_words", "words.n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`digests`: every window of every document."""
    return r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
rep AS (SELECT DISTINCT doc_id, i FROM win JOIN first USING (h) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, (SELECT unnest(range(50)) AS k)),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
