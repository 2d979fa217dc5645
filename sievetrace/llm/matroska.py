"""Matroska media columns: a text's bytes muxed as 8-bit PCM, and any Matroska bytes parsed into packets.

The parser reads variable-length EBML elements (known and unknown sizes), clusters, simple blocks and
block groups, the four lacing forms and the cues, and gives a packet table: track, timestamp, byte range
in the file, lacing, whether a cue points to its cluster.  The muxer writes an 8 kHz, one-channel,
unsigned 8-bit track; its blocks take the lacing forms in turn.

Defined cases: null text is the empty text; a payload is padded with bytes 0 to a positive multiple of
64, so there is always a packet; malformed media gives null packets and payload and a reason in
``error`` (integers of more than 8 bytes are malformed); rows are independent (repeated ids stay, an empty
table gives an empty table); columns are added under names of their own, with ``_`` after one that is taken.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievetrace.llm.runtime import free_name, small_batches

ALIGN = 64
RATE = 8000
FRAME = 1024  # samples; 128 ms
FRAMES_PER_BLOCK = 4
BLOCKS_PER_CLUSTER = 32
SLICE = 128

# Element ids of the Matroska specification (fixed values).
EBML, DOC_TYPE, SEGMENT = 0x1A45DFA3, 0x4282, 0x18538067
INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION = 0x23E383
AUDIO, SAMPLING_RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")  # by the two lacing bits

PACKETS = "array<struct<track:bigint,timestamp_ms:double,byte_start:bigint,byte_end:bigint,lacing:string,keyframe:boolean,cued:boolean>>"
_PACKET = pa.struct([("track", pa.int64()), ("timestamp_ms", pa.float64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("lacing", pa.string()), ("keyframe", pa.bool_()), ("cued", pa.bool_())])


class Packet(NamedTuple):
    """One frame and its place in the file."""

    track: int
    timestamp_ms: float
    byte_start: int
    byte_end: int
    lacing: str
    keyframe: bool
    cued: bool


# -- writing


def size_vint(n: int) -> bytes:
    """A length as the shortest EBML variable-length integer (all ones is kept for 'unknown')."""
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes | int | float | str) -> bytes:
    """An element with its id, length and body."""
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def _signed_vint(n: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def lace(frames: list[bytes], form: int) -> bytes:
    """Lacing header (without the count of a single frame) and the frames."""
    if form == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if form == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif form == 3 and len(frames) > 1:
        head += size_vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            head += _signed_vint(len(b) - len(a))
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file that holds ``payload`` as 8-bit samples."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    blocks: list[tuple[int, bytes]] = []
    turn = 0
    k = 0
    while k < len(frames):
        form = (3, 1, 2, 0)[turn % 4]
        group = frames[k : k + (FRAMES_PER_BLOCK if form else 1)]
        if len(group) == 1:
            form = 0
        elif form == 2 and len({len(f) for f in group}) > 1:
            form = 3
        blocks.append((k, bytes([form << 1 | 0x80]) + lace(group, form)))
        k += len(group)
        turn += 1
    ms = FRAME * 1000 // RATE
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, "sievetrace") + element(WRITER, "sievetrace") + element(DURATION, len(payload) * 1000 / RATE))
    track = element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT") + element(DEFAULT_DURATION, ms * 1_000_000)
    track += element(AUDIO, element(SAMPLING_RATE, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    parts = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    for c in range(0, len(blocks), BLOCKS_PER_CLUSTER):
        own = blocks[c : c + BLOCKS_PER_CLUSTER]
        start = own[0][0] * ms
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, element(CLUSTER_TIME, start) + b"".join(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", k * ms - start) + b) for k, b in own)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, element(0x4286, 1) + element(0x42F7, 1) + element(0x42F2, 4) + element(0x42F3, 8) + element(DOC_TYPE, "matroska") + element(0x4287, 4) + element(0x4285, 2))
    return head + element(SEGMENT, b"".join(parts))


# -- reading


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and end of a variable-length integer; -1 for the reserved all-ones value."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    end = at + width
    if end > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at:end], "big")
    if keep_marker:
        return value, end
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), end


#: Elements that may end one of unknown size: none of them can stand inside a cluster.
_TOP = {SEGMENT, CLUSTER, CUES, INFO, TRACKS, EBML}


def children(data: bytes, start: int, end: int, in_cluster: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) of the elements in a range."""
    at = start
    while at < end:
        ident, body = _vint(data, at, True)
        if in_cluster and ident in _TOP:
            return
        size, body = _vint(data, body)
        stop = body + size
        if size < 0:
            stop = end
            if ident == CLUSTER:
                stop = body
                for _, _, _, stop in children(data, body, end, True):  # noqa: B007
                    pass
        if stop > end:
            raise ValueError(f"element {ident:x} at {at} goes beyond its parent")
        yield ident, at, body, stop
        at = stop


def _number(data: bytes, start: int, end: int) -> int:
    if end - start > 8:
        raise ValueError(f"integer of {end - start} bytes at {start}")
    return int.from_bytes(data[start:end], "big")


def _float(data: bytes, start: int, end: int) -> float:
    form = {0: None, 4: ">f", 8: ">d"}[end - start]
    return struct.unpack(form, data[start:end])[0] if form else 0.0


def unlace(data: bytes, start: int, end: int, form: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames in a block's body."""
    if form == 0:
        return [(start, end)]
    n = data[start] + 1
    at = start + 1
    if form == 2:
        size, odd = divmod(end - at, n)
        if odd:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [size] * n
    else:
        sizes = []
        for k in range(n - 1):
            if form == 1:
                size = 0
                while data[at] == 255:
                    size += 255
                    at += 1
                size += data[at]
                at += 1
            elif k == 0:
                size, at = _vint(data, at)
            else:
                first = at
                raw, at = _vint(data, at, True)
                width = at - first
                size = sizes[-1] + (raw & (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing sizes go beyond the block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> dict:
    """Doc type, tracks, cues and packets of a Matroska file; ValueError if it is malformed."""
    try:
        return _parse(data)
    except (IndexError, KeyError, OverflowError, struct.error) as e:
        raise ValueError(f"malformed: {e!r}") from e


def _parse(data: bytes) -> dict:
    scale, duration, doc_type = 1_000_000, 0.0, ""
    tracks: dict[int, dict] = {}
    cues: list[tuple[int, int, int]] = []
    found: list[tuple[int, int, Iterator]] = []
    seg = 0
    for ident, _, a, b in children(data, 0, len(data)):
        if ident == EBML:
            doc_type = next((data[x:y].decode() for i, _, x, y in children(data, a, b) if i == DOC_TYPE), "")
        elif ident == SEGMENT:
            seg = a
            for i, at, x, y in children(data, a, b):
                if i == INFO:
                    for j, _, p, q in children(data, x, y):
                        scale = _number(data, p, q) if j == TIMESTAMP_SCALE else scale
                        duration = _float(data, p, q) if j == DURATION else duration
                elif i == TRACKS:
                    for _, _, p, q in children(data, x, y):
                        own = {"default_ns": 0, "codec": ""}
                        for j, _, r, s in children(data, p, q):
                            if j == TRACK_NUMBER:
                                own["number"] = _number(data, r, s)
                            elif j == CODEC_ID:
                                own["codec"] = data[r:s].decode()
                            elif j == DEFAULT_DURATION:
                                own["default_ns"] = _number(data, r, s)
                        tracks[own["number"]] = own
                elif i == CUES:
                    for _, _, p, q in children(data, x, y):
                        time, where = 0, []
                        for j, _, r, s in children(data, p, q):
                            if j == CUE_TIME:
                                time = _number(data, r, s)
                            elif j == CUE_POSITIONS:
                                where.append({k: _number(data, t, u) for k, _, t, u in children(data, r, s)})
                        cues += [(time, w.get(CUE_TRACK, 0), w[CUE_CLUSTER]) for w in where]
                elif i == CLUSTER:
                    found.append((at, x, y))
    if not seg:
        raise ValueError("no segment")
    cued = {c for _, _, c in cues}
    packets: list[Packet] = []
    for at, x, y in found:
        base = 0
        for i, _, p, q in children(data, x, y):
            if i == CLUSTER_TIME:
                base = _number(data, p, q)
            elif i in (SIMPLE_BLOCK, BLOCK_GROUP):
                refers = None
                if i == BLOCK_GROUP:
                    within = {j: (r, s) for j, _, r, s in children(data, p, q)}
                    p, q = within[BLOCK]  # a group without one is malformed
                    refers = REFERENCE_BLOCK in within
                track, p = _vint(data, p)
                if track < 0 or p + 3 > q:
                    raise ValueError(f"block at {p} has no track or header")
                time = base + struct.unpack(">h", data[p : p + 2])[0]
                flags = data[p + 2]
                key = not refers if i == BLOCK_GROUP else bool(flags & 0x80)
                form = flags >> 1 & 3
                step = tracks.get(track, {}).get("default_ns", 0) / 1e6
                for n, (r, s) in enumerate(unlace(data, p + 3, q, form)):
                    packets.append(Packet(track, time * scale / 1e6 + n * step, r, s, LACING[form], key, at - seg in cued))
    return {"doc_type": doc_type, "duration_ms": duration * scale / 1e6, "tracks": tracks, "cues": cues, "clusters": len(found), "packets": packets}


def features(data: bytes, parsed: dict) -> str:
    """A line that describes the packets of a file."""
    packets = parsed["packets"]
    forms = {f: sum(p.lacing == f for p in packets) for f in LACING}
    last = packets[-1].timestamp_ms if packets else 0.0
    return f"{parsed['doc_type']};tracks={len(parsed['tracks'])};clusters={parsed['clusters']};cues={len(parsed['cues'])};packets={len(packets)};" + ";".join(f"{k}={v}" for k, v in forms.items()) + f";last_ms={last:g};duration_ms={parsed['duration_ms']:g}"


# -- columns


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (of the text) and ``media`` (a Matroska file) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [write(r.ljust(max(ALIGN, -(-len(r) // ALIGN) * ALIGN), b"\0")) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kept = docs.select(F.col(id_col), F.col(text_col))
    return small_batches(kept).mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_bytes bigint, media binary")


def demux(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of ``media`` and packets, the joined payload, a feature line and an error; no shuffle.

    A keyframe is a simple block that says so, or a block group that refers to no other block.
    """
    names = [f.name for f in media.schema]
    at = names.index(media_col)
    added = []
    for name in ("packets", "payload", "feature", "error"):
        added.append(free_name(name, [*names, *added]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                rows: list[tuple] = []
                for data in part.column(at).to_pylist():
                    try:
                        found = parse(data or b"")
                        rows.append(([p._asdict() for p in found["packets"]], b"".join(data[p.byte_start : p.byte_end] for p in found["packets"]), features(data, found), None))
                    except ValueError as e:
                        rows.append((None, None, None, str(e)))
                new = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.list_(_PACKET), pa.binary(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *added])

    kinds = (PACKETS, "binary", "string", "string")
    new = StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in zip(added, kinds, strict=True)))
    return small_batches(media).mapInArrow(run, StructType([*media.schema, *new]))


def digests(docs: DataFrame) -> DataFrame:
    """The digests of every document's media column, from the bytes that were read back."""
    return demux(mux(docs)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("packets").cast("long").alias("n_packets"),
    )
