"""Matroska audio columns: byte payloads stored as 8-bit samples, and the packet tables of files.

``mux`` writes a payload as one PCM track: clusters of laced blocks, and cues to each cluster.
``demux`` reads any file of that kind back: variable-length EBML elements (known and unknown
sizes), clusters, Xiph, EBML and fixed lacing, simple blocks and block groups, and cues.

Defined cases: a null text counts as empty and is stored as 64 zero bytes; truncated or foreign
bytes give the packets that are whole and a ``problem``; repeated rows each give their row; empty
tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, per_batch

# Element identifiers of the published Matroska and EBML specifications.
EBML, VOID = 0x1A45DFA3, 0xEC
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
RATE, CHANNELS, DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE = 0x4282
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
LEVEL_ONE = {INFO, TRACKS, CLUSTER, CUES}

UNIT = 64
SAMPLE_RATE = 8000
FRAME = 256
LACE = 8
BLOCKS_A_CLUSTER = 16


def vint(n: int) -> bytes:
    """A size as the shortest variable-length integer; all ones stays reserved."""
    w = 1
    while n >= (1 << 7 * w) - 1:
        w += 1
    return ((1 << 7 * w) | n).to_bytes(w, "big")


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def element(n: int, body: bytes) -> bytes:
    return _id(n) + vint(len(body)) + body


def _uint(n: int, v: int) -> bytes:
    return element(n, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def _lacing(frames: list[bytes]) -> tuple[int, bytes]:
    """(flag bits, head): fixed if all sizes agree, else the shorter of Xiph and EBML lacing."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1])
    xiph = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    ebml = vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1]):
        w = 1
        while not -(1 << 7 * w - 1) < b - a < (1 << 7 * w - 1):
            w += 1
        ebml += ((1 << 7 * w) | (b - a + (1 << 7 * w - 1) - 1)).to_bytes(w, "big")
    return (0x02, bytes([len(frames) - 1]) + xiph) if len(xiph) < len(ebml) else (0x06, bytes([len(frames) - 1]) + ebml)


def mux(payload: bytes) -> bytes:
    """A Matroska file with ``payload`` as unsigned 8-bit mono samples of track 1."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    audio = element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    info = _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE))
    head = element(INFO, info) + element(TRACKS, element(TRACK_ENTRY, entry))
    body, cues, step = [head], [], LACE * BLOCKS_A_CLUSTER
    size = len(head)
    for c in range(0, len(frames), step):
        time = c * FRAME * 1000 // SAMPLE_RATE
        inner = [_uint(TIMESTAMP, time)]
        for b in range(c, min(c + step, len(frames)), LACE):
            own = frames[b : b + LACE]
            flag, lace = _lacing(own)
            at = b * FRAME * 1000 // SAMPLE_RATE - time
            inner.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at, 0x80 | flag) + lace + b"".join(own)))
        cluster = element(CLUSTER, b"".join(inner))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, size))))
        body.append(cluster)
        size += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What ``demux`` read: packets are (track, time in ns, start, size, key, lacing, cluster)."""

    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    scale: int = 1_000_000
    problem: str | None = None


def _vint_at(data: bytes, at: int, end: int, mark: bool) -> tuple[int, int]:
    """(value, next position); with ``mark`` the length bit stays in. A size of all ones is -1."""
    if at >= end or not data[at]:
        raise ValueError(f"no integer at byte {at}")
    w = 9 - data[at].bit_length()
    if at + w > end:
        raise ValueError(f"integer cut off at byte {at}")
    v = int.from_bytes(data[at : at + w], "big")
    if mark:
        return v, at + w
    v &= (1 << 7 * w) - 1
    return (-1 if v == (1 << 7 * w) - 1 else v), at + w


def _block(data: bytes, at: int, end: int, time: int, m: Media, cluster: int, key: bool | None) -> None:
    track, at = _vint_at(data, at, end, False)
    if at + 3 > end:
        raise ValueError(f"block cut off at byte {at}")
    shift, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags & 0x06
    if not kind:
        sizes = [end - at]
    else:
        if at >= end:
            raise ValueError(f"lacing cut off at byte {at}")
        n, sizes = data[at] + 1, []
        at += 1
        if kind == 0x04:
            if (end - at) % n:
                raise ValueError(f"fixed lacing doesn't divide at byte {at}")
            sizes = [(end - at) // n] * n
        else:
            for i in range(n - 1):
                if kind == 0x02:
                    size = 0
                    while at < end and data[at] == 255:
                        size, at = size + 255, at + 1
                    if at >= end:
                        raise ValueError(f"lacing cut off at byte {at}")
                    size, at = size + data[at], at + 1
                else:
                    raw, to = _vint_at(data, at, end, False)
                    size = raw if not i else sizes[-1] + raw - (1 << 7 * (to - at) - 1) + 1
                    at = to
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
            if min(sizes) < 0:
                raise ValueError(f"lacing is longer than its block at byte {at}")
    for size in sizes:
        m.packets.append((track, (time + shift) * m.scale, at, size, bool(flags & 0x80) if key is None else key, kind, cluster))
        at += size


def demux(data: bytes) -> Media:
    """Tracks, clusters, packets and cues of a file; what precedes a fault is kept."""
    m = Media()

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def children(at: int, end: int, parent: int):
        while at < end:
            n, body = _vint_at(data, at, end, True)
            size, body = _vint_at(data, body, end, False)
            if size < 0:  # unknown: up to the next element that can't be a child
                if n not in (SEGMENT, CLUSTER):
                    raise ValueError(f"unknown size at byte {at}")
                stop = end if n == SEGMENT else _cluster_end(body, end)
            else:
                stop = body + size
            if stop > end:
                yield n, at, body, end
                raise ValueError(f"element cut off at byte {at}")
            yield n, at, body, stop
            at = stop

    def _cluster_end(at: int, end: int) -> int:
        while at < end:
            n, body = _vint_at(data, at, end, True)
            if n in LEVEL_ONE or n == SEGMENT:
                return at
            size, body = _vint_at(data, body, end, False)
            at = body + size
        return end

    def audio(a: int, b: int, into: dict) -> None:
        for n, _, s, e in children(a, b, AUDIO):
            if n == RATE:
                into["rate"] = struct.unpack(">d" if e - s == 8 else ">f", data[s:e])[0]
            elif n in (CHANNELS, DEPTH):
                into["channels" if n == CHANNELS else "depth"] = number(s, e)

    def track(a: int, b: int) -> None:
        own: dict = {}
        m.tracks.append(own)
        for n, _, s, e in children(a, b, TRACK_ENTRY):
            if n == TRACK_NUMBER:
                own["number"] = number(s, e)
            elif n == CODEC_ID:
                own["codec"] = data[s:e].decode("ascii", "replace")
            elif n == AUDIO:
                audio(s, e, own)

    def cluster(a: int, b: int, at: int) -> None:
        m.clusters.append(at)
        time = 0
        for n, _, s, e in children(a, b, CLUSTER):
            if n == TIMESTAMP:
                time = number(s, e)
            elif n == SIMPLE_BLOCK:
                _block(data, s, e, time, m, at, None)
            elif n == BLOCK_GROUP:
                inner = list(children(s, e, BLOCK_GROUP))
                for k, _, x, y in inner:
                    if k == BLOCK:
                        _block(data, x, y, time, m, at, all(i[0] != 0xFB for i in inner))

    def cue(a: int, b: int) -> None:
        time = 0
        for n, _, s, e in children(a, b, CUE_POINT):
            if n == CUE_TIME:
                time = number(s, e)
            elif n == CUE_POSITIONS:
                got = {k: number(x, y) for k, _, x, y in children(s, e, CUE_POSITIONS)}
                m.cues.append((time * m.scale, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))

    try:
        first, *_ = _vint_at(data, 0, len(data), True)
        if first != EBML:
            raise ValueError("no EBML head")
        for n, _, s, e in children(0, len(data), 0):
            if n != SEGMENT:
                continue
            for k, at, a, b in children(s, e, SEGMENT):
                if k == INFO:
                    for i, _, x, y in children(a, b, INFO):
                        if i == TIMESTAMP_SCALE:
                            m.scale = number(x, y)
                elif k == TRACKS:
                    for i, _, x, y in children(a, b, TRACKS):
                        if i == TRACK_ENTRY:
                            track(x, y)
                elif k == CLUSTER:
                    cluster(a, b, at - s)
                elif k == CUES:
                    for i, _, x, y in children(a, b, CUES):
                        if i == CUE_POINT:
                            cue(x, y)
    except (ValueError, struct.error) as fault:
        m.problem = str(fault)
    return m


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature(payload: bytes, m: Media) -> str:
    """Sample statistics and packet counts as fixed-point text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    share = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16) * 1000 // n
    rms, mean = int((x * x).sum()) * 1000 // n, int(x.sum()) * 1000 // n
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) * 1000 // n
    laced = sum(1 for p in m.packets if p[5])
    last = max((p[1] for p in m.packets), default=0)
    return f"packets={len(m.packets)};laced={laced};clusters={len(m.clusters)};cues={len(m.cues)};last_ns={last};power={rms};mean={mean};crossings={crossings};levels={'-'.join(map(str, share.tolist()))}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a Matroska file."""

    def write(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = blobs(b)
        return pa.record_batch(
            [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, write, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """The packet table: one row per packet with its track, time, byte range and cluster."""

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, data in zip(b.column(key).to_pylist(), b.column(column).to_pylist(), strict=True):
            m = demux(data or b"")
            marked = {c for _, _, c in m.cues}
            out += [
                {key: k, "packet": i, "track": t, "time_ns": ns, "start": s, "size": n, "keyframe": kf, "lacing": lace // 2, "cluster": c, "cued": c in marked}
                for i, (t, ns, s, n, kf, lace, c) in enumerate(m.packets)
            ]
        kinds = [(key, pa.int64()), ("packet", pa.int64()), ("track", pa.int64()), ("time_ns", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster", pa.int64()), ("cued", pa.bool_())]
        return pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    rows = media.select(F.col(key).cast("long").alias(key), F.col(column).alias(column))
    return per_batch(rows, read, f"{key} long, packet long, track long, time_ns long, start long, size long, keyframe boolean, lacing int, cluster long, cued boolean")


def digest(media: DataFrame) -> DataFrame:
    """The contract's columns, from the stored bytes as read back."""

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, n, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            m = demux(data)
            payload = b"".join(data[p[2] : p[2] + p[3]] for p in m.packets)
            out.append(
                {
                    "doc_id": k, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
                    "feature": feature(payload, m), "problem": m.problem,
                }
            )
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("problem", pa.string())]
        return pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return per_batch(media, read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, problem string")
