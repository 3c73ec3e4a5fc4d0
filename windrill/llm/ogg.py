"""Ogg containers as a media column (operator 4).

write_ogg multiplexes two logical streams in one physical stream: packets of 8-bit samples, FRAME samples each, and a stream of
marks, one packet a second of samples. read_ogg verifies the checksum of every page, demultiplexes by serial number, checks page
sequence numbers, reassembles packets from lacing values (also across pages) and derives each packet's time from the granule
position of the page it ends on. Bytes are a function of the payload alone, so equal texts give equal containers.

Cases: null or empty text is one frame of padding. A damaged page, a gap in the sequence, a missing end page or a stream without
its header raises ValueError. Texts of any length are stored whole. Repeated rows are stored each for themselves; further
columns are ignored.
A null doc_id is kept as it is; there are no ties; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read_table

FRAME, RATE = 576, 8000
SAMPLES, MARKS = 0x53414D50, 0x4D41524B  # serial numbers
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, unreflected, started at 0: zlib's, over bytes whose bits are reversed."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = 255) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; packets: (data, granule at its end). The first packet has a page of its own."""
    pages: list[tuple[int, bytes]] = []
    values: list[int] = []
    body: list[bytes] = []
    granule, continued, number = -1, False, 0

    def emit(last: bool) -> None:
        nonlocal granule, continued, number
        flags = (1 if continued else 0) | (2 if number == 0 else 0) | (4 if last else 0)
        pages.append((granule, _page(serial, number, flags, granule, bytes(values), b"".join(body))))
        continued = bool(values) and values[-1] == 255
        values.clear()
        body.clear()
        granule, number = -1, number + 1

    for k, (data, end) in enumerate(packets):
        rest, at = lace(len(data)), 0
        while rest:
            if len(values) == segments:
                emit(False)
            part = rest[: segments - len(values)]
            rest, n = rest[len(part) :], sum(part)
            values += part
            body.append(data[at : at + n])
            at += n
        granule = end
        if k == 0 and len(packets) > 1 or k == len(packets) - 1:
            emit(k == len(packets) - 1)
    return pages


def write_ogg(payload: bytes) -> bytes:
    """payload: a multiple of FRAME bytes."""
    frames = len(payload) // FRAME
    samples = [(b"PCM8" + struct.pack("<II", RATE, FRAME), 0)] + [(payload[k * FRAME : (k + 1) * FRAME], (k + 1) * FRAME) for k in range(frames)]
    marks = [(b"MARK" + struct.pack("<I", RATE), 0)] + [(struct.pack("<Q", t), t) for t in range(RATE, len(payload) + RATE, RATE)]
    a, b = stream_pages(SAMPLES, samples), stream_pages(MARKS, marks)
    body = sorted([(g if g >= 0 else 0, 0, k, p) for k, (g, p) in enumerate(a[1:])] + [(g if g >= 0 else 0, 1, k, p) for k, (g, p) in enumerate(b[1:])]) if len(b) > 1 else []
    return a[0][1] + b[0][1] + b"".join(p for *_, p in body)


def read_pages(raw: bytes):
    """Yields (serial, sequence number, flags, granule, lacing values, body) of every page; checks each checksum."""
    at = 0
    while at < len(raw):
        if raw[at : at + 4] != b"OggS" or len(raw) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", raw, at)
        lacing = raw[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if end > len(raw) or len(lacing) < n:
            raise ValueError("truncated page")
        if page_crc(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : end]) != crc or version:
            raise ValueError(f"bad checksum of the page at byte {at}")
        yield serial, number, flags, granule, lacing, raw[at + 27 + n : end]
        at = end


def read_ogg(raw: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream, with the granule position of the page where the packet is the last to end, else None."""
    streams: dict[int, list] = {}
    state: dict[int, list] = {}  # next number, unfinished parts, ended
    for serial, number, flags, granule, lacing, body in read_pages(raw):
        if serial not in state:
            if not flags & 2:
                raise ValueError("a stream doesn't begin with its first page")
            state[serial], streams[serial] = [0, [], False], []
        s = state[serial]
        if number != s[0] or s[2]:
            raise ValueError("a page is missing or repeated")
        if bool(flags & 1) != bool(s[1]):
            raise ValueError("a packet isn't continued")
        s[0] += 1
        at = begin = 0
        done = 0
        for v in lacing:
            at += v
            if v < 255:
                streams[serial].append((b"".join([*s[1], body[begin:at]]), None))
                s[1] = []
                begin = at
                done += 1
        if begin < at:
            s[1].append(body[begin:at])
        elif lacing and lacing[-1] == 255 and begin == at and not s[1]:
            s[1].append(b"")
        if done and granule >= 0:
            streams[serial][-1] = (streams[serial][-1][0], granule)
        s[2] = bool(flags & 4)
    for s in state.values():
        if s[1] or not s[2]:
            raise ValueError("a stream isn't complete")
    return streams


def packet_times(packets: list[tuple[bytes, int | None]], frame: int = FRAME, rate: int = RATE) -> list[float]:
    """Seconds at which each sample packet ends: counted back from the next granule position at one frame a packet."""
    ends: list[int] = [0] * len(packets)
    at = None
    for k in range(len(packets) - 1, -1, -1):
        at = packets[k][1] if packets[k][1] is not None else at - frame
        ends[k] = at
    return [e / rate for e in ends]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def features(raw: bytes) -> tuple[bytes, str]:
    """(payload, feature string) of a container: pages, sample packets, duration in microseconds, marks, mean x 1000, level
    crossings, loudest frame's sum of squares."""
    pages = sum(1 for _ in read_pages(raw))
    streams = read_ogg(raw)
    head, *frames = streams[SAMPLES]
    magic, rate, frame = struct.unpack("<4sII", head[0])
    if magic != b"PCM8":
        raise ValueError("no sample stream")
    payload = b"".join(p for p, _ in frames)
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    times = packet_times(frames, frame, rate)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    loudest = int((x.reshape(-1, frame).astype(np.int64) ** 2).sum(1).max())
    return payload, f"pages={pages};packets={len(frames)};us={round(times[-1] * 1e6)};marks={len(streams[MARKS]) - 1};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};crossings={crossings};loudest={loudest}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, media."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                rows = [payload_of(t) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([write_ogg(p) for _, p in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> digests of the payload as read back, and features."""

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column("media").to_pylist():
                payload, feature = features(raw)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds))], [x.split()[0] for x in OUT.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, OUT)


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(cut(encode_media(read_table(spark, sf_dir, "documents", "doc_id", "text")), "op4-media"))
