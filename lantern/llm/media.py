"""Media columns: MPEG transport streams.

``mux`` stores a payload of 8-bit samples as a transport stream of one program with one private stream. The samples go
into elementary packets of ``PES_BYTES``, each with a presentation time that follows from its first sample and ``RATE``, and with a clock
reference in its first transport packet, less than 100 ms apart. Every ``GROUP`` elementary packets the tables (program association and
program map) are sent again, and the elementary packet that follows is a random-access point: a reader that tunes in there has all it needs.

``demux`` reads a stream from its bytes alone: it parses the tables, over several packets where need be, follows the continuity
counters, reassembles the elementary packets and returns the payload with its times and random-access points. It passes
over packets that are marked as damaged, repeated once, or hold no payload, honours the discontinuity flag, and leaves out
elementary packets of which a part is lost.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKET, HEAD, SYNC = 188, 4, 0x47
PAT_PID, PMT_PID, DATA_PID = 0, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT = 192
#: Samples per second of the stored samples, ticks per second of the clock.
RATE, CLOCK = 48_000, 90_000
PES_BYTES, GROUP = 24 * UNIT, 5
TICKS = PES_BYTES * CLOCK // RATE
#: Presentation lags the clock reference by so many ticks.
DELAY = CLOCK // 10


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of a table section, as ISO/IEC 13818-1 has it: not reflected, no final xor."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    data = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return data + b"\xff" * (PACKET - len(data))


_PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(2, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | DATA_PID, 0xF000)))
#: The tables by the number of times they were sent, modulo 16: their packets count on too.
TABLES = [b"".join(t[:3] + bytes([0x10 | k]) + t[4:] for t in (_PAT, _PMT)) for k in range(16)]


def _stamp(ticks: int) -> bytes:
    """A presentation time of 33 bits with its marker bits."""
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 0xFF, (ticks >> 14) & 0xFE | 1, (ticks >> 7) & 0xFF, (ticks << 1) & 0xFE | 1])


def _pes(data: bytes, ticks: int) -> bytes:
    length = len(data) + 8
    return b"\0\0\1" + bytes([STREAM_ID]) + struct.pack(">H", length if length < 65536 else 0) + b"\x84\x80\x05" + _stamp(ticks) + data


def _packets(unit: bytes, counter: int, ticks: int, random_access: bool) -> tuple[np.ndarray, int]:
    """Transport packets of one elementary packet, and the next continuity counter."""
    first_room = PACKET - HEAD - 8  # the first packet has an adaptation field with flags and a clock reference
    room = PACKET - HEAD
    n = len(unit)
    if n < first_room:
        counts, stuffing_first = 1, first_room - n
    else:
        counts, stuffing_first = 1 + -(-(n - first_room) // room), 0
    out = np.full((counts, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = DATA_PID >> 8
    out[0, 1] |= 0x40
    out[:, 2] = DATA_PID & 0xFF
    out[:, 3] = 0x10 | (np.arange(counter, counter + counts) & 15)
    out[0, 3] |= 0x20
    out[0, 4] = 7 + stuffing_first
    out[0, 5] = 0x10 | (0x40 if random_access else 0)
    out[0, 6:12] = list(struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00))
    data = np.frombuffer(unit, np.uint8)
    take = min(n, first_room)
    out[0, 12 + stuffing_first :] = data[:take]
    rest = data[take:]
    if counts > 1:
        whole = (counts - 2) * room
        out[1:-1, HEAD:] = rest[:whole].reshape(-1, room)
        tail = rest[whole:]
        gap = room - len(tail)
        if gap:  # an adaptation field fills the last packet
            out[-1, 3] |= 0x20
            out[-1, 4] = gap - 1
            if gap > 1:
                out[-1, 5] = 0
        out[-1, HEAD + gap :] = tail
    return out, counter + counts


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream. An empty payload gives the tables alone."""
    parts, counter = [] if payload else [TABLES[0]], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        if k % GROUP == 0:
            parts.append(TABLES[k // GROUP % 16])
        packets, counter = _packets(_pes(payload[at : at + PES_BYTES], DELAY + k * TICKS), counter, k * TICKS, k % GROUP == 0)
        parts.append(packets.tobytes())
    return b"".join(parts)


class Stream:
    """What a transport stream holds.

    ``payload``, and per whole elementary packet ``pts`` and ``offsets`` (into the payload); ``random_access`` are the offsets where a
    reader may begin. ``counter_errors`` counts breaks of the continuity counter, ``damaged`` elementary packets that are left out as a part of
    them is missing, ``repeated`` packets that came twice. ``clock`` are the clock references.
    """

    __slots__ = ("payload", "pid", "stream_type", "pts", "offsets", "random_access", "clock", "counter_errors", "damaged", "repeated", "packets")


def _sections(p: np.ndarray) -> Iterator[bytes]:
    """Whole table sections of the packets of one PID, those that run over several packets included."""
    held = b""
    for q in p:
        raw = q.tobytes()
        if not raw[3] & 0x10 or raw[1] & 0x80:
            continue
        data = raw[HEAD + (raw[4] + 1 if raw[3] & 0x20 else 0) :]
        if raw[1] & 0x40:
            begin = 1 + data[0]
            held, data = held + data[1:begin] if held else b"", data[begin:]
            yield from _cut(held)
            held = data
        elif held:
            held += data
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + (struct.unpack(">H", held[1:3])[0] & 0x0FFF)):
            yield held[:n]
            held = held[n:]
        if held[:1] == b"\xff":
            held = b""


def _cut(held: bytes) -> Iterator[bytes]:
    if len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + (struct.unpack(">H", held[1:3])[0] & 0x0FFF)):
        yield held[:n]


def _table(p: np.ndarray, table_id: int) -> bytes:
    """Body of the first sound section of a kind that is in force."""
    for section in _sections(p):
        if section[0] == table_id and not crc32_mpeg(section) and section[5] & 1:
            return section[8:-4]
    raise ValueError("no sound table")


def _followed(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Packets that bring payload, whether a break comes before each, and the numbers of breaks and of repeated packets."""
    control = own[:, 3] >> 4 & 3
    own = own[(control & 1 == 1) & (own[:, 1] & 0x80 == 0)]
    counters = own[:, 3] & 15
    broken = np.zeros(len(own), bool)
    if len(own) < 2:
        return own, broken, 0, 0
    step = (counters[1:] - counters[:-1]) & 15
    same = np.zeros(len(own), bool)
    if (step == 0).any():  # a packet may come twice in a row, byte for byte but for its clock reference
        for i in (np.flatnonzero(step == 0) + 1).tolist():
            clock = own[i, 3] & 0x20 and own[i, 4] >= 7 and own[i, 5] & 0x10
            a, b = own[i].copy(), own[i - 1].copy()
            if clock:
                a[6:12] = b[6:12] = 0
            same[i] = not same[i - 1] and bool((a == b).all())
        own, counters = own[~same], counters[~same]
        step = (counters[1:] - counters[:-1]) & 15
    told = (own[1:, 3] & 0x20 != 0) & (own[1:, 4] > 0) & (own[1:, 5] & 0x80 != 0)
    broken = np.concatenate([[False], (step != 1) & ~told])
    return own, broken, int(broken.sum()), int(same.sum())


def demux(stream: bytes, program: int | None = None, whole: bool = False) -> Stream:
    """Read one program's first elementary stream back (without a number: the first program).

    With ``whole`` anything lost raises ValueError; else it shows in the counts. Lost sync or no sound table always raises ValueError.
    """
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = ((p[:, 1].astype(np.uint16) & 0x1F) << 8) | p[:, 2]
    out = Stream()
    pat = _table(p[pid == PAT_PID], 0)
    programs = {n: v & 0x1FFF for n, v in struct.iter_unpack(">HH", pat) if n}  # number 0 names the network's PID
    if not programs or program is not None and program not in programs:
        raise ValueError("no such program")
    pmt = _table(p[pid == programs[next(iter(programs)) if program is None else program]], 2)
    info = struct.unpack(">H", pmt[2:4])[0] & 0x0FFF
    if len(pmt) < 9 + info:
        raise ValueError("the program has no stream")
    out.stream_type, es = struct.unpack(">BH", pmt[4 + info : 7 + info])
    out.pid = es & 0x1FFF
    own, broken, out.counter_errors, out.repeated = _followed(p[pid == out.pid])
    out.packets = len(own)
    adapt = own[:, 3] & 0x20 != 0
    start = HEAD + np.where(adapt, own[:, 4].astype(np.int64) + 1, 0)
    begins = own[:, 1] & 0x40 != 0
    flags = np.where(adapt & (own[:, 4] > 0), own[:, 5], 0)
    out.clock = [int.from_bytes(q[6:10].tobytes()) << 1 | int(q[10]) >> 7 for q in own[flags & 0x10 != 0]]
    data = own[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(np.maximum(PACKET - start, 0))
    at = np.concatenate([[0], ends])[:-1].astype(np.int64)
    firsts = np.flatnonzero(begins)
    bounds = [*at[firsts].tolist(), len(data)]
    inner = broken & ~begins
    lost = np.add.reduceat(inner, firsts) > 0 if len(firsts) else np.zeros(0, bool)
    pieces, out.pts, out.offsets, out.random_access, out.damaged, size = [], [], [], [], 0, 0
    for k, i in enumerate(firsts.tolist()):
        unit = data[bounds[k] : bounds[k + 1]]
        length = struct.unpack(">H", unit[4:6])[0] if len(unit) >= 6 else 0
        if lost[k] or unit[:3] != b"\0\0\1" or len(unit) < 14 or length and len(unit) != length + 6:
            out.damaged += 1
            continue
        t = unit[9:14]
        out.pts.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        out.offsets.append(size)
        if flags[i] & 0x40:
            out.random_access.append(size)
        piece = unit[9 + unit[8] :]
        size += len(piece)
        pieces.append(piece)
    if whole and (out.damaged or out.counter_errors or len(own) and not begins[0]):
        raise ValueError("a part of the stream is lost")
    out.payload = b"".join(pieces)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text (null: none), filled with spaces up to a positive multiple of ``UNIT``."""
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % UNIT if data else UNIT)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, pts array<long>, random_access array<long>"
)


def _digest(text: str | None) -> tuple:
    n, payload = payload_of(text)
    media = mux(payload)
    got = demux(media, whole=True)
    back = got.payload
    x = np.frombuffer(back, np.uint8).astype(np.float64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    ms = (got.pts[-1] - got.pts[0] + len(back[got.offsets[-1] :]) * CLOCK // RATE) * 1000 // CLOCK
    feature = f"ms={ms};packets={got.packets};pes={len(got.pts)};access={len(got.random_access)};mean={x.mean():.3f};rms={np.sqrt((x * x).mean()):.3f};crossings={crossings}"
    return (
        n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, got.pts, got.random_access,
    )


def media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # a bounded number of texts at a time
            part = batch.slice(at, 256)
            rows = [_digest(t) for t in part.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)


def store_documents(documents: DataFrame) -> DataFrame:
    """Store every text as a transport stream and read it back.

    One row per input row, also for repeated ones and those without doc_id; a null text is the empty text, whose payload is 192 spaces. Only doc_id
    and text are read, so other columns may have any names; an empty table gives no rows. The work is row by row: no shuffle, and a worker holds
    a batch of texts and the stream of one of them, however long.
    """
    return documents.select("doc_id", "text").mapInArrow(media_batches, SCHEMA)
