"""Media columns: payloads in MPEG transport streams, and what a reader finds in them.

A payload is cut into access units, each in a PES packet with a presentation timestamp, and those into 188-byte
transport packets. Every RAP_EVERY-th unit is a random-access point: program tables go before it, and its first packet
carries the random-access indicator and a clock reference. Reading parses PAT and PMT (with their CRCs), checks the
continuity counters of every PID, reassembles PES packets and keeps timestamps and random-access points.

Defined cases: a null payload gives null media and null features; an empty payload is a stream of tables alone; equal
payloads give equal media; very long payloads are many units, handled one row at a time; repeated rows are stored as often
as they occur; an empty table gives an empty table; other columns pass through, those named like the result (`media`,
`stream`) are replaced. A damaged stream raises nothing: errors are counted in `errors`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_reads, small_batches

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PES_HEADER, PRIVATE_STREAM, PRIVATE_DATA = 14, 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000
# Our own choices.
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES, UNIT_TICKS, RAP_EVERY = 576 * 8, CLOCK // 25, 8


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (CRC_POLYNOMIAL if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, table: int, name: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, name, 0xC1, 0, 0)
    section = head + body
    section += struct.pack(">I", section_crc(section))
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    pat = _table_packet(PAT_PID, 0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _table_packet(PMT_PID, 0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_DATA, 0xE000 | MEDIA_PID, 0xF000))
    return np.frombuffer(pat, np.uint8), np.frombuffer(pmt, np.uint8)


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _clock(pts: int) -> bytes:
    return struct.pack(">IH", pts >> 1 & 0xFFFFFFFF, (pts & 1) << 15 | 0x7E00)


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [], 0
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        rap = unit % RAP_EVERY == 0
        if rap:
            for table in _tables():
                packet = table.copy()
                packet[3] |= unit // RAP_EVERY & 15
                out.append(packet)
        data = payload[at : at + UNIT_BYTES]
        if not data:
            break
        pts = unit * UNIT_TICKS
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _timestamp(pts) + data
        rest = np.frombuffer(pes, np.uint8)
        first = b"\x07\x50" + _clock(pts) if rap else b""
        sizes = [184 - len(first)] if first else []
        full = (len(rest) - sum(sizes)) // 184 if len(rest) > sum(sizes) else 0
        n = len(sizes) + full
        packets = np.full((n + 1, PACKET), 0xFF, dtype=np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2], packets[:, 3] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255, 0x10
        if first:
            lead = min(len(rest), 184 - len(first))
            if lead < 184 - len(first):  # the unit ends here: stuffing goes into the adaptation field
                first = bytes([183 - lead]) + first[1:] + b"\xff" * (184 - lead - len(first))
            packets[0, 3] = 0x30
            packets[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
            packets[0, 4 + len(first) :] = rest[:lead]
            rest = rest[lead:]
        packets[len(sizes) : n, 4:] = rest[: full * 184].reshape(full, 184)
        if len(rest := rest[full * 184 :]):
            pad = 184 - len(rest)
            packets[n, 3] = 0x30
            packets[n, 4] = pad - 1
            if pad > 1:
                packets[n, 5] = 0
            packets[n, 4 + pad :] = rest
            n += 1
        packets = packets[:n]
        packets[0, 1] |= 0x40
        packets[:, 3] |= (counter + np.arange(n) & 15).astype(np.uint8)
        counter += n
        out.append(packets.ravel())
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    """What `demux` finds: payload, timestamps, random-access points as (timestamp, packet), and counts."""

    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    access: list[tuple[int, int]] = field(default_factory=list)
    packets: int = 0
    tables: int = 0
    errors: int = 0


def _section(packet: np.ndarray, table: int) -> bytes | None:
    """Body of the section that starts in this packet, or None if it is not sound."""
    data = packet.tobytes()
    at = 4 + (1 + data[4] if data[3] & 0x20 else 0)
    if at >= PACKET or not data[1] & 0x40:
        return None
    at += 1 + data[at]
    size = struct.unpack_from(">H", data, at + 1)[0] & 0xFFF if at + 3 <= PACKET else PACKET
    section = data[at : at + 3 + size]
    if len(section) != 3 + size or size < 9 or section[0] != table or section_crc(section):
        return None
    return section[8:-4]


_section_of = lru_cache(64)(lambda data, table: _section(np.frombuffer(data, np.uint8), table))


def _sections(packets: np.ndarray, table: int, found: Stream) -> list[bytes]:
    out = []
    for packet in packets:
        packet = packet.copy()
        packet[3] &= 0xF0  # the counter does not matter here
        body = _section_of(packet.tobytes(), table)
        found.tables += body is not None
        found.errors += body is None
        out += [body] if body is not None else []
    return out


def demux(media: bytes) -> Stream:
    data = np.frombuffer(media, np.uint8)
    found = Stream(errors=len(data) % PACKET != 0)
    rows = data[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    synced = rows[:, 0] == SYNC
    found.packets, found.errors = len(rows), found.errors + int((~synced).sum())
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    maps = {p[i + 3] | (p[i + 2] & 0x1F) << 8 for p in _sections(rows[pid == PAT_PID], 0x00, found) for i in range(0, len(p) - 3, 4) if p[i : i + 2] != b"\0\0"}
    streams = set()
    for name in maps:
        for body in _sections(rows[pid == name], 0x02, found):
            at = 4 + ((body[2] & 0x0F) << 8 | body[3])
            while at + 5 <= len(body):
                streams.add((body[at + 1] & 0x1F) << 8 | body[at + 2])
                at += 5 + ((body[at + 3] & 0x0F) << 8 | body[at + 4])
    for name in (PAT_PID, *maps, *streams):
        counters = (rows[(pid == name) & (rows[:, 3] & 0x10 > 0), 3] & 15).astype(np.int16)
        found.errors += int(((np.diff(counters) - 1) % 16 != 0).sum())
    parts = []
    for name in sorted(streams):
        at = np.flatnonzero((pid == name) & (rows[:, 3] & 0x10 > 0) & synced)
        own = rows[at]
        skip = np.where(own[:, 3] & 0x20, 5 + own[:, 4].astype(np.int32), 4)
        elementary = own[np.arange(PACKET) >= skip[:, None]]
        starts = np.concatenate([[0], np.cumsum(np.maximum(PACKET - skip, 0))])
        units = np.flatnonzero(own[:, 1] & 0x40)
        if len(at) and (not len(units) or units[0]):
            found.errors += 1
        for i, end in zip(units, [*units[1:], len(at)][: len(units)], strict=True):
            pes = elementary[starts[i] : starts[end]].tobytes()
            if len(pes) < 9 or pes[:3] != b"\0\0\1" or len(pes) < 9 + pes[8]:
                found.errors += 1
                continue
            size = pes[4] << 8 | pes[5]
            found.errors += size != len(pes) - 6
            pts = None
            if pes[7] & 0x80 and pes[8] >= 5:
                a, b, c, d, e = pes[9:14]
                pts = (a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1
                found.timestamps.append(pts)
            if own[i, 3] & 0x20 and own[i, 4] and own[i, 5] & 0x40:
                found.access.append((pts if pts is not None else -1, int(at[i])))
            parts.append(pes[9 + pes[8] : 6 + size])
    found.payload = b"".join(parts)
    return found


def store(df: DataFrame, payload: Column, name: str = "media") -> DataFrame:
    """`df` with the payload's stored form in column `name`."""
    small_batches(df.sparkSession)
    short_reads(df.sparkSession)

    @F.arrow_udf("binary")
    def stored(payloads: pa.Array) -> pa.Array:
        return pa.array([None if p is None else mux(p) for p in payloads.to_pylist()], pa.binary())

    return df.withColumn(name, stored(payload))


KIND = pa.struct(
    [("payload", pa.binary()), ("packets", pa.int64()), ("tables", pa.int64()), ("errors", pa.int64()), ("timestamps", pa.list_(pa.int64())), ("access", pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())])))]
)
SCHEMA = "struct<payload:binary,packets:bigint,tables:bigint,errors:bigint,timestamps:array<bigint>,access:array<struct<pts:bigint,packet:bigint>>>"


def read(df: DataFrame, media: Column, name: str = "stream") -> DataFrame:
    """`df` with a struct column `name`: the payload read back, counts, timestamps and random-access points."""
    small_batches(df.sparkSession)
    short_reads(df.sparkSession)

    def row(found: Stream) -> dict:
        return vars(found) | {"access": [{"pts": a, "packet": b} for a, b in found.access]}

    @F.arrow_udf(SCHEMA)
    def parsed(medias: pa.Array) -> pa.Array:
        return pa.array([None if m is None else row(demux(m)) for m in medias.to_pylist()], KIND)

    return df.withColumn(name, parsed(media))


def feature_of(stream: Column) -> Column:
    """One line of text: packets, tables, units, errors, first and last timestamp, random-access points."""
    points = F.array_join(F.transform(stream["access"], lambda a: F.concat(a["pts"].cast("string"), F.lit("@"), a["packet"].cast("string"))), ",")
    edge = lambda f: F.coalesce(f(stream["timestamps"]).cast("string"), F.lit("-"))
    return F.format_string("packets=%d tables=%d units=%d errors=%d pts=%s..%s access=%s", stream["packets"], stream["tables"], F.size(stream["timestamps"]), stream["errors"], edge(F.array_min), edge(F.array_max), points)
