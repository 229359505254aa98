"""Media columns: texts stored as MPEG transport streams (ISO/IEC 13818-1) and read back.

A stream has one program: a program association table, a program map table, and one elementary stream of
private data whose access units are multiples of 192 bytes. Every eighth access unit is a random-access point
that carries a clock reference.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import map_rows, text_bytes

UNIT = 192
ACCESS_UNIT = 16 * UNIT
PACKET = 188
PMT_PID = 0x1000
DATA_PID = 0x100
TICKS = 3600
RANDOM_ACCESS_EVERY = 8


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(pid: int, body: bytes) -> bytes:
    body += crc32_mpeg(body).to_bytes(4, "big")
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + body).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
    data = [0xE0 | DATA_PID >> 8, DATA_PID & 255]
    pmt = bytes([2, 0xB0, 18, 0, 1, 0xC1, 0, 0, *data, 0xF0, 0, 6, *data, 0xF0, 0])
    return _section(0, pat) + _section(PMT_PID, pmt)


_HEAD = _tables()


def _timestamp(t: int) -> bytes:
    """A 33-bit presentation timestamp in its five-byte form."""
    return bytes([0x21 | (t >> 29 & 0x0E), t >> 22 & 255, (t >> 14 & 0xFE) | 1, t >> 7 & 255, (t << 1 & 0xFE) | 1])


def pad(data: bytes) -> bytes:
    """``data`` with bytes 32 up to a positive multiple of 192."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def encode(payload: bytes) -> bytes:
    """A transport stream of ``payload``."""
    out, count = [_HEAD], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit = payload[at : at + ACCESS_UNIT]
        stamp = (90_000 + k * TICKS) & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(stamp) + unit
        at_start, i = True, 0
        while i < len(pes):
            field = b""
            if at_start and k % RANDOM_ACCESS_EVERY == 0:
                field = b"\x50" + (stamp << 15 | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = pes[i : i + room]
            if (short := room - len(part)) and not field:
                field, short = (b"", 0) if short == 1 else (b"\x00", short - 2)
                adapted = True
            else:
                adapted = bool(field)
            head = bytes([0x47, (0x40 if at_start else 0) | DATA_PID >> 8, DATA_PID & 255, (0x30 if adapted else 0x10) | count])
            if adapted:
                head += bytes([len(field) + short]) + field + b"\xff" * short
            out.append(head + part)
            count, at_start, i = (count + 1) & 15, False, i + len(part)
    return b"".join(out)


def _sections(packets: np.ndarray) -> list[bytes]:
    """The checked sections of packets that each hold one."""
    found = []
    for p in packets:
        raw = p.tobytes()
        body = raw[5 + raw[4] :]
        body = body[: 3 + ((body[1] & 15) << 8 | body[2])]
        if crc32_mpeg(body):
            raise ValueError("damaged section")
        found.append(body)
    return found


def decode(stream: bytes) -> dict:
    """Read a transport stream: program tables, then for each elementary stream its access units with
    timestamps and random-access marks, and the number of breaks in its continuity counters."""
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if len(packets) and (packets[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs, streams = {}, {}
    for body in _sections(packets[pids == 0]):
        for i in range(8, len(body) - 4, 4):
            if number := body[i] << 8 | body[i + 1]:
                programs[number] = (body[i + 2] & 0x1F) << 8 | body[i + 3]
    for number, pmt_pid in programs.items():
        for body in _sections(packets[pids == pmt_pid]):
            i = 12 + ((body[10] & 15) << 8 | body[11])
            while i < len(body) - 4:
                streams[(body[i + 1] & 0x1F) << 8 | body[i + 2]] = {"program": number, "type": body[i]}
                i += 5 + ((body[i + 3] & 15) << 8 | body[i + 4])
    for pid, entry in streams.items():
        own = packets[pids == pid]
        carries = own[:, 3] & 0x10 > 0
        counters = own[carries, 3].astype(np.int16) & 15
        entry["breaks"] = int(np.count_nonzero(np.diff(counters) % 16 != 1))
        adapted = own[:, 3] & 0x20 > 0
        skip = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
        marks = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        starts = own[:, 1] & 0x40 > 0
        raw, units = own.tobytes(), []
        bounds = [*np.flatnonzero(starts), len(own)]
        skips, carry = skip.tolist(), carries.tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            pes = b"".join([raw[j * PACKET + skips[j] : (j + 1) * PACKET] for j in range(a, b) if carry[j]])
            if pes[:3] != b"\x00\x00\x01" or len(pes) != 6 + (pes[4] << 8 | pes[5]):
                raise ValueError("damaged elementary packet")
            t = pes[9:14]
            stamp = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
            units.append((stamp, bool(marks[a]), pes[9 + pes[8] :]))
        entry["units"] = units
    return {"programs": programs, "streams": streams, "packets": len(packets)}


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, stream): each whole text as a transport stream. A null text is an empty one; an empty one is
    192 spaces. Nothing is dropped; equal texts give equal streams."""

    def make():
        def each(keys, texts):
            for k, t in zip(keys, texts, strict=True):
                data = text_bytes(t)
                yield k, len(data), encode(pad(data))

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text)), make, f"{key} {kind}, n_bytes long, stream binary")


def access_units(streams: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per access unit of a ``stream`` column: pid, unit, pts, random_access, breaks, data. A null stream has
    none; a damaged one fails the job."""

    def make():
        def each(keys, raws):
            for k, raw in zip(keys, raws, strict=True):
                for pid, entry in decode(raw or b"")["streams"].items():
                    for i, (stamp, mark, data) in enumerate(entry["units"]):
                        yield k, pid, i, stamp, mark, entry["breaks"], data

        return each

    kind = streams.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, pid int, unit int, pts long, random_access boolean, breaks int, data binary"
    return map_rows(streams.select(key, "stream"), make, schema)


def digests(streams: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per stored stream: what reading it back gives."""

    def make():
        def each(keys, sizes, raws):
            for k, n, raw in zip(keys, sizes, raws, strict=True):
                found = decode(raw)
                entry = found["streams"][DATA_PID]
                units = entry["units"]
                payload = b"".join([u[2] for u in units])
                marks = [i for i, u in enumerate(units) if u[1]]
                feature = (
                    f"programs={len(found['programs'])};packets={found['packets']};units={len(units)};"
                    f"random_access={','.join(map(str, marks))};pts={units[0][0]}-{units[-1][0]};breaks={entry['breaks']}"
                )
                yield (
                    k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw),
                    hashlib.sha256(raw).hexdigest(), feature,
                )

        return each

    kind = streams.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(streams.select(key, "n_bytes", "stream"), make, schema)
