"""Media columns: MPEG transport streams.

`mux` stores a binary payload as a transport stream: program tables, then access units, each one PES
packet with a time stamp that begins with a random-access point. `demux` reads a stream back: it parses
the program tables and checks their CRC, follows the continuity counters, reassembles the elementary
packets and lists the units with time stamps and random-access points.

Edge cases: a null text is an empty payload, padded to one block; payloads have no size limit of their own, since
they are split into access units; equal texts and repeated rows have equal streams. `demux` never fails on a row: a
null stream has a null payload; of a stream that cannot be read (not whole packets, no sync byte, no program
table or map, a table whose CRC fails, an elementary packet without a start code) the row keeps the stream and
tells why in `error`; lost packets are counted in continuity_errors, a packet sent twice or after an announced
discontinuity is no error, and a unit cut short by a loss keeps what has come. Extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import byte_chunks

#: Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID = 188, 0x47, 0x0000
BODY = PACKET - 4
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06

#: Choices of this multiplexer.
PROGRAM, PMT_PID, MEDIA_PID = 1, 0x1000, 0x0100
UNIT_BYTES, UNIT_TICKS = 16384, 3600
BLOCK = 64

_UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))
STREAM = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media binary, payload binary, program int, pid int, stream_type int, packets long, continuity_errors long, units array<struct<pts:long,offset:long,size:long,random_access:boolean>>, error string"


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, bits not reflected, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


_PAT = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0")


def table_packet(pid: int, counter: int, data: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0]) + data).ljust(PACKET, b"\xff")


def stamp(pts: int) -> bytes:
    """A 33-bit time stamp in five bytes with its marker bits."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def unit_packets(unit: bytes, pts: int, counter: int) -> np.ndarray:
    """The packets of one access unit: the first carries the clock and the random-access flag, the last is stuffed."""
    pes = np.frombuffer(b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + unit, np.uint8)
    clock = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
    room = BODY - 1 - len(clock)
    n = 1 + max(0, -(-(len(pes) - room) // BODY))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    take = min(room, len(pes))
    out[0, 4] = BODY - 1 - take
    out[0, 5 : 5 + len(clock)] = np.frombuffer(clock, np.uint8)
    out[0, PACKET - take :] = pes[:take]
    rest = pes[take:]
    if n > 2:
        out[1 : n - 1, 4:] = rest[: (n - 2) * BODY].reshape(n - 2, BODY)
    if n > 1:
        tail = rest[(n - 2) * BODY :]
        gap = BODY - len(tail)
        if gap:
            out[-1, 3] |= 0x20
            out[-1, 4] = gap - 1
            out[-1, 5:6] = 0 if gap > 1 else out[-1, 5:6]
        out[-1, PACKET - len(tail) :] = tail
    return out


def mux_bytes(payload: bytes) -> bytes:
    parts, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        parts += [table_packet(PAT_PID, k, _PAT), table_packet(PMT_PID, k, _PMT)]
        packets = unit_packets(payload[at : at + UNIT_BYTES], (k + 1) * UNIT_TICKS & (1 << 33) - 1, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


_checked: dict[bytes, bytes] = {}


def checked_section(packet: bytes) -> bytes:
    """The body of the table section in a packet's payload after its CRC held."""
    if packet not in _checked:
        at = 1 + packet[0]
        size = int.from_bytes(packet[at + 1 : at + 3], "big") & 0x0FFF
        whole = packet[at : at + 3 + size]
        if size < 9 or len(whole) < 3 + size or crc32_mpeg(whole):
            raise ValueError("a program table fails its CRC")
        if len(_checked) > 256:
            _checked.clear()
        _checked[packet] = whole[8:-4]
    return _checked[packet]


def payload_of(packet: np.ndarray) -> bytes:
    """What a packet carries after its adaptation field."""
    return packet[4 + (int(packet[4]) + 1 if packet[3] & 0x20 else 0) :].tobytes() if packet[3] & 0x10 else b""


def first_section(packets: np.ndarray, name: str) -> bytes:
    """The body of the first table that begins in these packets."""
    begins = np.flatnonzero(packets[:, 1] & 0x40)
    if not len(begins):
        raise ValueError(f"the stream has no {name}")
    body = checked_section(payload_of(packets[begins[0]]))
    if len(body) < 4:
        raise ValueError(f"the {name} is empty")
    return body


def once(packets: np.ndarray) -> tuple[np.ndarray, int]:
    """One stream's packets with a payload, without those sent twice, and the number of breaks in their counters."""
    p = packets[packets[:, 3] & 0x10 > 0]
    if len(p) < 2:
        return p, 0
    counter = p[:, 3].astype(np.int32) & 15
    step = np.diff(counter) & 15
    twice = (step == 0) & (p[1:, 4:] == p[:-1, 4:]).all(1)
    announced = (p[1:, 3] & 0x20 > 0) & (p[1:, 4] > 0) & (p[1:, 5] & 0x80 > 0)
    return p[np.concatenate(([True], ~twice))], int(((step != 1) & ~twice & ~announced).sum())


def demux_bytes(media: bytes) -> dict:
    """payload, program, pid, stream_type, packets, continuity_errors and units of a stream with one program; ValueError where it cannot be read."""
    if len(media) % PACKET:
        raise ValueError("the stream is not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("a packet lacks its sync byte")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    out = {"payload": b"", "program": None, "pid": None, "stream_type": None, "packets": len(p), "continuity_errors": 0, "units": []}
    if not len(p):
        return out
    tables = p[pid == PAT_PID]
    pat = first_section(tables, "program table")
    out["program"], pmt_pid = int.from_bytes(pat[:2], "big"), int.from_bytes(pat[2:4], "big") & 0x1FFF
    maps = p[pid == pmt_pid]
    pmt = first_section(maps, "program map")
    skip = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
    if len(pmt) < skip + 5:
        raise ValueError("the program map names no stream")
    out["stream_type"], out["pid"] = pmt[skip], int.from_bytes(pmt[skip + 1 : skip + 3], "big") & 0x1FFF

    es, out["continuity_errors"] = once(p[pid == out["pid"]])
    out["continuity_errors"] += once(tables)[1] + once(maps)[1]
    adapted = es[:, 3] & 0x20 > 0
    offset = np.minimum(4 + np.where(adapted, es[:, 4].astype(np.int64) + 1, 0), PACKET)
    data = es[np.arange(PACKET) >= offset[:, None]].tobytes()
    end = np.cumsum(PACKET - offset)
    begins = np.flatnonzero(es[:, 1] & 0x40)
    parts, at = [], 0
    for k, i in enumerate(begins.tolist()):
        a = int(end[i] - (PACKET - offset[i]))
        b = int(end[begins[k + 1] - 1]) if k + 1 < len(begins) else len(data)
        pes = data[a:b]
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            raise ValueError("an elementary packet lacks its start code")
        size = int.from_bytes(pes[4:6], "big")
        unit = pes[9 + pes[8] : 6 + size if size else None]
        stamped = pes[7] & 0x80 and len(pes) >= 14
        parts.append(unit)
        out["units"].append({"pts": unstamp(pes[9:14]) if stamped else None, "offset": at, "size": len(unit), "random_access": bool(adapted[i] and es[i, 4] and es[i, 5] & 0x40)})
        at += len(unit)
    out["payload"] = b"".join(parts)
    return out


_NOTHING = {"payload": None, "program": None, "pid": None, "stream_type": None, "packets": None, "continuity_errors": None, "units": None}


def read_stream(media: bytes | None) -> dict:
    """What `demux_bytes` reads, with `error`: why a stream cannot be read, or null."""
    if media is None:
        return {**_NOTHING, "error": None}
    try:
        return {**demux_bytes(media), "error": None}
    except ValueError as wrong:
        return {**_NOTHING, "error": str(wrong)}


#: Octets of text or stream that are held as Python objects at once, one row at least.
AT_ONCE = 4 << 20


def mux(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8, zeros appended up to a positive multiple of block, as a stream."""

    def work(batches):
        for part, texts in byte_chunks(batches, "text", AT_ONCE):
            media = [mux_bytes(x.ljust(max(block, -(-len(x) // block) * block), b"\0")) for x in texts]
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, STREAM)


def demux(streams: DataFrame) -> DataFrame:
    """The streams (doc_id, n_bytes, media) with payload, program, pid, stream_type, packets, continuity_errors, units and error."""

    def work(batches):
        for part, _ in byte_chunks(batches, "media", AT_ONCE):
            read = [read_stream(x) for x in part.column("media").to_pylist()]
            get = lambda k, kind: pa.array([x[k] for x in read], kind)  # noqa: B023, E731
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "media": part.column("media"),
                "payload": get("payload", pa.binary()), "program": get("program", pa.int32()), "pid": get("pid", pa.int32()), "stream_type": get("stream_type", pa.int32()),
                "packets": get("packets", pa.int64()), "continuity_errors": get("continuity_errors", pa.int64()), "units": get("units", _UNITS), "error": get("error", pa.string()),
            })

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(work, READ)
