"""Bit-level decoding: transport packets and PES headers in numpy, CRC-32/MPEG-2, descriptors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PAT_PID, NIT_PID, SDT_PID, EIT_PID = 0x0000, 0x0010, 0x0011, 0x0012
PCR_HZ, PTS_HZ, WRAP33 = 27_000_000, 90_000, 1 << 33
#: Stream ids whose PES packets have no optional header.
PLAIN_STREAM_IDS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)

PACKET_FIELDS = [
    ("packet_no", pa.int64()), ("tei", pa.bool_()), ("pusi", pa.bool_()), ("transport_priority", pa.bool_()), ("pid", pa.int32()), ("scrambling_control", pa.int32()), ("afc", pa.int32()), ("cc", pa.int32()),
    ("has_af", pa.bool_()), ("discontinuity", pa.bool_()), ("random_access", pa.bool_()), ("es_priority", pa.bool_()), ("pcr", pa.int64()), ("payload_len", pa.int32()), ("payload", pa.binary()),
]
PACKETS_SQL = "stream_id string, packet_no long, tei boolean, pusi boolean, transport_priority boolean, pid int, scrambling_control int, afc int, cc int, has_af boolean, discontinuity boolean, random_access boolean, es_priority boolean, pcr long, payload_len int, payload binary"


def decode_packets(raw: np.ndarray, numbers: np.ndarray, stream_ids: pa.Array, with_payload: bool = True) -> pa.RecordBatch:
    """Rows of well-formed packets; others (no sync byte, adaptation field past the end) are left out."""
    p = raw.reshape(-1, PACKET)
    afc = (p[:, 3] >> 4) & 3
    has_af = (afc & 2) > 0
    length = np.where(has_af, p[:, 4].astype(np.int32), 0)
    begin = 4 + np.where(has_af, 1 + length, 0)
    ok = (p[:, 0] == SYNC) & (begin <= PACKET)
    if not ok.all():
        keep = np.flatnonzero(ok)
        p, afc, has_af, length, begin, numbers, stream_ids = p[keep], afc[keep], has_af[keep], length[keep], begin[keep], numbers[keep], stream_ids.take(pa.array(keep))
    flags = np.where(has_af & (length > 0), p[:, 5], 0)
    c = p[:, 6:12].astype(np.int64)
    base = c[:, 0] << 25 | c[:, 1] << 17 | c[:, 2] << 9 | c[:, 3] << 1 | c[:, 4] >> 7
    pcr = base * 300 + ((c[:, 4] & 1) << 8 | c[:, 5])
    no_pcr = ((flags & 0x10) == 0) | (length < 7)
    payload_len = np.where(afc & 1, PACKET - begin, 0)
    bits = lambda mask: pa.array((flags & mask) > 0, mask=~has_af)
    columns = [
        pa.array(numbers), pa.array((p[:, 1] & 0x80) > 0), pa.array((p[:, 1] & 0x40) > 0), pa.array((p[:, 1] & 0x20) > 0), pa.array(((p[:, 1].astype(np.int32) & 0x1F) << 8) | p[:, 2]), pa.array((p[:, 3] >> 6).astype(np.int32)),
        pa.array(afc.astype(np.int32)), pa.array((p[:, 3] & 15).astype(np.int32)), pa.array(has_af), bits(0x80), bits(0x40), bits(0x20), pa.array(pcr, mask=no_pcr), pa.array(payload_len.astype(np.int32)),
    ]
    if with_payload:
        inside = (np.arange(PACKET)[None, :] >= begin[:, None]) & (payload_len > 0)[:, None]
        ends = np.concatenate([[0], np.cumsum(payload_len)]).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(p[inside].tobytes())]))
    else:
        columns.append(pa.nulls(len(p), pa.binary()))
    return pa.RecordBatch.from_arrays([stream_ids, *columns], names=["stream_id", *(n for n, _ in PACKET_FIELDS)])


def _table() -> list[int]:
    rows = []
    for value in range(256):
        value <<= 24
        for _ in range(8):
            value = value << 1 ^ (0x104C11DB7 if value >> 31 else 0)
        rows.append(value)
    return rows


_CRC = _table()


def crc32_mpeg(data: bytes) -> int:
    """Not reflected, all ones at first, nothing at last."""
    value = 0xFFFFFFFF
    for b in data:
        value = (value << 8 & 0xFFFFFFFF) ^ _CRC[value >> 24 ^ b]
    return value


def crc_ok(data: bytes) -> bool:
    return len(data) >= 4 and crc32_mpeg(data) == 0


def u16(b: bytes, at: int) -> int:
    return b[at] << 8 | b[at + 1]


def stamp(b: bytes, at: int) -> int:
    """A 33-bit timestamp of five bytes with marker bits."""
    return (b[at] & 0x0E) << 29 | b[at + 1] << 22 | (b[at + 2] & 0xFE) << 14 | b[at + 3] << 7 | b[at + 4] >> 1


def pes_header(b: bytes) -> dict | None:
    """stream_id, packet_length, pts, dts, data_alignment, header_length; None if it isn't a PES packet's start."""
    if len(b) < 6 or b[:3] != b"\0\0\1":
        return None
    head = {"stream_id": b[3], "packet_length": u16(b, 4), "pts": None, "dts": None, "data_alignment": False, "header_length": 6}
    if b[3] in PLAIN_STREAM_IDS:
        return head
    if len(b) < 9:
        return None
    head |= {"data_alignment": bool(b[6] & 4), "header_length": 9 + b[8]}
    which = b[7] >> 6
    if which == 2 and len(b) >= 14:
        head["pts"] = stamp(b, 9)
    elif which == 3 and len(b) >= 19:
        head |= {"pts": stamp(b, 9), "dts": stamp(b, 14)}
    return head


def descriptors(b: bytes, at: int, length: int) -> list[dict]:
    """Tag-length-value entries; one that overruns the loop ends it."""
    found, end = [], at + length
    if length <= 0 or end > len(b):
        return found
    while at + 2 <= end and at + 2 + b[at + 1] <= end:
        found.append({"tag": b[at], "payload": b[at + 2 : at + 2 + b[at + 1]]})
        at += 2 + b[at + 1]
    return found


def first(found: list[dict], tag: int) -> bytes | None:
    """Payload of the first descriptor with the tag."""
    return next((d["payload"] for d in found if d["tag"] == tag), None)
