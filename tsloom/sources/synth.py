"""A transport-stream writer for tests and benchmarks: packets, sections, PES, tables, cues."""

from __future__ import annotations

import struct

from tsloom.functions.wire import PACKET, WRAP33, crc32_mpeg


def packet(pid: int, cc: int, payload: bytes | None = b"", *, pusi=False, tei=False, scrambling=0, discontinuity=False, random_access=False, pcr: int | None = None, fill=True) -> bytes:
    """One packet; payload None means no payload flag.  Short payloads are stuffed in front, in the adaptation field."""
    flags = discontinuity << 7 | random_access << 6 | (pcr is not None) << 4
    body = b""
    if pcr is not None:
        base, ext = divmod(pcr % (WRAP33 * 300), 300)
        body = (base << 15 | 0x7E00 | ext).to_bytes(6, "big")
    room = 184 - (len(payload) if payload is not None else 0)
    field = b""
    if flags or room:
        if room == 1 and not flags:
            field = b"\0"
        else:
            field = bytes([flags]) + body
            field += b"\xff" * (room - 1 - len(field))
            field = bytes([len(field)]) + field
    afc = (2 if field else 0) | (payload is not None)
    head = struct.pack(">BHB", 0x47, tei << 15 | pusi << 14 | pid, scrambling << 6 | afc << 4 | cc & 15)
    out = head + field + (payload or b"")
    if len(out) != PACKET:
        raise ValueError(f"the packet has {len(out)} bytes")
    return out


def section(table_id: int, ext: int, body: bytes, version=0, current=True, number=0, last=0, spoil=False) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ext, 0xC0 | version << 1 | current, number, last) + body
    return head + struct.pack(">I", crc32_mpeg(head) ^ spoil)


def section_payloads(raw: bytes, pointer: int = 0) -> list[bytes]:
    """Payloads of the packets that carry a section; the first has the pointer."""
    data = bytes([pointer]) + b"\xff" * pointer + raw
    return [data[i : i + 184].ljust(184, b"\xff") for i in range(0, len(data), 184)]


def descriptor(tag: int, payload: bytes) -> bytes:
    return bytes([tag, len(payload)]) + payload


def pat(ts_id: int, programs: dict[int, int], **kw) -> bytes:
    return section(0, ts_id, b"".join(struct.pack(">HH", n, 0xE000 | pid) for n, pid in programs.items()), **kw)


def pmt(program: int, pcr_pid: int, streams: list[tuple], info: bytes = b"", **kw) -> bytes:
    body = struct.pack(">HH", 0xE000 | pcr_pid, 0xF000 | len(info)) + info
    for kind, pid, *d in streams:
        extra = b"".join(d)
        body += struct.pack(">BHH", kind, 0xE000 | pid, 0xF000 | len(extra)) + extra
    return section(2, program, body, **kw)


def sdt(ts_id: int, services: list[tuple[int, str]], **kw) -> bytes:
    body = struct.pack(">HB", 1, 0xFF)
    for sid, name in services:
        raw = b"\x15" + name.encode()
        d = descriptor(0x48, bytes([1, 0, len(raw)]) + raw)
        body += struct.pack(">HBH", sid, 0xFD, 4 << 13 | len(d)) + d
    return section(0x42, ts_id, body, **kw)


def stamp(prefix: int, ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([prefix << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def pes(stream_id: int, data: bytes, pts: int | None = None, dts: int | None = None) -> bytes:
    times = b"" if pts is None else stamp(2, pts) if dts is None else stamp(3, pts) + stamp(1, dts)
    size = len(data) + 3 + len(times)
    return struct.pack(">IHBBB", 0x100 | stream_id, size if size < 65536 else 0, 0x80, (pts is not None) << 7 | (dts is not None) << 6, len(times)) + times + data


def pes_packets(pid: int, cc: int, data: bytes, **first) -> list[bytes]:
    """Packets of a PES packet; options go to the first."""
    room = 184 - (8 if first.get("pcr") is not None else 2 if first.get("random_access") or first.get("discontinuity") else 0)
    out = [packet(pid, cc, data[:room], pusi=True, **first)]
    for k, i in enumerate(range(room, len(data), 184), start=1):
        out.append(packet(pid, cc + k, data[i : i + 184]))
    return out


def splice_info(command: int, body: bytes, descriptors: bytes = b"", adjust: int = 0, encrypted=False, length: int | None = None) -> bytes:
    head = bytes([0]) + (encrypted << 39 | adjust).to_bytes(5, "big") + b"\0" + (0xFFF << 12 | (len(body) if length is None else length)).to_bytes(3, "big") + bytes([command])
    rest = head + body + struct.pack(">H", len(descriptors)) + descriptors
    raw = struct.pack(">BH", 0xFC, 0x3000 | len(rest) + 4) + rest
    return raw + struct.pack(">I", crc32_mpeg(raw))


class BitWriter:
    """Bits and Exp-Golomb codes, for parameter sets."""

    def __init__(self) -> None:
        self.text = ""

    def put(self, value: int, bits: int = 1) -> BitWriter:
        self.text += f"{value:0{bits}b}" if bits else ""
        return self

    def ue(self, value: int) -> BitWriter:
        code = f"{value + 1:b}"
        self.text += "0" * (len(code) - 1) + code
        return self

    def bytes(self) -> bytes:
        """With a stop bit, and emulation prevention bytes where three would read as a start code."""
        text = self.text + "1"
        raw = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
        out = bytearray()
        for b in raw:
            if out[-2:] == b"\0\0" and b < 4:
                out.append(3)
            out.append(b)
        return bytes(out)


def avc_sps(profile: int, level: int, wide: int, high: int, crop: tuple[int, int, int, int] = (0, 0, 0, 0), fields: bool = False) -> bytes:
    """An H.264 sequence parameter set of so many macroblocks, cropped left, right, top and bottom."""
    w = BitWriter().ue(0)
    if profile == 100:
        w.ue(1).ue(0).ue(0).put(0).put(0)
    w.ue(0).ue(2).ue(1).put(0).ue(wide - 1).ue(high - 1).put(0 if fields else 1)
    if fields:
        w.put(0)
    w.put(1).put(1 if any(crop) else 0)
    if any(crop):
        for c in crop:
            w.ue(c)
    return bytes([0x67, profile, 0, level]) + w.put(0).bytes()


def adts_frame(rate_index: int, channels: int, payload: bytes) -> bytes:
    return (0xFFF1 << 40 | 1 << 38 | rate_index << 34 | channels << 30 | (7 + len(payload)) << 13 | 0x7FF << 2).to_bytes(7, "big") + payload
