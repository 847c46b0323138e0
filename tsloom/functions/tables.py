"""PSI and DVB tables: section assembly and the parsers of section bodies, as plain values for Arrow."""

from __future__ import annotations

import struct

from tsloom.functions.text import duration, dvb_text, start_time
from tsloom.functions.wire import crc_ok, descriptors, first, u16

PAT, PMT, NIT, SDT, EIT = 0x00, 0x02, 0x40, 0x42, 0x4E
REGISTRATION, LANGUAGE, NETWORK_NAME, SERVICE_LIST, SERVICE, SHORT_EVENT = 0x05, 0x0A, 0x40, 0x41, 0x48, 0x4D
STUFFING = b"\xff"


class Sections:
    """Sections of one PID, cut out of its payloads by their own lengths."""

    def __init__(self) -> None:
        self.open = b""  #: the section that the next payload goes on with
        self.crc_errors = self.completed = 0

    def feed(self, payload: bytes, pusi: bool, unusable: bool) -> list[dict]:
        """Sections that the packet completes.  unusable: corrupt, scrambled or without payload."""
        if unusable or not payload or not (pusi or self.open):
            self.open = b""
            return []
        whole: list[bytes] = []
        if pusi:
            tail, payload = payload[1 : 1 + payload[0]], payload[1 + payload[0] :]
            if tail and self.open:
                # The tail ends the open section, and nothing else; where it is too short, what follows goes on with it.
                joined = self.open + tail
                size = _size(joined, 0)
                done = size is not None and size <= len(joined)
                whole, self.open = ([joined[:size]], b"") if done else ([], joined)
            elif _size(self.open, 0):
                self.open = b""  # cut off by a new section; one without a length yet goes on
        whole += self._cut(payload)
        return [t for t in map(self._table, whole) if t]

    def _cut(self, payload: bytes) -> list[bytes]:
        """Whole sections at the offsets that their lengths lead to; the rest stays open, stuffing goes."""
        if len(self.open) < 3 and payload[:1] == STUFFING:
            return []
        run, at, whole = self.open + payload, 0, []
        while at < len(run) and (not at or run[at : at + 1] != STUFFING):
            size = _size(run, at)
            if size is None or at + size > len(run):
                self.open = run[at:]
                return whole
            whole.append(run[at : at + size])
            at += size
        self.open = b""
        return whole

    def _table(self, raw: bytes) -> dict | None:
        """Header fields and body; a short section is kept whole and has no checksum of its own."""
        fields = dict.fromkeys(("ext", "version", "section_no", "last_section_no"), 0) | {"is_current": True, "is_long": bool(raw[1] & 0x80), "body": raw}
        if fields["is_long"]:
            sound = crc_ok(raw)
            self.crc_errors += not sound
            if not sound or len(raw) < 12:
                return None
            ext, flags, number, last = struct.unpack_from(">HBBB", raw, 3)
            fields |= {"ext": ext, "version": flags >> 1 & 31, "is_current": flags % 2 == 1, "section_no": number, "last_section_no": last, "body": raw[8:-4]}
        self.completed += 1
        return {"table_id": raw[0]} | fields


def _size(run: bytes, at: int) -> int | None:
    """Length of the section that begins there, once its header tells."""
    return 3 + (u16(run, at + 1) & 0xFFF) if at + 3 <= len(run) else None


def _entries(body: bytes, at: int, end: int, fixed: int) -> list[tuple[int, list[dict]]] | None:
    """Entries of `fixed` bytes, the last two of which hold the length of the descriptors behind; None where one overruns."""
    found = []
    while at + fixed <= end:
        size = u16(body, at + fixed - 2) & 0xFFF
        if at + fixed + size > end:
            return None
        found.append((at, descriptors(body, at + fixed, size)))
        at += fixed + size
    return found


def pat(s: dict) -> dict | None:
    body = s["body"]
    if len(body) % 4:
        return None
    pairs = [(u16(body, i), u16(body, i + 2) & 0x1FFF) for i in range(0, len(body), 4)]
    network = [pid for program, pid in pairs if not program]
    programs = {program: pid for program, pid in pairs if program}
    return {"ts_id": s["ext"], "network_pid": network[-1] if network else None, "programs": [{"program": k, "pid": v} for k, v in programs.items()]}


def languages(found: list[dict]) -> list[str]:
    raw = first(found, LANGUAGE) or b""
    return [raw[i : i + 3].decode("ascii", "replace") for i in range(0, len(raw) - 3, 4)]


def pmt(s: dict) -> dict | None:
    body = s["body"]
    if len(body) < 4 or 4 + (u16(body, 2) & 0xFFF) > len(body):
        return None
    info = u16(body, 2) & 0xFFF
    entries = _entries(body, 4 + info, len(body), 5)
    if entries is None:
        return None
    own = descriptors(body, 4, info)
    registration = first(own, REGISTRATION)
    streams = [{"pid": u16(body, at + 1) & 0x1FFF, "raw_type": body[at], "languages": languages(d), "descriptors": d} for at, d in entries]
    return {"program": s["ext"], "pcr_pid": u16(body, 0) & 0x1FFF, "registration": registration[:4].decode("ascii", "replace") if registration and len(registration) >= 4 else None, "descriptors": own, "streams": streams}


def service_descriptor(raw: bytes | None) -> dict:
    """type, provider and name; all null where the descriptor is missing or short."""
    empty = {"type": None, "provider": None, "name": None}
    if raw is None or len(raw) < 2 or 2 + raw[1] >= len(raw):
        return empty
    at = 2 + raw[1]
    if at + 1 + raw[at] > len(raw):
        return empty
    return {"type": raw[0], "provider": dvb_text(raw[2:at]), "name": dvb_text(raw[at + 1 : at + 1 + raw[at]])}


def short_event(raw: bytes | None) -> dict:
    """language, name and text; all null where the descriptor is missing or short."""
    empty = {"language": None, "name": None, "text": None}
    if raw is None or len(raw) < 4 or 4 + raw[3] >= len(raw):
        return empty
    at = 4 + raw[3]
    if at + 1 + raw[at] > len(raw):
        return empty
    return {"language": raw[:3].decode("ascii", "replace"), "name": dvb_text(raw[4:at]), "text": dvb_text(raw[at + 1 : at + 1 + raw[at]])}


def sdt(s: dict) -> dict | None:
    body = s["body"]
    entries = _entries(body, 3, len(body), 5) if len(body) >= 3 else None
    if entries is None:
        return None
    services = []
    for at, d in entries:
        named = service_descriptor(first(d, SERVICE))
        services.append({"service_id": u16(body, at), "running_status": body[at + 3] >> 5, "scrambled": bool(body[at + 3] & 0x10), "eit_schedule": bool(body[at + 2] & 2), "eit_present_following": bool(body[at + 2] & 1), **named, "descriptors": d})
    return {"ts_id": s["ext"], "original_network_id": u16(body, 0), "services": services}


def nit(s: dict) -> dict | None:
    body = s["body"]
    if len(body) < 2:
        return None
    info = u16(body, 0) & 0xFFF
    at = 2 + info
    if at + 2 > len(body):
        return None
    end = at + 2 + (u16(body, at) & 0xFFF)
    entries = _entries(body, at + 2, end, 6) if end <= len(body) else None
    if entries is None:
        return None
    own = descriptors(body, 2, info)
    streams = []
    for k, d in entries:
        raw = first(d, SERVICE_LIST) or b""
        listed = {u16(raw, i): raw[i + 2] for i in range(0, len(raw) - 2, 3)}
        streams.append({"ts_id": u16(body, k), "original_network_id": u16(body, k + 2), "services": [{"service_id": a, "type": b} for a, b in listed.items()]})
    return {"network_id": s["ext"], "name": dvb_text(first(own, NETWORK_NAME)), "streams": streams}


def eit(s: dict) -> dict | None:
    body = s["body"]
    entries = _entries(body, 6, len(body), 12) if len(body) >= 6 else None
    if entries is None:
        return None
    events = []
    for at, d in entries:
        events.append({"event_id": u16(body, at), "start": start_time(body[at + 2 : at + 7]), "duration_s": duration(body[at + 7 : at + 10]), "running_status": body[at + 10] >> 5, "scrambled": bool(body[at + 10] & 0x10), **short_event(first(d, SHORT_EVENT))})
    return {"service_id": s["ext"], "ts_id": u16(body, 0), "original_network_id": u16(body, 2), "section_no": s["section_no"], "events": events}
