"""Media columns: MPEG transport streams written and read in numpy.

store() puts a payload of whole 192-byte blocks into a transport stream of one
program with one private elementary stream: units of UNIT_BYTES become PES
packets with a presentation time, every RANDOM_EVERY-th unit is a random-access
point with the program tables before it and a clock reference in its first
packet.  read() takes any transport stream of 188-byte packets: it parses the
program tables (CRC-checked), checks continuity counters, reassembles the PES
packets of the first program's first stream and returns the bytes with the
units' timestamps, places and random-access flags.

Both work on whole texts, one document at a time, vectorised over its packets.

Defined results: null and empty texts are one block of spaces; any length goes;
equal texts give equal bytes; repeated rows are repeated; null ids are kept; an
empty table gives no rows; further columns are not read.  read() counts bytes of
packets without sync as lost, drops units whose packets have a continuity gap
and reports them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.textbytes import runs

BLOCK, UNIT_BYTES, RANDOM_EVERY = 192, 192 * 64, 8
PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
#: 90 kHz ticks that a block lasts.
TICKS = 36
FIRST_PTS = 90_000


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ext, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _psi_packet(pid: int, section: bytes) -> np.ndarray:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return np.frombuffer(head.ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack(
    [
        _psi_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))),
        _psi_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))),
    ]
)


def _stamp(ticks: np.ndarray) -> np.ndarray:
    """PTS fields, five bytes each."""
    t = ticks.astype(np.int64) & ((1 << 33) - 1)
    return np.stack([0x21 | (t >> 29 & 0x0E), t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1], axis=1).astype(np.uint8)


def _unit_packets(units: np.ndarray, first: int, cc: int) -> np.ndarray:
    """Packets (unit, packet, 188) of equally long units, the first of which has number `first`."""
    k, length = units.shape
    number = first + np.arange(k)
    pts = FIRST_PTS + number * (UNIT_BYTES // BLOCK) * TICKS
    pes = np.empty((k, 14 + length), np.uint8)
    pes[:, :9] = np.frombuffer(struct.pack(">IHBBB", 0x100 | STREAM_ID, length + 8, 0x84, 0x80, 5), np.uint8)
    pes[:, 9:14] = _stamp(pts)
    pes[:, 14:] = units
    rest = pes.shape[1] - 176
    full, left = divmod(rest, 184)
    n = 1 + full + bool(left)
    out = np.full((k, n, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[:, 0, 1] |= 0x40
    count = cc + np.arange(k * n).reshape(k, n)
    out[:, :, 3] = 0x10 | (count & 15)
    # First packet: adaptation field with clock and random-access flag, then 176 bytes.
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = 7
    out[:, 0, 5] = 0x10 | (np.where(number % RANDOM_EVERY == 0, 0x40, 0))
    base = (pts - 45_000) & ((1 << 33) - 1)
    clock = np.stack([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base << 7 & 0x80) | 0x7E, base * 0], axis=1)
    out[:, 0, 6:12] = clock.astype(np.uint8)
    out[:, 0, 12:] = pes[:, :176]
    if full:
        out[:, 1 : 1 + full, 4:] = pes[:, 176 : 176 + 184 * full].reshape(k, full, 184)
    if left:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = 183 - left
        if left < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - left :] = pes[:, 176 + 184 * full :]
    return out


def store(payload: bytes) -> bytes:
    """A transport stream that holds the payload, whose length is a positive multiple of BLOCK."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT_BYTES
    parts: list[np.ndarray] = []
    if whole:
        parts.append(_unit_packets(data[: whole * UNIT_BYTES].reshape(whole, UNIT_BYTES), 0, 0))
    if len(data) % UNIT_BYTES:
        cc = parts[0].shape[0] * parts[0].shape[1] if parts else 0
        parts.append(_unit_packets(data[whole * UNIT_BYTES :][None], whole, cc))
    out, at = [], 0
    for units in parts:
        for u in range(len(units)):
            if (at + u) % RANDOM_EVERY == 0:
                tables = _TABLES.copy()
                tables[:, 3] |= (at + u) // RANDOM_EVERY & 15
                out.append(tables)
            out.append(units[u])
        at += len(units)
    return np.concatenate(out).tobytes()


def _sections(packets: np.ndarray) -> Iterator[bytes]:
    """Long sections with a valid CRC from packets of one PID, assembled over packets."""
    held, last = None, -1
    for p in packets:
        if not p[3] & 0x10:
            continue
        raw = p[4 + (1 + int(p[4]) if p[3] & 0x20 else 0) :].tobytes()
        cc, begins = int(p[3] & 15), bool(p[1] & 0x40)
        if p[1] & 0x80 or not raw:
            held = None
            continue
        if cc == last and not begins:
            continue
        if cc != (last + 1) & 15:
            held = None
        last = cc
        parts = [(held, raw[1 : 1 + raw[0]]), (b"", raw[1 + raw[0] :])] if begins else [(held, raw)]
        for before, more in parts:
            held = None if before is None else before + more
            while held is not None and len(held) >= 3:
                size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0xFFF)
                if held[0] == 0xFF or len(held) < size:
                    held = None if held[0] == 0xFF else held
                    break
                section, held = held[:size], held[size:]
                if size >= 12 and crc32_mpeg(section) == 0:
                    yield section


def read(media: bytes) -> dict:
    """What the stream holds; see the module's text."""
    n = len(media) // PACKET
    p = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    lost = len(media) - n * PACKET + PACKET * int((p[:, 0] != SYNC).sum())
    p = p[p[:, 0] == SYNC]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    programs: dict[int, int] = {}
    for s in _sections(p[pid == 0]):
        if s[0] == 0:
            programs |= {a: b & 0x1FFF for a, b in struct.iter_unpack(">HH", s[8:-4]) if a}
        if programs:
            break
    program, streams = next(iter(programs), None), []
    for s in _sections(p[pid == programs.get(program, -1)]):
        if streams:
            break
        if s[0] == 2:
            at = 12 + (struct.unpack_from(">H", s, 10)[0] & 0xFFF)
            while at + 5 <= len(s) - 4:
                kind, es, info = struct.unpack_from(">BHH", s, at)
                streams.append((es & 0x1FFF, kind))
                at += 5 + (info & 0xFFF)
    none = {"payload": b"", "pts": np.zeros(0, np.int64), "offset": np.zeros(0, np.int64), "random": np.zeros(0, bool), "kept": np.zeros(0, bool)}
    out = {"packets": n, "lost_bytes": lost, "program": program, "streams": streams, "cc_errors": 0, "tables": int((pid == 0).sum())} | none
    if not streams:
        return out
    q = p[pid == streams[0][0]]
    has_field, has_payload = (q[:, 3] & 0x20) > 0, (q[:, 3] & 0x10) > 0
    begin = 4 + np.where(has_field, 1 + q[:, 4].astype(np.int64), 0)
    flags = np.where(has_field & (q[:, 4] > 0), q[:, 5], 0)
    cc = (q[:, 3] & 15).astype(np.int64)
    expect = (cc[:-1] + has_payload[1:]) & 15
    same = has_payload[1:] & (cc[1:] == cc[:-1])
    gap = np.append(False, (cc[1:] != expect) & ~same & ((flags[1:] & 0x80) == 0))
    use = has_payload & (begin < PACKET) & ~np.append(False, same)
    gap_at = np.cumsum(gap)[use]
    start = ((q[:, 1] & 0x40) > 0)[use]
    q, begin, flags = q[use], begin[use], flags[use]
    body = q[np.arange(PACKET)[None, :] >= begin[:, None]]
    sizes = PACKET - begin
    at = (np.cumsum(sizes) - sizes)[start]
    row = np.flatnonzero(start)
    ends = np.append(at[1:], len(body))
    ok = (at + 14 <= len(body)) & (ends - at >= 9)
    at, ends, row = at[ok], ends[ok], row[ok]
    ok = (body[at] == 0) & (body[at + 1] == 0) & (body[at + 2] == 1)
    at, ends, row = at[ok], ends[ok], row[ok]
    h = body[np.minimum(at[:, None] + np.arange(14), len(body) - 1)].astype(np.int64)
    pts = (h[:, 9] >> 1 & 7) << 30 | h[:, 10] << 22 | (h[:, 11] >> 1) << 15 | h[:, 12] << 7 | h[:, 13] >> 1
    pts = np.where(h[:, 7] & 0x80, pts, -1)
    final = np.append(row[1:], len(q)) - 1
    kept = (gap_at[final] == gap_at[row]) if len(row) else np.zeros(0, bool)
    head = 9 + h[:, 8]
    mark = np.zeros(len(body) + 1, np.int8)
    np.add.at(mark, np.minimum(at + head, ends)[kept], 1)
    np.add.at(mark, ends[kept], -1)
    inside = np.cumsum(mark[:-1]) > 0
    length = np.maximum(ends - at - head, 0) * kept
    out |= {"payload": body[inside].tobytes(), "pts": pts, "offset": np.cumsum(length) - length, "random": (flags[row] & 0x40) > 0, "kept": kept, "cc_errors": int(gap.sum())}
    return out


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
UNIT = pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("program", pa.int32()), ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32())]))), ("packets", pa.int64()), ("cc_errors", pa.int64()), ("lost_bytes", pa.int64()), ("units", pa.list_(UNIT)), ("payload", pa.binary())])
STORED_SQL = "doc_id long, n_bytes long, media binary"
READ_SQL = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, program int, streams array<struct<pid:int,type:int>>, packets long, cc_errors long, lost_bytes long, units array<struct<pts:long,offset:long,random_access:boolean>>, payload binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in runs(batch):
            raw, sizes = data.tobytes(), np.diff(offsets)
            media = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                padded = max(1, -(-(b - a) // BLOCK)) * BLOCK
                media.append(store(raw[a:b].ljust(padded, b" ")))
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=STORED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part, out = batch.slice(lo, 1000), []
            for media in part.column(2):
                raw = media.as_py() or b""
                x = read(raw)
                units = [{"pts": t, "offset": o, "random_access": r} for t, o, r, k in zip(x["pts"].tolist(), x["offset"].tolist(), x["random"].tolist(), x["kept"].tolist(), strict=True) if k]
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), x["program"], [{"pid": p, "type": t} for p, t in x["streams"]], x["packets"], x["cc_errors"], x["lost_bytes"], units, x["payload"]))
            columns = [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), list(READ)[2:], strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), *columns], schema=READ)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, STORED_SQL)


def read_media(media: DataFrame) -> DataFrame:
    """Rows with program, streams, counters, units (timestamps, random-access points) and payload of a column media."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ_SQL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    points = F.size(F.filter("units", lambda u: u["random_access"]))
    feature = F.format_string("program=%d packets=%d units=%d random=%d first_pts=%d last_pts=%d cc_errors=%d crc32=%d", "program", "packets", F.size("units"), points, F.array_min("units.pts"), F.array_max("units.pts"), "cc_errors", F.crc32("payload"))
    size = F.octet_length("payload")
    return back.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, octet_length(payload) - 15, 16)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
