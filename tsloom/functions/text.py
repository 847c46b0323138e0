"""Broadcast text, times and codec names."""

from __future__ import annotations

import codecs
import datetime as dt
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tsloom.functions.wire import _CRC, u16

CRC_TABLE = np.array(_CRC, np.uint32)

# Upper half of ISO 6937 from A0, a row of eight each; "." stands for unassigned.
_UPPER = (
    " ¡¢£$¥.§" "¤‘“«←↑→↓"
    "°±²³×µ¶·" "÷’”»¼½¾¿"
    "........" "........"
    "\u2015¹®©™♪¬¦" "....⅛⅜⅝⅞"
    "\u2126ÆĐªĦ.ĲĿ" "ŁØŒºÞŦŊŉ"
    "ĸæđðħıĳŀ" "łøœßþŧŋ\u00ad"
)
# Combining marks C1 to CF of ISO 6937; "." stands for unassigned.
_MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308.\u030a\u0327\u0332\u030b\u0328\u030c"
LOST = "�"


def iso6937(raw: bytes) -> str:
    """A mark precedes its base letter; 24 is the currency sign, control codes go but for the line break 8A."""
    out, mark = [], ""
    for b in raw:
        if mark:
            out.append(unicodedata.normalize("NFC", chr(b) + mark))
            mark = ""
        elif b == 0x8A:
            out.append("\n")
        elif b < 0x20 or 0x80 <= b < 0xA0:
            continue
        elif b < 0x80:
            out.append("¤" if b == 0x24 else chr(b))
        elif 0xC1 <= b <= 0xCF and _MARKS[b - 0xC1] != ".":
            mark = _MARKS[b - 0xC1]
        else:
            out.append(LOST if _UPPER[b - 0xA0] == "." else _UPPER[b - 0xA0])
    return "".join(out) + (LOST if mark else "")


def _charset(name: str, raw: bytes) -> str:
    try:
        return codecs.lookup(name).decode(raw, "replace")[0]
    except LookupError:
        return LOST * len(raw)


def dvb_text(raw: bytes | None) -> str | None:
    """Text with its character set in the first byte or bytes."""
    if not raw:
        return raw if raw is None else ""
    kind, body = raw[0], bytes(raw[1:])
    if kind >= 0x20:
        return iso6937(raw)
    if 1 <= kind <= 11:
        return _charset(f"iso8859-{kind + 4}", body)
    if kind == 0x10:
        return _charset(f"iso8859-{body[1]}", body[2:]) if len(body) > 1 else ""
    if kind in (0x11, 0x15):
        return body.decode("utf-16-be" if kind == 0x11 else "utf-8", "replace")
    return LOST * max(1, len(body))


def dvb_text_col(raw: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(dvb_text), "string")(raw)


def crc32_mpeg_col(raw: Column) -> Column:
    """The checksum of each value: all rows of a batch go forward a byte at a time."""

    def crc(values: pa.Array) -> pa.Array:
        values = pa.concat_arrays([values.cast(pa.large_binary())])
        _, offsets, data = values.buffers()
        offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        out, open_ = np.full(len(values), 0xFFFFFFFF, np.uint32), order
        for at in range(int(sizes.max(initial=0))):
            open_ = open_[: int(np.searchsorted(-sizes[open_], -at))]  # longest first: those that have a byte here
            out[open_] = (out[open_] << np.uint32(8)) ^ CRC_TABLE[(out[open_] >> np.uint32(24)) ^ data[offsets[open_] + at]]
        return pa.array(out.astype(np.int64), mask=values.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(crc, "long")(raw)


def bcd(value: Column) -> Column:
    """Two decimal digits; digits over nine carry into the tens, as broadcasters' decoders do."""
    return F.shiftright(value, 4) * 10 + value.bitwiseAND(15)


def start_time_col(mjd: Column, h: Column, m: Column, s: Column) -> Column:
    """UTC timestamp of a modified Julian date and BCD time; null where undefined or no time of day."""
    undefined = (mjd == 0xFFFF) & (h == 255) & (m == 255) & (s == 255)
    ok = ~undefined & (bcd(h) < 24) & (bcd(m) < 60) & (bcd(s) < 60)
    return F.when(ok, F.timestamp_seconds((mjd.cast("long") - 40587) * 86400 + bcd(h) * 3600 + bcd(m) * 60 + bcd(s)))


def duration_col(h: Column, m: Column, s: Column) -> Column:
    """Seconds of a BCD duration; 0 where invalid."""
    return F.when((bcd(h) < 100) & (bcd(m) < 60) & (bcd(s) < 60), bcd(h) * 3600 + bcd(m) * 60 + bcd(s)).otherwise(0)


def _digits(b: int) -> int:
    return (b >> 4) * 10 + (b & 15)


def start_time(raw: bytes) -> dt.datetime | None:
    h, m, s = map(_digits, raw[2:5])
    if raw[:5] == b"\xff" * 5 or h > 23 or m > 59 or s > 59:
        return None
    return dt.datetime(1970, 1, 1) + dt.timedelta(days=u16(raw, 0) - 40587, hours=h, minutes=m, seconds=s)


def duration(raw: bytes) -> int:
    h, m, s = map(_digits, raw[:3])
    return 0 if h > 99 or m > 59 or s > 59 else h * 3600 + m * 60 + s


def avc_codec_col(sps: Column) -> Column:
    """avc1.PPCCLL of an H.264 sequence parameter set; null under four bytes."""
    return F.when(F.octet_length(sps) >= 4, F.concat(F.lit("avc1."), F.lower(F.hex(F.substring(sps, 2, 3)))))


def avc_codec(sps: bytes) -> str:
    if len(sps) < 4:
        raise ValueError(f"an H.264 parameter set has at least 4 bytes, not {len(sps)}")
    return "avc1." + sps[1:4].hex()


def unescaped(nal: bytes) -> bytes:
    """Without emulation prevention bytes."""
    out, zeros = bytearray(), 0
    for b in nal:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        zeros = 0 if b else zeros + 1
        out.append(b)
    return bytes(out)


def hevc_codec(sps: bytes) -> str:
    """hev1 with profile, mirrored compatibility flags, tier and level, constraint bytes without trailing zeros."""
    body = unescaped(sps[2:])
    if len(body) < 13:
        raise ValueError("the parameter set ends before its profile, tier and level")
    general = body[1]
    flags = int(f"{int.from_bytes(body[2:6], 'big'):032b}"[::-1], 2)
    space = chr(64 + (general >> 6)) if general >> 6 else ""
    parts = [f"hev1.{space}{general & 31}", f"{flags:X}", f"{'H' if general & 32 else 'L'}{body[12]}"]
    return ".".join([*parts, *(f"{b:02X}" for b in body[6:12].rstrip(b"\0"))])


def hevc_codec_col(sps: Column) -> Column:
    return F.arrow_udf(lambda values: pa.array([None if v is None else hevc_codec(v) for v in values.to_pylist()], pa.string()), "string")(sps)
