"""Elementary streams: PES headers, access units and self-contained keyframes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsloom.functions.text import avc_codec, hevc_codec
from tsloom.functions.wire import NULL_PID, PLAIN_STREAM_IDS, PTS_HZ
from tsloom.operators import health
from tsloom.operators.psi import tracks
from tsloom.session import staged

MAX_UNIT, MAX_KEYFRAME = 8 << 20, 2 << 20
H264, HEVC = 0x1B, 0x24
START_CODE = b"\0\0\0\1"
_HEADER_BYTES = 19


def header_of(payload: Column) -> Column:
    """The PES header that a payload begins with, as a struct; null if it begins none.  Plain expressions over its first bytes."""
    digits = F.hex(F.substring(payload, 1, _HEADER_BYTES))
    size = F.length(digits) / 2
    number = lambda at, n: F.conv(F.substring(digits, 2 * at + 1, 2 * n), 16, 10).cast("long")
    sid, which = number(3, 1), F.shiftright(number(7, 1), 6)
    plain = sid.isin(*PLAIN_STREAM_IDS)
    is_header = (size >= 6) & F.startswith(digits, F.lit("000001")) & (plain | (size >= 9))
    # 40 bits: a prefix, then 3, 15 and 15 bits with a marker behind each.
    stamp = lambda at: F.shiftleft(F.shiftright(number(at, 5), 33).bitwiseAND(7), 30) + F.shiftleft(F.shiftright(number(at, 5), 17).bitwiseAND(0x7FFF), 15) + F.shiftright(number(at, 5), 1).bitwiseAND(0x7FFF)
    both = ~plain & (which == 3) & (size >= 19)
    return F.when(
        is_header,
        F.struct(
            sid.cast("int").alias("stream_id"), number(4, 2).cast("int").alias("packet_length"), F.when(both | (~plain & (which == 2) & (size >= 14)), stamp(9)).alias("pts"), F.when(both, stamp(14)).alias("dts"),
            (~plain & (number(6, 1).bitwiseAND(4) > 0)).alias("data_alignment"), F.when(plain, 6).otherwise(9 + number(8, 1)).cast("int").alias("header_length"),
        ),
    )


def pes_headers(packets: DataFrame, corrupt: bool = False) -> DataFrame:
    """PES headers of packets that begin one, corrupt packets' only if asked for: (stream_id, pid, packet_no, pes_stream_id, packet_length, pts, dts, ...)."""
    starts = packets.filter(F.col("pusi") & (F.lit(corrupt) | ~F.col("tei")) & (F.col("pid") != NULL_PID) & (F.col("payload_len") > 0)).select("stream_id", "pid", "packet_no", "payload")
    found = starts.withColumn("h", header_of(F.col("payload"))).filter("h IS NOT NULL")
    sid = F.col("h.stream_id")
    return found.select(
        "stream_id", "pid", "packet_no", sid.alias("pes_stream_id"), "h.packet_length", "h.pts", "h.dts", "h.data_alignment", "h.header_length",
        sid.between(0xE0, 0xEF).alias("is_video"), sid.between(0xC0, 0xDF).alias("is_audio"), (F.col("h.pts") / PTS_HZ).alias("pts_seconds"),
    )


def track_intervals(maps: DataFrame) -> DataFrame:
    return tracks(maps.filter("programs IS NOT NULL").select("stream_id", "version_no", "from_packet", "to_packet", "programs")).select("stream_id", "from_packet", "to_packet", "pid", "raw_type", "kind_of_stream", "program", "program_pos", "track_pos", "version_no")


def mapped(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows (stream_id, pid, packet_no) of PIDs that the map lists as of their packet, tables that it completes included."""
    t = track_intervals(maps).select("stream_id", "pid", "from_packet", F.coalesce("to_packet", F.lit(1 << 62)).alias("to_packet")).distinct()
    inside = (rows.stream_id == t.stream_id) & (rows.pid == t.pid) & (rows.packet_no >= t.from_packet) & (rows.packet_no < t.to_packet)
    return rows.join(t, inside, "left_semi")


def _unit_marks(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Packets with the number of the unit they belong to and what they do to it; repeated counters are left out.

    Header columns only, and a scan of two levels as in health.marked: windows
    run over CHUNK packets of a stream, and what a chunk must know of those
    before and after it is carried over a table with a row for each.
    """
    p = packets.filter(F.col("pid") != NULL_PID).select(*keys, "packet_no", "tei", "pusi", "afc", "cc", "random_access", "payload_len").withColumn("chunk", F.floor(F.col("packet_no") / F.lit(health.CHUNK)))
    inside, chunks = W.partitionBy(*keys, "chunk").orderBy("packet_no"), W.partitionBy(*keys).orderBy("chunk")
    before, earlier = inside.rowsBetween(W.unboundedPreceding, -1), chunks.rowsBetween(W.unboundedPreceding, -1)
    counts = (F.col("afc").bitwiseAND(1) == 1) & ~F.col("tei")
    # The counter to compare with: of the last packet with a payload flag, unless a corrupt one came since.
    p = p.withColumns({"counts": counts, "state": F.when(F.col("tei"), -1).when(counts, F.col("cc"))})
    ends = p.groupBy(*keys, "chunk").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("packet_no"))).alias("state"))
    ends = ends.select(*keys, "chunk", F.last("state", ignorenulls=True).over(earlier).alias("carried"))
    p = p.join(ends, [*keys, "chunk"]).withColumn("prev", F.coalesce(F.last("state", ignorenulls=True).over(before), F.col("carried")))
    known = F.coalesce(F.col("counts") & (F.col("prev") >= 0), F.lit(False))
    p = p.withColumns({"repeated": known & (F.col("cc") == F.col("prev")), "gap": known & (F.col("cc") != (F.col("prev") + 1) % 16), "start": F.col("pusi") & ~F.col("tei")})
    p = p.filter("NOT coalesce(repeated, false)").withColumn("gap", F.coalesce("gap", F.lit(False))).drop("carried", "state", "prev", "repeated")
    sums = p.groupBy(*keys, "chunk").agg(F.sum(F.col("start").cast("long")).alias("starts"), F.min_by(F.col("start") & F.col("gap"), "packet_no").alias("opens_on_gap"))
    sums = sums.select(*keys, "chunk", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("units_before"), F.lead("opens_on_gap").over(chunks).alias("opens_on_gap"))
    p = p.join(sums, [*keys, "chunk"])
    # A gap on a start belongs to the unit before.
    next_gap = F.coalesce(F.lead(F.col("start") & F.col("gap")).over(inside), F.col("opens_on_gap"), F.lit(False))
    unit_no = F.col("units_before") + F.sum(F.col("start").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return p.select(*keys, "packet_no", unit_no.alias("unit_no"), "start", ((~F.col("start") & (F.col("gap") | F.col("tei"))) | next_gap).alias("damages"), (F.col("start") & F.coalesce("random_access", F.lit(False))).alias("random_access"), (~F.col("tei") & (F.col("payload_len") > 0)).alias("sound"), "payload_len")


def access_units(packets: DataFrame, epoch: str | None = None, max_unit: int = MAX_UNIT) -> DataFrame:
    """Units of each PID: status ok, loss, size, empty or bad_header, and data where ok.

    A unit goes from one start to the next; is_tail marks the last, which only
    the end of the stream closes.  A repeated counter is skipped, a gap damages
    the unit before it, a corrupt packet the one around it.  Units are judged by
    their packets' headers; only the payloads of sound ones travel, each once.
    """
    keys = ["stream_id", "pid", *([epoch] if epoch else [])]
    marks = _unit_marks(packets, keys)
    heads = packets.filter(F.col("pusi") & ~F.col("tei")).select(*keys, "packet_no", header_of(F.col("payload")).alias("h"))
    # What the headers say is read thrice below, and much smaller than the packets.
    marks = staged(marks.join(heads, [*keys, "packet_no"], "left"), "unit-marks")
    # Bytes before the data; of a start without a header nothing counts.
    size = F.when(F.col("start"), F.greatest(F.col("payload_len") - F.col("h.header_length"), F.lit(0))).when(F.col("sound"), F.col("payload_len"))
    u = marks.groupBy(*keys, "unit_no").agg(
        F.min("packet_no").alias("first_packet"), F.first(F.when(F.col("start"), F.col("h")), ignorenulls=True).alias("h"), F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
        F.bool_or("damages").alias("damaged"), F.bool_or("random_access").alias("random_access"), F.bool_or("start").alias("begun"),
    )
    u = u.filter("begun")
    status = F.when(F.col("h").isNull(), "bad_header").when(F.col("size") > max_unit, "size").when(F.col("size") == 0, "empty").when(F.col("damaged"), "loss").otherwise("ok")
    last = u.groupBy(*keys).agg(F.max("unit_no").alias("last_unit"))
    u = staged(u.withColumn("status", status).join(last, keys).withColumn("is_tail", F.col("unit_no") == F.col("last_unit")), "units")
    sound = marks.filter("sound").join(u.filter("status = 'ok'").select(*keys, "unit_no"), [*keys, "unit_no"], "left_semi").select(*keys, "packet_no", "unit_no", F.when(F.col("start"), F.col("h.header_length")).otherwise(0).alias("skip"))
    parts = sound.join(packets.select(*keys, "packet_no", "payload"), [*keys, "packet_no"]).withColumn("part", F.expr("substring(payload, skip + 1)"))
    data = parts.groupBy(*keys, "unit_no").agg(F.expr("listagg(part, X'') WITHIN GROUP (ORDER BY packet_no)").alias("data"))
    u = u.join(data, [*keys, "unit_no"], "left")
    return u.select(*keys, "unit_no", "first_packet", "h.pts", "h.dts", F.coalesce("h.dts", "h.pts").alias("decode_timestamp"), "random_access", "size", "status", "is_tail", "data")


def unit_counters(units: DataFrame, flush: bool = False) -> DataFrame:
    """Completed and discarded units of each PID; without flush the open tail isn't counted, unless its size ended it."""
    closed = F.lit(True) if flush else ~F.col("is_tail")
    return units.groupBy("stream_id", "pid").agg(
        F.count_if((F.col("status") == "ok") & closed).alias("completed"), F.count_if((F.col("status") == "loss") & closed).alias("discarded_for_loss"), F.count_if(F.col("status") == "size").alias("discarded_for_size"),
        F.bool_or(F.col("is_tail") & ~F.col("status").isin("bad_header", "size")).alias("is_assembling"),
    )


def nal_units(data: bytes) -> list[bytes]:
    """Units between 00 00 01 codes, without trailing zeros, empty ones dropped."""
    return [n for n in (part.rstrip(b"\0") for part in data.split(b"\0\0\1")[1:]) if n]


def _picture(codec: int, data: bytes) -> dict:
    """The unit's parameter sets (null without any), newest sequence set, other units and whether it is a random-access picture."""
    if codec == H264:
        kind, sets, sps, delimiter, key = lambda n: n[0] & 31, {7, 8}, 7, 9, {5}
    else:
        kind, sets, sps, delimiter, key = lambda n: n[0] >> 1 & 63, {32, 33, 34}, 33, 35, {19, 20, 21}
    kinds = [(kind(n), n) for n in nal_units(data)]
    params = [n for k, n in kinds if k in sets]
    newest = [n for k, n in kinds if k == sps]
    picture = [n for k, n in kinds if k not in sets and k != delimiter]
    join = lambda units: b"".join(START_CODE + n for n in units)
    return {"params": join(params) or None, "sps": newest[-1] if newest else None, "picture": join(picture), "is_key": any(k in key for k, _ in kinds if k not in sets)}


def _pictures(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for codec, data in batches:
        yield pd.DataFrame([_picture(c, d) for c, d in zip(codec, data, strict=True)], columns=["params", "sps", "picture", "is_key"])


def _names(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for codec, sps in batches:
        yield pd.Series([avc_codec(s) if c == H264 else hevc_codec(s) for c, s in zip(codec, sps, strict=True)], dtype=object)


def video_epochs(maps: DataFrame) -> DataFrame:
    """Spans (stream_id, epoch, pid, codec, from_packet, to_packet) over which the first H.264 or HEVC track of the map stays the same."""
    t = track_intervals(maps).filter(F.col("raw_type").isin(H264, HEVC))
    pick = t.groupBy("stream_id", "version_no").agg(F.min_by(F.struct("pid", "raw_type"), F.struct("program_pos", "track_pos")).alias("v"))
    order = W.partitionBy("stream_id").orderBy("version_no")
    v = maps.select("stream_id", "version_no", "from_packet", "to_packet").join(pick, ["stream_id", "version_no"], "left")
    v = v.withColumn("fresh", (~F.col("v").eqNullSafe(F.lag("v").over(order))).cast("int")).withColumn("epoch", F.sum("fresh").over(order))
    spans = v.groupBy("stream_id", "epoch").agg(F.first("v").alias("v"), F.min("from_packet").alias("from_packet"), F.max(F.coalesce("to_packet", F.lit(1 << 62))).alias("to_packet"))
    return spans.filter("v IS NOT NULL").select("stream_id", "epoch", "v.pid", F.col("v.raw_type").alias("codec"), "from_packet", "to_packet")


def keyframes(packets: DataFrame, maps: DataFrame, include_tail: bool = False, max_bytes: int = MAX_KEYFRAME) -> DataFrame:
    """Random-access pictures with their parameter sets in front: (.., codec_string, data), data null where too large.

    Parameter sets carry over from earlier units of the same track; the last,
    unfinished unit isn't looked at unless include_tail.
    """
    epochs = staged(video_epochs(maps), "epochs")
    e = epochs.withColumnsRenamed({"stream_id": "e_stream", "pid": "e_pid"})
    inside = (F.col("stream_id") == F.col("e_stream")) & (F.col("pid") == F.col("e_pid")) & (F.col("packet_no") >= F.col("from_packet")) & (F.col("packet_no") < F.col("to_packet"))
    own = packets.join(e, inside).drop("e_stream", "e_pid", "from_packet", "to_packet")
    units = access_units(own, "epoch").filter("status = 'ok'" + ("" if include_tail else " AND NOT is_tail"))
    units = units.join(epochs.select("stream_id", "epoch", "codec"), ["stream_id", "epoch"])
    seen = units.withColumn("n", F.pandas_udf(_pictures, "params binary, sps binary, picture binary, is_key boolean")("codec", "data")).drop("data")
    so_far = W.partitionBy("stream_id", "epoch").orderBy("unit_no").rowsBetween(W.unboundedPreceding, 0)
    seen = seen.withColumns({"params": F.last("n.params", ignorenulls=True).over(so_far), "sps": F.last("n.sps", ignorenulls=True).over(so_far)})
    keys = seen.filter("n.is_key AND sps IS NOT NULL AND params IS NOT NULL").withColumn("size", F.octet_length("params") + F.octet_length("n.picture"))
    fits = F.col("size") <= max_bytes
    return keys.select("stream_id", "pid", "epoch", "unit_no", "first_packet", "pts", F.pandas_udf(_names, "string")("codec", "sps").alias("codec_string"), "size", (~fits).alias("skipped_for_size"), F.when(fits, F.concat("params", "n.picture")).alias("data"))


def latest_keyframe(found: DataFrame) -> DataFrame:
    return found.filter("NOT skipped_for_size").groupBy("stream_id").agg(F.max_by(F.struct("pid", "unit_no", "pts", "codec_string", "data"), F.struct("epoch", "unit_no")).alias("k"), F.count(F.lit(1)).alias("keyframes_taken")).select("stream_id", "keyframes_taken", "k.*")
