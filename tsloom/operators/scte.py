"""SCTE-35 splice information: sections, events with pre-roll, and pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsloom.functions import dims
from tsloom.functions.tables import Sections
from tsloom.functions.wire import PCR_HZ, PTS_HZ, WRAP33, crc_ok
from tsloom.operators.health import as_of
from tsloom.operators.ordered import ordered_fold
from tsloom.operators.units import pes_headers, track_intervals
from tsloom.session import staged

TABLE, SCTE35, CUEI = 0xFC, 0x86, b"CUEI"
INSERT, SIGNAL = 5, 6
#: Kinds of unique identifiers that are text.
TEXT_UPIDS = (0x01, 0x02, 0x03, 0x07, 0x09, 0x0E, 0x0F)
_SEGMENT = "struct<event_id:long,cancelled:boolean,type:int,duration:long,upid_type:int,upid:binary,upid_text:string,segment_num:int,segments_expected:int,delivery_restricted:boolean,web_delivery_allowed:boolean,regional_blackout:boolean,archive_allowed:boolean>"
_INSERT = "struct<event_id:long,cancelled:boolean,out_of_network:boolean,immediate:boolean,splice_time:long,duration:long,auto_return:boolean,program_id:int,avail_num:int,avails_expected:int>"
SECTION = f"command int, pts_adjustment long, tier int, encrypted boolean, splice_insert {_INSERT}, time_signal long, segmentations array<{_SEGMENT}>"


class _Short(Exception):
    """The bytes end before the field."""


class _Reader:
    """Reads big-endian numbers up to a limit."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def number(self, size: int) -> int:
        if self.at + size > self.end:
            raise _Short
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")

    def raw(self, size: int) -> bytes:
        if self.at + size > self.end:
            raise _Short
        self.at += size
        return self.data[self.at - size : self.at]

    def time(self) -> int | None:
        """splice_time(): one byte without a time, five with.  A missing or cut one counts as without."""
        given = self.at < self.end and self.data[self.at] & 0x80
        size = 5 if given else 1
        inside = given and self.at + 5 <= self.end
        value = int.from_bytes(self.data[self.at : self.at + 5], "big") & WRAP33 - 1 if inside else None
        self.at += size
        return value


def _insert(r: _Reader) -> dict:
    out = {"event_id": r.number(4), "cancelled": bool(r.number(1) & 0x80), "out_of_network": False, "immediate": False, "splice_time": None, "duration": None, "auto_return": False, "program_id": 0, "avail_num": 0, "avails_expected": 0}
    if out["cancelled"]:
        return out
    flags = r.number(1)
    out |= {"out_of_network": bool(flags & 0x80), "immediate": bool(flags & 0x10)}
    if flags & 0x40:
        if not out["immediate"]:
            out["splice_time"] = r.time()
    else:
        for _ in range(r.number(1)):
            if r.at >= r.end:
                break
            r.at += 1
            if not out["immediate"]:
                r.time()
    if flags & 0x20:
        value = r.number(5)
        out |= {"auto_return": bool(value >> 39), "duration": value & WRAP33 - 1}
    return out | {"program_id": r.number(2), "avail_num": r.number(1), "avails_expected": r.number(1)}


def upid_text(kind: int, raw: bytes) -> str:
    """Text kinds without blanks and control characters around them, others in hexadecimal."""
    if kind not in TEXT_UPIDS:
        return raw.hex().upper()
    return raw.decode("ascii", "replace").strip("".join(map(chr, range(33))))


def _segmentation(data: bytes, at: int, end: int) -> dict | None:
    r = _Reader(data, at, end)
    try:
        if r.raw(4) != CUEI:
            return None
        out = {"event_id": r.number(4), "cancelled": bool(r.number(1) & 0x80), "type": 0, "duration": None, "upid_type": 0, "upid": b"", "upid_text": "", "segment_num": 0, "segments_expected": 0}
        free = {"delivery_restricted": False, "web_delivery_allowed": True, "regional_blackout": False, "archive_allowed": True}
        if out["cancelled"]:
            return out | free
        flags = r.number(1)
        if not flags & 0x20:
            free = {"delivery_restricted": True, "web_delivery_allowed": bool(flags & 0x10), "regional_blackout": not flags & 0x08, "archive_allowed": bool(flags & 0x04)}
        if not flags & 0x80:
            components = r.number(1)
            r.at += 6 * components
        if flags & 0x40:
            out["duration"] = r.number(5)
        kind, raw = r.number(1), r.raw(r.number(1))
        return out | free | {"upid_type": kind, "upid": raw, "upid_text": upid_text(kind, raw) if raw else "", "type": r.number(1), "segment_num": r.number(1), "segments_expected": r.number(1)}
    except _Short:
        return None


def splice_info(raw: bytes | None) -> dict | None:
    """A whole splice_info_section, or None where it can't be read."""
    if raw is None or len(raw) < 17 or raw[0] != TABLE or not crc_ok(raw):
        return None
    first = int.from_bytes(raw[4:9], "big")
    out = {"command": raw[13], "pts_adjustment": first & WRAP33 - 1, "tier": raw[10] << 4 | raw[11] >> 4, "encrypted": bool(first >> 39), "splice_insert": None, "time_signal": None, "segmentations": []}
    if out["encrypted"]:
        return out
    length = (raw[11] & 15) << 8 | raw[12]
    # A length of all ones means up to the end: no descriptors are read then.
    end = len(raw) - 4 if length == 0xFFF else 14 + length
    if end > len(raw) - 4:
        return None
    r = _Reader(raw, 14, end)
    try:
        if out["command"] == INSERT:
            out["splice_insert"] = _insert(r)
        elif out["command"] == SIGNAL:
            out["time_signal"] = r.time()
    except _Short:
        return None
    at, last = end, len(raw) - 4
    if at + 2 <= last:
        last = min(last, at + 2 + int.from_bytes(raw[at : at + 2], "big"))
        at += 2
        while at + 2 <= last and at + 2 + raw[at + 1] <= last:
            if raw[at] == 2 and (s := _segmentation(raw, at + 2, at + 2 + raw[at + 1])):
                out["segmentations"].append(s)
            at += 2 + raw[at + 1]
    return out


def _parse(sections: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["command", "pts_adjustment", "tier", "encrypted", "splice_insert", "time_signal", "segmentations"]
    for s in sections:
        out = pd.DataFrame([splice_info(b) or dict.fromkeys(names) for b in s], columns=names, dtype=object)
        yield out.astype({"command": "Int64", "pts_adjustment": "Int64", "tier": "Int64", "time_signal": "Int64", "encrypted": "boolean"})


def parse_sections(rows: DataFrame, column: str = "body") -> DataFrame:
    """rows with a struct column section, null where unreadable."""
    parsed = rows.withColumn("section", F.pandas_udf(_parse, SECTION)(F.col(column)))
    return parsed.withColumn("section", F.when(F.col("section.command").isNotNull(), F.col("section")))


class _SectionFold:
    def __init__(self, key: tuple):
        self.key, self.sections = {"stream_id": key[0], "pid": key[1]}, Sections()

    def step(self, row: dict) -> list[dict]:
        found = self.sections.feed(row["payload"] or b"", row["pusi"], row["tei"] or row["scrambling_control"] != 0)
        return [self.key | {"packet_no": row["packet_no"], "ordinal": i, "body": s["body"]} for i, s in enumerate(found)]

    def end(self) -> list[dict]:
        return []


def assembled_sections(packets: DataFrame) -> DataFrame:
    """Sections of each PID, whatever they hold: (stream_id, pid, packet_no, ordinal, body)."""
    rows = packets.select("stream_id", "pid", "packet_no", "tei", "scrambling_control", "pusi", "payload")
    return ordered_fold(rows, ["stream_id", "pid"], "packet_no", _SectionFold, "stream_id string, pid int, packet_no long, ordinal int, body binary")


def splice_tracks(maps: DataFrame) -> DataFrame:
    """Splice tracks by map version with the first video track of their program."""
    t = track_intervals(maps)
    video = t.filter("kind_of_stream = 'VIDEO'").groupBy("stream_id", "version_no", "program").agg(F.min_by("pid", "track_pos").alias("video_pid"))
    return t.filter(F.col("raw_type") == SCTE35).join(video, ["stream_id", "version_no", "program"], "left").select("stream_id", "version_no", "pid", "video_pid", "from_packet", F.coalesce("to_packet", F.lit(1 << 62)).alias("to_packet"))


def video_spans(maps: DataFrame) -> DataFrame:
    """Spans (stream_id, video_pid, span, from_packet, to_packet) of map versions over which a splice track's video stays listed: its time is kept that long."""
    listed = splice_tracks(maps).filter("video_pid IS NOT NULL").select("stream_id", "version_no", "video_pid", "from_packet", "to_packet").distinct()
    run = F.col("version_no") - F.row_number().over(W.partitionBy("stream_id", "video_pid").orderBy("version_no"))
    return listed.withColumn("run", run).groupBy("stream_id", "video_pid", "run").agg(F.min("from_packet").alias("from_packet"), F.max("to_packet").alias("to_packet")).withColumn("span", F.col("from_packet")).drop("run")


def splice_sections(packets: DataFrame, maps: DataFrame) -> DataFrame:
    """Sections on splice tracks, read or not: (.., video_pid, body, section)."""
    t = splice_tracks(maps).drop("version_no").withColumnsRenamed({"stream_id": "t_stream", "pid": "t_pid"})
    inside = (F.col("stream_id") == F.col("t_stream")) & (F.col("pid") == F.col("t_pid")) & (F.col("packet_no") >= F.col("from_packet")) & (F.col("packet_no") < F.col("to_packet"))
    own = packets.join(t.select("t_stream", "t_pid", "from_packet", "to_packet").distinct(), inside, "left_semi")
    found = assembled_sections(own).join(t, inside, "left").drop("t_stream", "t_pid", "from_packet", "to_packet")
    # A stream's sections come out of one task; all tasks parse.
    return parse_sections(found.repartition("stream_id", "packet_no"))


def splice_events(packets: DataFrame, maps: DataFrame) -> DataFrame:
    """Readable splice sections in order with arrival clock (any PID's), arrival video time (of corrupt packets, too) and pre-roll."""
    # Each merge reads its left side twice: stored, the sections are put together and parsed once.
    rows = staged(splice_sections(packets, maps).filter("section IS NOT NULL"), "sections")
    clock = packets.filter("pcr IS NOT NULL").select("stream_id", "packet_no", F.col("pcr").alias("arrival_pcr"))
    rows = as_of(rows, clock, ["stream_id"], F.col("packet_no"), ["arrival_pcr"], same=True)
    v = video_spans(maps).withColumnsRenamed({"stream_id": "v_stream", "video_pid": "v_pid"})
    inside = lambda pid: (F.col("stream_id") == F.col("v_stream")) & (F.col(pid) == F.col("v_pid")) & (F.col("packet_no") >= F.col("from_packet")) & (F.col("packet_no") < F.col("to_packet"))
    heads = pes_headers(packets.join(v.select("v_stream", "v_pid").distinct(), (F.col("stream_id") == F.col("v_stream")) & (F.col("pid") == F.col("v_pid")), "left_semi"), corrupt=True)
    times = heads.filter("pts IS NOT NULL").join(v, inside("pid")).select("stream_id", F.col("pid").alias("video_pid"), "span", "packet_no", F.col("pts").alias("arrival_video_pts"))
    rows = rows.join(v, inside("video_pid"), "left").drop("v_stream", "v_pid", "from_packet", "to_packet")
    rows = as_of(rows, times, ["stream_id", "video_pid", "span"], F.col("packet_no"), ["arrival_video_pts"], same=True).drop("span")
    order = W.partitionBy("stream_id").orderBy("packet_no", "ordinal")
    return with_pre_roll(rows.withColumn("sequence", F.row_number().over(order).cast("long")))


def splice_time(section: Column) -> Column:
    raw = F.when(section["command"] == INSERT, section["splice_insert"]["splice_time"]).when(section["command"] == SIGNAL, section["time_signal"])
    return F.pmod(raw + section["pts_adjustment"], F.lit(WRAP33))


def ticks_until(now: Column, then: Column) -> Column:
    """From now to then, the short way round 33 bits; half the range counts as past."""
    ahead = F.pmod(then - now, F.lit(WRAP33))
    return F.when(ahead >= WRAP33 // 2, ahead - WRAP33).otherwise(ahead)


def with_pre_roll(rows: DataFrame) -> DataFrame:
    """Adds splice_time, pre_roll_ticks, pre_roll_seconds, pre_roll_basis and description."""
    s = F.col("section")
    now = F.coalesce("arrival_video_pts", F.pmod(F.floor(F.col("arrival_pcr") / F.lit(300)), F.lit(WRAP33)))
    rows = rows.withColumn("splice_time", splice_time(s)).withColumn("pre_roll_ticks", ticks_until(now, F.col("splice_time")))
    basis = F.when(F.col("pre_roll_ticks").isNull(), "NONE").when(F.col("arrival_video_pts").isNotNull(), "VIDEO_PTS").otherwise("PCR")
    return rows.withColumns({"pre_roll_seconds": F.col("pre_roll_ticks") / PTS_HZ, "arrival_seconds": F.col("arrival_pcr") / PCR_HZ, "pre_roll_basis": basis, "description": describe(s)})


def on_timeline(events: DataFrame) -> DataFrame:
    """events, of packets with health.unwrapped clocks, with their splice and video times on the timeline of the arrival clock instead of modulo 33 bits."""
    now = F.floor(F.col("arrival_pcr") / F.lit(300))
    video = F.col("arrival_video_pts")
    events = events.withColumn("arrival_video_pts", F.coalesce(now + ticks_until(F.pmod(now, F.lit(WRAP33)), video), video))
    # The pre-roll leads from the video's time, or the clock's, to the splice.
    return events.withColumn("splice_time", F.coalesce(F.coalesce("arrival_video_pts", now) + F.col("pre_roll_ticks"), F.col("splice_time")))


def _for(duration: Column) -> Column:
    return F.when(duration.isNotNull(), F.format_string(" for %.1fs", duration / PTS_HZ)).otherwise("")


def describe_segmentation(g: Column) -> Column:
    upid = F.when(g["upid_text"] != "", F.concat(F.lit(" ["), g["upid_text"], F.lit("]"))).otherwise("")
    return F.when(g["cancelled"], F.concat(F.lit("cancel segment "), g["event_id"])).otherwise(F.concat(dims.segmentation_label(g["type"]), upid, _for(g["duration"])))


def describe(s: Column) -> Column:
    """One line for a section."""
    i = s["splice_insert"]
    event = F.concat(F.lit("event "), i["event_id"], F.when(i["out_of_network"], " out").otherwise(" in"), _for(i["duration"]))
    insert = F.when(i["cancelled"], F.concat(F.lit("cancel event "), i["event_id"])).otherwise(event)
    label = dims.command_label(s["command"])
    return F.when(s["encrypted"], F.concat(F.lit("encrypted "), label)).when(F.size(s["segmentations"]) > 0, describe_segmentation(F.get(s["segmentations"], F.lit(0)))).when(i.isNotNull(), insert).otherwise(label)


def counters(sections: DataFrame) -> DataFrame:
    return sections.groupBy("stream_id").agg(F.count_if(F.col("section").isNotNull()).alias("sections_read"), F.count_if(F.col("section").isNull()).alias("sections_unreadable"), F.sort_array(F.collect_set("pid")).alias("splice_pids"))


def out_in_pairs(events: DataFrame) -> DataFrame:
    """Each out-of-network insert with the next insert back in of the same event."""
    i = events.filter("section.splice_insert IS NOT NULL AND NOT section.splice_insert.cancelled").select("stream_id", "pid", F.col("section.splice_insert.event_id").alias("event_id"), F.col("section.splice_insert.out_of_network").alias("is_out"), "splice_time", "sequence")
    later = W.partitionBy("stream_id", "pid", "event_id").orderBy("sequence").rowsBetween(1, W.unboundedFollowing)
    i = i.withColumn("back", F.first(F.when(~F.col("is_out"), F.struct("sequence", "splice_time")), ignorenulls=True).over(later))
    return i.filter("is_out").select("stream_id", "pid", "event_id", F.col("sequence").alias("out_sequence"), F.col("splice_time").alias("out_time"), F.col("back.sequence").alias("in_sequence"), F.col("back.splice_time").alias("in_time"))
