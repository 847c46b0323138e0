"""Queries over splice information made of orders, and over init segments."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tsloom.functions import dims, mp4
from tsloom.functions.wire import WRAP33
from tsloom.operators import health, psi, scte
from tsloom.plans.media import AVC_SPS
from tsloom.plans.programs import encoded, framed
from tsloom.plans.registry import plain
from tsloom.session import ship, staged, table
from tsloom.sources import synth as S


def _time(ticks: int) -> bytes:
    return (0xFE << 32 | ticks % WRAP33).to_bytes(5, "big")


def _written(rows, write):
    """Rows (id, body) of sections that write(k, c) makes of each order."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"id": r["k"], "body": write(r["k"], r["c"])} for r in batch.to_pylist()], schema=pa.schema([("id", pa.int64()), ("body", pa.binary())]))

    return rows.selectExpr("o_orderkey AS k", "o_custkey AS c").mapInArrow(run, "id long, body binary")


def _segment(k: int, c: int) -> bytes:
    head = b"CUEI" + k.to_bytes(4, "big")
    if k % 17 == 0:
        return head + b"\xff"
    whole, timed, free = k % 5 != 0, k % 3 > 0, k % 2 == 0
    flags = whole << 7 | timed << 6 | free << 5 | (0x1F if free else (k % 4 == 1) << 4 | (c % 2) << 3 | (c % 3 == 0) << 2)
    upid = f" AB{k:08d} ".encode() if k % 2 == 0 else k.to_bytes(8, "big")
    parts = b"" if whole else b"\x01\x07" + bytes(5)
    return head + b"\x7f" + bytes([flags]) + parts + ((c * 90000).to_bytes(5, "big") if timed else b"") + bytes([3 if k % 2 == 0 else 8, len(upid)]) + upid + bytes([k % 96, k % 200, c % 200])


_LABEL = "CASE k % 96 " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in dims.SEGMENTATION.items()) + " ELSE 'Unknown' END"


@plain("segmentation_descriptors", f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 17 = 0 AS off, o_orderkey % 17 > 0 AND o_orderkey % 2 = 1 AS bound FROM orders),
s AS (SELECT *, CASE WHEN off THEN '' WHEN k % 2 = 0 THEN 'AB' || lpad(CAST(k AS VARCHAR), 8, '0') ELSE lpad(upper(to_hex(k)), 16, '0') END AS upid FROM o)
SELECT k AS id, k AS event_id, off AS cancelled, CAST(CASE WHEN off THEN 0 ELSE k % 96 END AS INT) AS type, CASE WHEN NOT off AND k % 3 > 0 THEN c * 90000 END AS duration, upid AS upid_text, bound AS delivery_restricted,
  CASE WHEN bound THEN k % 4 = 1 ELSE true END AS web_delivery_allowed, CASE WHEN bound THEN c % 2 = 0 ELSE false END AS regional_blackout, CASE WHEN bound THEN c % 3 = 0 ELSE true END AS archive_allowed,
  CAST(CASE WHEN off THEN 0 ELSE k % 200 END AS INT) AS segment_num, CAST(CASE WHEN off THEN 0 ELSE c % 200 END AS INT) AS segments_expected,
  CASE WHEN off THEN 'cancel segment ' || k ELSE {_LABEL} || ' [' || upid || ']' || CASE WHEN k % 3 > 0 THEN ' for ' || c || '.0s' ELSE '' END END AS description, (k * 7919 + 5) % 8589934592 AS splice_time FROM s""")
def segmentation_descriptors(spark, d):
    """Segmentation descriptors behind foreign ones: cancelled, restricted, timed, in components, with text and binary identifiers."""
    rows = _written(table(ship(spark), d, "orders"), lambda k, c: S.splice_info(6, _time(k * 7919 % (1 << 33)), S.descriptor(9, b"zz") + S.descriptor(2, _segment(k, c)), adjust=5))
    found = scte.parse_sections(rows).withColumns({"arrival_video_pts": F.lit(None).cast("long"), "arrival_pcr": F.lit(None).cast("long")})
    g = F.get("section.segmentations", F.lit(0))
    names = ["event_id", "cancelled", "type", "duration", "upid_text", "delivery_restricted", "web_delivery_allowed", "regional_blackout", "archive_allowed", "segment_num", "segments_expected"]
    return scte.with_pre_roll(found).select("id", *[g[n].alias(n) for n in names], "description", "splice_time")


@plain("splice_readability", """
SELECT o_orderkey AS id, o_orderkey % 6 NOT IN (2, 3) AS readable, CASE WHEN o_orderkey % 6 NOT IN (2, 3) THEN CAST(CASE WHEN o_orderkey % 6 IN (0, 1) THEN 5 ELSE 6 END AS INT) END AS command, CASE WHEN o_orderkey % 6 NOT IN (2, 3) THEN 4095::INT END AS tier,
  CASE WHEN o_orderkey % 6 NOT IN (2, 3) THEN o_custkey * 1000003 % 8589934592 END AS pts_adjustment, CASE WHEN o_orderkey % 6 NOT IN (2, 3) THEN o_orderkey % 6 = 1 END AS encrypted, CASE WHEN o_orderkey % 6 NOT IN (2, 3) THEN CAST(CASE WHEN o_orderkey % 6 = 5 THEN 2 ELSE 0 END AS INT) END AS segments FROM orders""")
def splice_readability(spark, d):
    """Sections in the clear, encrypted, spoiled, of another table, of unstated length (whose descriptors can't be found), and with two segments."""

    def write(k: int, c: int) -> bytes:
        adjust, insert = c * 1000003 % (1 << 33), k.to_bytes(4, "big") + b"\x7f\x4f" + _time(k) + bytes(4)
        segments = S.descriptor(2, _segment(1, c)) + S.descriptor(0, b"CUEI") + S.descriptor(2, _segment(3, c))
        made = [
            S.splice_info(5, insert, adjust=adjust), S.splice_info(5, b"ciphertext", segments, adjust, encrypted=True), S.splice_info(5, insert, adjust=adjust)[:-1] + b"\0\1", b"\x00" + S.splice_info(5, insert, adjust=adjust)[1:],
            S.splice_info(6, _time(k), segments, adjust, length=0xFFF), S.splice_info(6, _time(k), segments, adjust),
        ]
        return made[k % 6]

    found = scte.parse_sections(_written(table(ship(spark), d, "orders"), write))
    return found.select("id", F.col("section").isNotNull().alias("readable"), "section.command", "section.tier", "section.pts_adjustment", "section.encrypted", F.when(F.col("section").isNotNull(), F.size("section.segmentations")).alias("segments"))


# Orders as cues of three streams, out and in by turns, each behind a picture (every fifth in a corrupt packet) and a
# clock reference of another PID; every tenth cue is spoiled.  After two thirds of a stream its video is off the map for
# thirty cues, and its time is forgotten.  Clocks and times on the wire begin anew where their bits end; what the queries
# read goes on.
_CUES = """
c AS (SELECT 'c' || CAST(o_custkey % 3 AS STRING) AS stream_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey % 3) AS total FROM {orders}),
q AS (SELECT *, n >= floor(total * 2 / 3.0) AND n < floor(total * 2 / 3.0) + 30 AS away, n = floor(total * 2 / 3.0) OR n = floor(total * 2 / 3.0) + 30 AS changes, n % 10 = 9 AS spoiled FROM c)"""
_DUCK_CUES = f"WITH {_CUES.format(orders='orders').strip()}, e AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS sequence, n * 3600 AS pts, n * 1080000 + 5 AS pcr FROM q WHERE NOT spoiled)"


def _cue_packets(spark, d):
    ship(spark)
    # A stream's orders were counted in one task; all tasks write packets.
    rows = spark.sql(f"WITH {_CUES} SELECT stream_id, k, n, away, changes, spoiled FROM q", orders=table(spark, d, "orders")).repartition("k")

    def write(r):
        stream, n, at = r["stream_id"], r["n"], 8 * r["k"]
        out = []
        if n == 0:
            out += framed(stream, at, 0, S.pat(1, {1: 4096}))
        if n == 0 or r["changes"]:
            tracks = [(0x0F, 257), (0x86, 500)] if r["away"] else [(0x0F, 257), (0x1B, 256), (0x86, 500)]
            out += framed(stream, at + 1, 4096, S.pmt(1, 256, tracks, version=n % 32))
        out.append((stream, at + 2, S.packet(256, n, S.pes(0xE0, b"v", 3600 * n), pusi=True, tei=r["k"] % 5 == 0)))
        out.append((stream, at + 3, S.packet(600, 0, None, pcr=1080000 * n + 5)))
        leaves = n % 2 == 0
        insert = (n // 2).to_bytes(4, "big") + b"\x7f" + (b"\xef" if leaves else b"\x4f") + _time(3600 * n + 90000) + (_time(180000) if leaves else b"") + b"\0\1\1\2"
        cue = S.splice_info(5, insert)
        return out + framed(stream, at + 4, 500, cue[:-1] + bytes([cue[-1] ^ r["spoiled"]]))

    return staged(encoded(rows, write), "cues")


def _cue_events(spark, d):
    p = health.unwrapped(_cue_packets(spark, d))
    return scte.on_timeline(scte.splice_events(p, psi.map_versions(staged(psi.table_log(p), "table-log"))))


@plain("splice_events", f"""{_DUCK_CUES} SELECT stream_id, 8 * k + 4 AS packet_no, sequence, pts + 90000 AS splice_time, pcr AS arrival_pcr, CASE WHEN away THEN NULL ELSE pts END AS arrival_video_pts, CASE WHEN away THEN 'PCR' ELSE 'VIDEO_PTS' END AS pre_roll_basis, CAST(90000 AS BIGINT) AS pre_roll_ticks,
  'event ' || (n // 2) || CASE WHEN n % 2 = 0 THEN ' out for 2.0s' ELSE ' in' END AS description FROM e""")
def splice_events(spark, d):
    """Cues with the clock and the video time at their arrival."""
    return _cue_events(spark, d).select("stream_id", "packet_no", "sequence", "splice_time", "arrival_pcr", "arrival_video_pts", "pre_roll_basis", "pre_roll_ticks", "description")


@plain("splice_counters", f"{_DUCK_CUES} SELECT stream_id, count(*) FILTER (WHERE NOT spoiled) AS sections_read, count(*) FILTER (WHERE spoiled) AS sections_unreadable, [500::INT] AS splice_pids FROM q GROUP BY stream_id")
def splice_counters(spark, d):
    p = _cue_packets(spark, d)
    return scte.counters(scte.splice_sections(p, psi.map_versions(staged(psi.table_log(p), "table-log"))))


@plain("splice_pairs", f"""{_DUCK_CUES} SELECT o.stream_id, o.n // 2 AS event_id, o.sequence AS out_sequence, o.pts + 90000 AS out_time, i.sequence AS in_sequence, i.pts + 90000 AS in_time FROM e o LEFT JOIN e i ON i.stream_id = o.stream_id AND i.n = o.n + 1 WHERE o.n % 2 = 0""")
def splice_pairs(spark, d):
    """Each way out with the way back in."""
    return scte.out_in_pairs(_cue_events(spark, d)).select("stream_id", "event_id", "out_sequence", "out_time", "in_sequence", "in_time")


@plain("splice_tracks", f"WITH {_CUES.format(orders='orders').strip()}, v AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS i, 8 * k + 1 AS from_packet, lead(8 * k + 1) OVER (PARTITION BY stream_id ORDER BY n) AS to_packet, away FROM q WHERE n = 0 OR changes) SELECT stream_id, CAST(i + 1 AS INT) AS version_no, 500::INT AS pid, CASE WHEN away THEN NULL ELSE 256::INT END AS video_pid, from_packet, coalesce(to_packet, 4611686018427387904) AS to_packet FROM v")
def splice_tracks(spark, d):
    """Splice tracks by version of the map, with their programs' video."""
    return scte.splice_tracks(psi.map_versions(staged(psi.table_log(_cue_packets(spark, d)), "table-log")))


# Boxes by their standards' sizes: ftyp 36; moov 8, mvhd 108, mvex 8 + 2 x 32; a track 8, tkhd 92, mdia 8, mdhd 32, hdlr 45, minf 8,
# vmhd 20 or smhd 16, dinf 36, stbl 8, stts, stsc and stco 16 each, stsz 20, stsd 16; avc1 86 and avcC, mp4a 36 and esds 39.
@plain("init_segments", """
WITH p AS (SELECT p_partkey AS id, 2 + p_partkey % 9 AS pps, 2 + p_partkey % 11 AS rate, 1 + p_size % 7 AS layout FROM part),
s AS (SELECT *, 86 + 8 + 6 + 30 + 1 + 2 + pps + 4 AS avc1 FROM p),
m AS (SELECT *, 8 + 108 + 72 + (8 + 92 + 8 + 32 + 45 + 8 + 20 + 36 + 8 + 16 + 16 + 16 + 20 + 16 + avc1) + (8 + 92 + 8 + 32 + 45 + 8 + 16 + 36 + 8 + 16 + 16 + 16 + 20 + 16 + 36 + 39) AS moov FROM s)
SELECT id, 36 + moov AS n_bytes, lower('00000024' || hex('ftyp') || hex('isom') || '00000200' || hex('isomiso6iso2avc1mp41') || lpad(to_hex(moov), 8, '0') || hex('moov')) AS head,
  CASE rate WHEN 2 THEN 64000 WHEN 3 THEN 48000 WHEN 4 THEN 44100 WHEN 5 THEN 32000 WHEN 6 THEN 24000 WHEN 7 THEN 22050 WHEN 8 THEN 16000 WHEN 9 THEN 12000 WHEN 10 THEN 11025 WHEN 11 THEN 8000 ELSE 7350 END::BIGINT AS timescale,
  lower('00000027' || hex('esds') || '00000000' || '0319000000' || '0411' || '4015' || repeat('00', 11) || '0502' || lpad(to_hex(4096 + rate * 128 + layout * 8), 4, '0') || '060102') AS esds FROM m""")
def init_segments(spark, d):
    """Movie headers of a video and an audio track: sizes, brands, the audio's time scale and decoder settings."""

    @F.pandas_udf("binary")
    def build(keys: pd.Series, sizes: pd.Series) -> pd.Series:
        made = [mp4.init_segment(([AVC_SPS], [b"\x68" * (2 + k % 9)]), mp4.adts(S.adts_frame(2 + k % 11, 1 + s % 7, b"x"))) for k, s in zip(keys.tolist(), sizes.tolist(), strict=True)]
        return pd.Series(made, dtype=object)

    digits = table(ship(spark), d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.hex(build("p_partkey", F.col("p_size").cast("int")))).alias("x"))
    # The second media header: its time scale is 20 bytes in.
    rate = F.conv(F.substring(F.element_at(F.split("x", F.lower(F.hex(F.lit("mdhd")))), 3), 25, 8), 16, 10).cast("long")
    esds = F.expr("substring(x, instr(x, lower(hex('esds'))) - 8, 78)")
    return digits.select("id", (F.length("x") / 2).cast("long").alias("n_bytes"), F.substring("x", 1, 88).alias("head"), rate.alias("timescale"), esds.alias("esds"))
