"""Queries over elementary streams made of tables: keyframes, fragmented MP4, audio frames, and splice information."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tsloom.functions import mp4
from tsloom.operators import fmp4, psi, scte, units
from tsloom.plans.programs import encoded, framed
from tsloom.plans.registry import plain
from tsloom.plans.wire import Stream
from tsloom.session import ship, staged, table
from tsloom.sources import synth as S

AVC_SPS, AVC_PPS = bytes.fromhex("6764000cacd941419f9f016a02020280000003008000001e078a14cb"), b"\x68\xeb\xe3\xcb"
HEVC_SETS = (b"\x40\x01vps", bytes.fromhex("420101" "01" "60000000" "900000000000" "3c") + b"\xaa\xbb", b"\x44\x01pps")

# Orders as pictures of four tracks, every tenth a random-access one with parameter sets in front; track v3 is HEVC.
_VIDEO = """
v AS (SELECT 'v' || CAST(o_custkey % 4 AS STRING) AS stream_id, o_orderkey AS k, 50 + o_orderkey % 400 AS body, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey % 4) AS total FROM {orders}),
u AS (SELECT *, n % 10 = 0 AS is_key FROM v)"""
_SPARK_VIDEO = f"WITH {_VIDEO} SELECT *, CASE WHEN stream_id = 'v3' THEN 4 + 3 + CASE WHEN is_key THEN 12 + 5 + 17 + 5 ELSE 0 END + 4 + 2 + body ELSE 4 + 2 + CASE WHEN is_key THEN 8 + 28 + 4 ELSE 0 END + 4 + 1 + body END AS size FROM u"


def _packets(spark, d):
    ship(spark)
    rows = spark.sql(_SPARK_VIDEO, orders=table(spark, d, "orders"))
    # A header of 19 bytes; a first packet holds 176, the others 184.
    rows = rows.withColumn("many", F.expr("CAST(1 + ceil(greatest(0, 19 + size - 176) / 184.0) AS LONG)"))
    rows = rows.withColumn("before", F.expr("coalesce(sum(many) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))

    def write(r):
        stream, hevc, n = r["stream_id"], r["stream_id"] == "v3", r["n"]
        body = bytes([1 + r["k"] % 255]) * r["body"]
        if hevc:
            nals = [b"\x46\x01\x50", *(HEVC_SETS if r["is_key"] else ()), (b"\x26\x01" if r["is_key"] else b"\x02\x01") + body]
        else:
            nals = [b"\x09\xf0", *((AVC_SPS, AVC_PPS) if r["is_key"] else ()), (b"\x65" if r["is_key"] else b"\x41") + body]
        data = b"".join(b"\0\0\0\1" + x for x in nals)
        tables = []
        if n == 0:
            tables = framed(stream, 0, 0, S.pat(1, {1: 4096})) + framed(stream, 1, 4096, S.pmt(1, 256, [(0x06, 300), (0x24 if hevc else 0x1B, 256), (0x1B, 257)]))
        unit = S.pes_packets(256, r["before"] % 16, S.pes(0xE0, data, 90000 + 3600 * n, 86400 + 3600 * n), random_access=r["is_key"], pcr=(80000 + 3600 * n) * 300)
        return tables + [(stream, 2 + r["before"] + i, p) for i, p in enumerate(unit)]

    return encoded(rows, write)


_DUCK_VIDEO = f"WITH {_VIDEO.format(orders='orders')}"
_KEY_SIZE = "CAST(CASE WHEN stream_id = 'v3' THEN 12 + 5 + 17 + 5 + 4 + 2 + body ELSE 8 + 28 + 4 + 4 + 1 + body END AS INT)"
_CODEC = "CASE WHEN stream_id = 'v3' THEN 'hev1.1.6.L60.90' ELSE 'avc1.64000c' END"


@plain("keyframes", f"{_DUCK_VIDEO} SELECT stream_id, 256 AS pid, 90000 + 3600 * n AS pts, {_CODEC} AS codec_string, {_KEY_SIZE} AS size FROM u WHERE is_key AND n < total - 1")
def keyframes(spark, d):
    """Random-access pictures with their parameter sets, H.264 and HEVC; a track's last unit isn't looked at."""
    s = Stream(staged(_packets(spark, d), "packets"))
    return units.keyframes(s.packets, s.maps).select("stream_id", "pid", "pts", "codec_string", "size")


@plain("keyframe_bytes", f"""{_DUCK_VIDEO} SELECT stream_id, 90000 + 3600 * n AS pts,
  lower(CASE WHEN stream_id = 'v3' THEN '00000001' || '4001767073' || '00000001' || '42010101600000009000000000003caabb' || '00000001' || '4401707073' || '00000001' || '2601'
  ELSE '00000001' || '6764000cacd941419f9f016a02020280000003008000001e078a14cb' || '00000001' || '68ebe3cb' || '00000001' || '65' END || repeat(lpad(to_hex(1 + k % 255), 2, '0'), CAST(body AS BIGINT))) AS data FROM u WHERE is_key AND n < total - 1""")
def keyframe_bytes(spark, d):
    s = Stream(staged(_packets(spark, d), "packets"))
    return units.keyframes(s.packets, s.maps).select("stream_id", "pts", F.lower(F.hex("data")).alias("data"))


@plain("latest_keyframes", f"{_DUCK_VIDEO} SELECT stream_id, count(*) FILTER (WHERE size <= 400) AS keyframes_taken, count(*) FILTER (WHERE size > 400) AS skipped_for_size, CAST(256 AS INT) AS pid, max(pts) FILTER (WHERE size <= 400) AS pts, any_value(codec) AS codec_string FROM (SELECT *, {_KEY_SIZE} AS size, {_CODEC} AS codec, 90000 + 3600 * n AS pts FROM u WHERE is_key AND n < total - 1) GROUP BY stream_id")
def latest_keyframes(spark, d):
    """The latest picture of each stream that isn't over 400 bytes, and how many were."""
    s = Stream(staged(_packets(spark, d), "packets"))
    found = units.keyframes(s.packets, s.maps, max_bytes=400).persist()
    skipped = found.groupBy("stream_id").agg(F.count_if("skipped_for_size").alias("skipped_for_size"))
    return units.latest_keyframe(found).join(skipped, "stream_id").select("stream_id", "keyframes_taken", "skipped_for_size", "pid", "pts", "codec_string")


@plain("fmp4_fragments", f"""{_DUCK_VIDEO}, g AS (SELECT stream_id, n // 10 AS g, count(*) AS samples, min(n) AS first, CAST(sum(4 + 1 + body) AS BIGINT) AS payload FROM u WHERE stream_id <> 'v3' GROUP BY ALL)
SELECT stream_id, CAST(g + 1 AS INT) AS position, CAST(samples AS INT) AS samples, 86400 + 3600 * first AS base_time, 96 + 16 * samples + payload AS n_bytes, g + 1 AS sequence, 86400 + 3600 * first + 3600 AS first_present FROM g""")
def fmp4_fragments(spark, d):
    """H.264 tracks as fragmented MP4, read back from the boxes' bytes."""
    s = Stream(staged(_packets(spark, d), "packets"))
    segments = fmp4.remux(s.packets, s.log).filter("position > 0")
    number = lambda at, n: F.conv(F.hex(F.substring("data", at + 1, n)), 16, 10).cast("long")
    # The track run's first row: duration, size, flags, composition offset.
    return segments.select("stream_id", F.col("position").cast("int").alias("position"), number(80, 4).cast("int").alias("samples"), number(60, 8).alias("base_time"), F.octet_length("data").cast("long").alias("n_bytes"), number(20, 4).alias("sequence"), (number(60, 8) + number(100, 4)).alias("first_present"))


# Boxes by their standards' sizes: moof 8 (mfhd 16, traf 8 (tfhd 16, tfdt 20, trun 20 + 16 a sample)), mdat 8.
@plain("fmp4_boxes", """
WITH s AS (SELECT o_custkey, strlen(CAST(o_orderkey AS VARCHAR)) AS n, CAST(o_orderkey AS VARCHAR) AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
f AS (SELECT o_custkey, any_value(total) AS total, CAST(sum(n) AS BIGINT) AS payload, string_agg(lpad(to_hex(CASE WHEN total > 1 THEN 1000 ELSE 0 END), 8, '0') || lpad(to_hex(n), 8, '0') || CASE WHEN i = 0 THEN '02000000' ELSE '01010000' END || lpad(to_hex(500), 8, '0'), '' ORDER BY i) AS rows, string_agg(hex(body), '' ORDER BY i) AS media FROM s GROUP BY o_custkey)
SELECT o_custkey, CAST(total AS INT) AS samples, lower(lpad(to_hex(88 + 16 * total), 8, '0') || hex('moof') || '00000010' || hex('mfhd') || '00000000' || lpad(to_hex(o_custkey % 7), 8, '0') || lpad(to_hex(64 + 16 * total), 8, '0') || hex('traf') || '00000010' || hex('tfhd') || '00020000' || '00000001'
  || '00000014' || hex('tfdt') || '01000000' || lpad(to_hex(8589934592 + o_custkey), 16, '0') || lpad(to_hex(20 + 16 * total), 8, '0') || hex('trun') || '01000f01' || lpad(to_hex(total), 8, '0') || lpad(to_hex(96 + 16 * total), 8, '0') || rows || lpad(to_hex(8 + payload), 8, '0') || hex('mdat') || media) AS data FROM f""")
def fmp4_boxes(spark, d):
    """A fragment of each customer's orders as samples, byte for byte."""
    o = table(ship(spark), d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))

    @F.pandas_udf("binary")
    def build(customers: pd.Series, lists: pd.Series) -> pd.Series:
        made = [mp4.fragment(1, int(c) % 7, [mp4.Sample(str(k).encode(), (1 << 33) + c + 1000 * i, (1 << 33) + c + 1000 * i + 500, i == 0) for i, k in enumerate(keys)]) for c, keys in zip(customers, lists, strict=True)]
        return pd.Series(made, dtype=object)

    return o.select("o_custkey", F.size("keys").alias("samples"), F.lower(F.hex(build("o_custkey", "keys"))).alias("data"))


@plain("sps_sizes", """
SELECT p_partkey AS id, CAST(16 * (1 + p_size) - 2 * (p_partkey % 3 + p_partkey % 4) AS INT) AS width, CAST((16 * (1 + p_partkey % 60) - 2 * (p_partkey % 2 + p_partkey % 5)) * CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END AS INT) AS height, p_partkey % 2 = 0 AS extended, CAST(1 AS INT) AS chroma FROM part""")
def sps_sizes(spark, d):
    """Picture sizes of H.264 parameter sets: macroblocks, cropping on all sides, frames or fields, emulation prevention."""

    @F.pandas_udf("width int, height int, extended boolean, chroma int")
    def read(keys: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        found = [mp4.picture_format(S.avc_sps(100 if k % 2 == 0 else 66, k % 256, 1 + s, 1 + k % 60, (k % 3, k % 4, k % 2, k % 5), k % 7 == 0)) for k, s in zip(keys.tolist(), sizes.tolist(), strict=True)]
        return pd.DataFrame([{"width": p.width, "height": p.height, "extended": p.extended, "chroma": p.chroma} for p in found])

    return table(ship(spark), d, "part").select(F.col("p_partkey").alias("id"), read("p_partkey", F.col("p_size").cast("int")).alias("p")).select("id", "p.*")


@plain("avc_settings", """
SELECT p_partkey AS id, lower(lpad(to_hex(49 + p_partkey % 5 + CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END), 8, '0') || hex('avcC') || '01' || CASE WHEN p_partkey % 2 = 0 THEN '64' ELSE '4d' END || '00' || lpad(to_hex(p_partkey % 256), 2, '0') || 'ffe1' || '001c' || '67' || CASE WHEN p_partkey % 2 = 0 THEN '64' ELSE '4d' END || '00' || lpad(to_hex(p_partkey % 256), 2, '0')
  || 'acd941419f9f016a02020280000003008000001e078a14cb' || '01' || lpad(to_hex(2 + p_partkey % 5), 4, '0') || '68' || repeat('ab', 1 + p_partkey % 5) || CASE WHEN p_partkey % 2 = 0 THEN 'fdf8f800' ELSE '' END) AS box FROM part""")
def avc_settings(spark, d):
    """Decoder settings of H.264 tracks, byte for byte; high profiles carry four bytes more."""

    @F.pandas_udf("binary")
    def build(keys: pd.Series) -> pd.Series:
        return pd.Series([mp4.avc_config([b"\x67" + (b"\x64" if k % 2 == 0 else b"\x4d") + bytes([0, k % 256]) + AVC_SPS[4:]], [b"\x68" + b"\xab" * (1 + k % 5)]) for k in keys.tolist()], dtype=object)

    return table(ship(spark), d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.hex(build("p_partkey"))).alias("box"))


@plain("adts_headers", """
SELECT o_orderkey AS id, o_orderkey % 13 >= 2 AND o_custkey % 8 > 0 AS fits, CASE WHEN o_orderkey % 13 >= 2 AND o_custkey % 8 > 0 THEN CAST(7 + 1 + o_orderkey % 700 AS INT) END AS size,
  CASE WHEN o_orderkey % 13 >= 2 AND o_custkey % 8 > 0 THEN CAST(CASE o_orderkey % 13 WHEN 2 THEN 64000 WHEN 3 THEN 48000 WHEN 4 THEN 44100 WHEN 5 THEN 32000 WHEN 6 THEN 24000 WHEN 7 THEN 22050 WHEN 8 THEN 16000 WHEN 9 THEN 12000 WHEN 10 THEN 11025 WHEN 11 THEN 8000 ELSE 7350 END AS INT) END AS rate,
  CASE WHEN o_orderkey % 13 >= 2 AND o_custkey % 8 > 0 THEN CAST(CASE WHEN o_custkey % 8 = 7 THEN 8 ELSE o_custkey % 8 END AS INT) END AS channels,
  CASE WHEN o_orderkey % 13 >= 2 AND o_custkey % 8 > 0 THEN lower(lpad(to_hex(4096 + (o_orderkey % 13) * 128 + (o_custkey % 8) * 8), 4, '0')) END AS config FROM orders""")
def adts_headers(spark, d):
    """Headers of audio frames; rates over 16 bits and layouts described inside are refused."""

    def one(k: int, c: int) -> dict:
        try:
            h = mp4.adts(S.adts_frame(k % 13, c % 8, bytes(1 + k % 700)))
        except ValueError:
            return {"fits": False, "size": None, "rate": None, "channels": None, "config": None}
        return {"fits": True, "size": h.size, "rate": h.rate, "channels": h.channels, "config": h.config.hex()}

    @F.pandas_udf("fits boolean, size int, rate int, channels int, config string")
    def read(keys: pd.Series, customers: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(k, c) for k, c in zip(keys.tolist(), customers.tolist(), strict=True)], columns=["fits", "size", "rate", "channels", "config"])
        return out.astype({"size": "Int32", "rate": "Int32", "channels": "Int32"})

    return table(ship(spark), d, "orders").select(F.col("o_orderkey").alias("id"), read("o_orderkey", "o_custkey").alias("h")).select("id", "h.*")


# Each customer's orders as units of an audio track at 48 kHz: one to three frames each, but five bytes of every unit's
# first frame come with the unit before.  A unit's stamp is that of the first frame that begins in it, its second.
_AUDIO = """
a AS (SELECT o_custkey, o_orderkey AS k, 1 + o_orderkey % 3 AS frames, 10 + o_orderkey % 50 AS body, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS total,
        coalesce(CAST(sum(1 + o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


@plain("aac_fragments", f"WITH {_AUDIO.format(orders='orders').strip()} SELECT CAST(o_custkey AS VARCHAR) AS stream_id, CAST(i AS INT) AS sequence, CAST(frames AS INT) AS samples, 1024 * (before + 1000) AS base_time, 96 + 16 * frames + frames * body AS n_bytes FROM a")
def aac_fragments(spark, d):
    """Audio frames across units as fragments, on the clock that their stamps anchor."""
    rows = spark.sql(f"WITH {_AUDIO} SELECT * FROM a", orders=table(ship(spark), d, "orders"))

    @F.pandas_udf("binary")
    def unit(keys: pd.Series, frames: pd.Series, body: pd.Series, i: pd.Series) -> pd.Series:
        whole = [S.adts_frame(3, 2, bytes([k % 256]) * int(b)) * int(n) for k, n, b in zip(keys, frames, body, strict=True)]
        return pd.Series([data if at == 1 else data[5:] for data, at in zip(whole, i, strict=True)], dtype=object)

    rows = rows.withColumn("data", unit("k", "frames", "body", "i"))
    # The next unit's first five bytes, as they are.
    rows = rows.withColumn("next", F.expr("lead(10 + k % 50) OVER (PARTITION BY o_custkey ORDER BY k)"))

    @F.pandas_udf("binary")
    def joined(data: pd.Series, following: pd.Series) -> pd.Series:
        return pd.Series([x if n != n else x + S.adts_frame(3, 2, bytes(int(n)))[:5] for x, n in zip(data, following, strict=True)], dtype=object)

    stamp = F.expr("CASE WHEN i = 1 THEN 1920 * 1000 ELSE 1920 * (before + 1001) END")
    made = rows.select(F.col("o_custkey").cast("string").alias("stream_id"), F.lit(257).alias("pid"), F.col("i").cast("long").alias("unit_no"), (F.col("i") * 10).cast("long").alias("first_packet"), F.lit("ok").alias("status"), stamp.cast("long").alias("pts"), joined("data", F.col("next").cast("double")).alias("data"))
    found = fmp4.audio_fragments(made)
    number = lambda at, n: F.conv(F.hex(F.substring("data", at + 1, n)), 16, 10).cast("long")
    return found.select("stream_id", "sequence", number(80, 4).cast("int").alias("samples"), number(60, 8).alias("base_time"), F.octet_length("data").cast("long").alias("n_bytes"))
