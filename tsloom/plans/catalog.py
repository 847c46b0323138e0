"""Registry of the engine's queries and the SQL that gives the same rows from the events table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.functions import dims, text
from tsloom.operators import events, health, psi, scte, units
from tsloom.plans.registry import ES as _ES
from tsloom.plans.registry import ORACLES, QUERIES, STARTS, UNITS, plain, query
from tsloom.plans.wire import Stream
from tsloom.session import table
from tsloom.sources import synth as S
from tsloom.sources.packets import packets_from_raw

@query("pid_packet_counts", "SELECT stream_id, pid, count(*) AS packets, CAST(sum(CASE WHEN flag THEN size + CASE WHEN pts IS NULL THEN 0 ELSE 14 END ELSE 0 END) AS BIGINT) AS payload_bytes, min(packet_no) AS first_packet FROM wire GROUP BY stream_id, pid")
def pid_packet_counts(spark, d):
    return health.packet_counts(Stream.of_events(spark, d).packets).filter(_ES)


@query("stream_totals", "SELECT stream_id, count(*) + 6 AS packets, CAST(sum(CASE WHEN flag THEN size + CASE WHEN pts IS NULL THEN 0 ELSE 14 END ELSE 0 END) + 6 * 184 AS BIGINT) AS payload_bytes, CAST(0 AS BIGINT) AS null_packets FROM wire GROUP BY stream_id")
def stream_totals(spark, d):
    return Stream.of_events(spark, d).packets.groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("payload_bytes"), F.count_if(F.col("pid") == 8191).alias("null_packets"))


@query("continuity_summary", "SELECT stream_id, pid, count(*) FILTER (WHERE bad) AS continuity_errors, CAST(coalesce(sum(lost) FILTER (WHERE bad), 0) AS BIGINT) AS packets_lost, count(*) FILTER (WHERE dup) AS duplicates FROM marks GROUP BY stream_id, pid")
def continuity_summary(spark, d):
    return health.pid_counters(Stream.of_events(spark, d).packets).filter(_ES).select("stream_id", "pid", "continuity_errors", "packets_lost", "duplicates")


@query("continuity_errors", "SELECT stream_id, packet_no, pid, CAST(expected AS BIGINT) AS expected, CAST(cc AS BIGINT) AS actual, CAST(lost AS BIGINT) AS lost FROM marks WHERE bad")
def continuity_errors(spark, d):
    e = events.stream_events(Stream.of_events(spark, d, ingest=True).packets).filter("event = 'continuity_error'")
    return e.select("stream_id", "packet_no", "pid", F.col("a").alias("expected"), F.col("b").alias("actual"), F.col("c").alias("lost"))


@query("loss_rate", "SELECT stream_id, pid, coalesce(sum(lost) FILTER (WHERE bad), 0) / (count(*) + coalesce(sum(lost) FILTER (WHERE bad), 0)) AS loss_rate FROM marks GROUP BY stream_id, pid")
def loss_rate(spark, d):
    c = health.pid_counters(Stream.of_events(spark, d).packets).filter(_ES)
    return c.select("stream_id", "pid", health.ratio(F.col("packets_lost"), F.col("packets") + F.col("packets_lost")).alias("loss_rate"))


@query("transport_errors", "SELECT stream_id, pid, count(*) AS transport_errors FROM wire WHERE tei GROUP BY stream_id, pid")
def transport_errors(spark, d):
    return health.pid_counters(Stream.of_events(spark, d).packets).filter(_ES + " AND transport_errors > 0").select("stream_id", "pid", "transport_errors")


@query("random_access", "SELECT stream_id, pid, count(*) FILTER (WHERE rap) AS random_access_points, CASE WHEN max(top) > 0 THEN count(*) FILTER (WHERE NOT tei AND gop = top) - 1 END AS packets_since_random_access, count(DISTINCT gop - rap::INT) FILTER (WHERE (tei OR bad) AND gop - rap::INT > 0) AS damaged_gops FROM (SELECT *, max(gop) OVER (PARTITION BY stream_id, pid) AS top FROM marks) GROUP BY stream_id, pid")
def random_access(spark, d):
    return health.pid_counters(Stream.of_events(spark, d).packets).filter(_ES).select("stream_id", "pid", "random_access_points", "packets_since_random_access", "damaged_gops")


@query("gop_sessions", "SELECT stream_id, pid, CAST(gop AS BIGINT) AS gop, count(*) AS packets, min(packet_no) AS first_packet, max(packet_no) AS last_packet FROM marks GROUP BY stream_id, pid, gop")
def gop_sessions(spark, d):
    m = health.marked(Stream.of_events(spark, d).packets).filter(_ES)
    return m.groupBy("stream_id", "pid", "gop").agg(F.count(F.lit(1)).alias("packets"), F.min("packet_no").alias("first_packet"), F.max("packet_no").alias("last_packet"))


@query("scrambling_changes", "SELECT stream_id, packet_no, pid, now AS scrambled FROM (SELECT *, scr <> 0 AS now, coalesce(lag(scr <> 0) OVER (PARTITION BY stream_id, pid ORDER BY packet_no), false) AS was FROM wire WHERE NOT tei) WHERE now <> was")
def scrambling_changes(spark, d):
    e = events.stream_events(Stream.of_events(spark, d, ingest=True).packets).filter("event = 'scrambling_changed'")
    return e.select("stream_id", "packet_no", "pid", (F.col("a") == 1).alias("scrambled"))


@query("pcr_discontinuities", "SELECT stream_id, packet_no, pid, prev AS previous, pcr AS current FROM clocks WHERE jump")
def pcr_discontinuities(spark, d):
    return health.pcr_rows(Stream.of_events(spark, d).packets).filter("jump").select("stream_id", "packet_no", "pid", F.col("prev_pcr").alias("previous"), F.col("pcr").alias("current"))


@query("pcr_summary", "SELECT stream_id, pid, count(*) AS pcr_count, arg_max(pcr, packet_no) AS last_pcr, count(*) FILTER (WHERE jump) AS pcr_discontinuities, count(*) FILTER (WHERE gap > 1080000) AS pcr_repetition_errors, coalesce(max(gap), 0) AS max_pcr_interval, max(seconds) AS observed_seconds FROM clocks GROUP BY stream_id, pid")
def pcr_summary(spark, d):
    return health.clock_counters(Stream.of_events(spark, d).packets)


@query("errored_seconds", """
SELECT stream_id, pid, count(*) FILTER (WHERE seconds IS DISTINCT FROM before) AS errored_seconds FROM (
  SELECT b.stream_id, b.pid, c.seconds, lag(c.seconds) OVER (PARTITION BY b.stream_id, b.pid ORDER BY b.packet_no) AS before FROM bad b ASOF JOIN (SELECT stream_id, pid AS cpid, packet_no, seconds FROM clocks) c
  ON b.stream_id = c.stream_id AND (CASE WHEN b.pid < 258 THEN 256 ELSE 258 END) = c.cpid AND b.packet_no > c.packet_no) GROUP BY stream_id, pid""")
def errored_seconds(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    return health.errored_seconds(s.packets, s.maps)[0]


@query("stream_errored_seconds", """
SELECT stream_id, count(*) FILTER (WHERE seconds IS DISTINCT FROM before) AS errored_seconds FROM (
  SELECT b.stream_id, c.seconds, lag(c.seconds) OVER (PARTITION BY b.stream_id ORDER BY b.packet_no) AS before FROM bad b ASOF JOIN (SELECT stream_id, packet_no, seconds FROM clocks WHERE pid = 256) c
  ON b.stream_id = c.stream_id AND b.packet_no > c.packet_no) GROUP BY stream_id""")
def stream_errored_seconds(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    return health.errored_seconds(s.packets, s.maps)[1]


@query("pts_timing", "SELECT stream_id, pid, count(*) AS timestamps, count(*) FILTER (WHERE gap > 18900000) AS pts_repetition_errors, coalesce(max(CASE WHEN gap > 0 THEN gap END), 0) AS max_pts_interval, arg_max(skew, packet_no) AS pts_skew, min(skew) AS min_pts_skew, count(*) FILTER (WHERE skew <= 0) AS late_timestamps FROM pes GROUP BY stream_id, pid", STARTS)
def pts_timing(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    t = health.pes_timing(s.pes, s.packets, s.maps)
    return t.groupBy("stream_id", "pid").agg(F.count(F.lit(1)).alias("timestamps"), F.count_if("breach").alias("pts_repetition_errors"), F.coalesce(F.max("interval"), F.lit(0)).alias("max_pts_interval"), F.max_by("skew", "packet_no").alias("pts_skew"), F.min("skew").alias("min_pts_skew"), F.count_if("is_late").alias("late_timestamps"))


@query("late_timestamps", "SELECT stream_id, packet_no, pid, skew FROM pes WHERE skew <= 0", STARTS)
def late_timestamps(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    return health.pes_timing(s.pes, s.packets, s.maps).filter("is_late").select("stream_id", "packet_no", "pid", "skew")


@query("pes_packets", "SELECT stream_id, pid, count(*) AS pes_packets, arg_max(pts, packet_no) AS last_pts FROM wire WHERE pts IS NOT NULL AND NOT tei GROUP BY stream_id, pid")
def pes_packets(spark, d):
    return Stream.of_events(spark, d, ingest=True).pes.groupBy("stream_id", "pid").agg(F.count(F.lit(1)).alias("pes_packets"), F.max_by("pts", "packet_no").alias("last_pts"))


@query("access_units", "SELECT stream_id, pid, unit_no, first_packet, pts, size, CASE WHEN damaged THEN 'loss' ELSE 'ok' END AS status FROM units", UNITS)
def access_units(spark, d):
    return units.access_units(Stream.of_events(spark, d).packets.filter(_ES)).select("stream_id", "pid", "unit_no", "first_packet", "pts", "size", "status")


@query("access_unit_counters", "SELECT stream_id, pid, count(*) FILTER (WHERE NOT damaged AND NOT tail) AS completed, count(*) FILTER (WHERE damaged AND NOT tail) AS discarded_for_loss, CAST(0 AS BIGINT) AS discarded_for_size, true AS is_assembling FROM (SELECT *, unit_no = max(unit_no) OVER (PARTITION BY stream_id, pid) AS tail FROM units) GROUP BY stream_id, pid", UNITS)
def access_unit_counters(spark, d):
    return units.unit_counters(units.access_units(Stream.of_events(spark, d).packets.filter(_ES)))


_TRACKS = "(SELECT * FROM (VALUES (1, 256, 256, 'H.264 / AVC', NULL), (1, 256, 257, 'AAC (ADTS)', 'eng'), (30, 258, 258, 'H.265 / HEVC', NULL), (30, 258, 259, 'AC-3', NULL), (30, 258, 300, 'SCTE-35 splice', NULL)) t(program, pcr_pid, pid, label, language)) tracks"


@query("tracks", f"SELECT stream_id, program, pcr_pid, pid, label, language FROM (SELECT DISTINCT stream_id FROM wire) CROSS JOIN {_TRACKS}")
def tracks(spark, d):
    return psi.tracks(psi.latest_map(Stream.of_events(spark, d, ingest=True).log)).select("stream_id", "program", "pcr_pid", "pid", "label", "language")


@query("pid_describe", f"""
SELECT p.stream_id, p.pid, CASE p.pid WHEN 0 THEN 'PAT' WHEN 17 THEN 'SDT' WHEN 4096 THEN 'PMT for ' || n_name WHEN 4097 THEN 'PMT for program 30' ELSE (CASE program WHEN 1 THEN n_name ELSE 'program 30' END) || ' ' || label || coalesce(' [' || language || ']', '') END AS description
FROM (SELECT DISTINCT stream_id, pid FROM wire UNION SELECT stream_id, unnest([0, 17, 4096, 4097]) FROM (SELECT DISTINCT stream_id FROM wire)) p CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey = 1) LEFT JOIN {_TRACKS} ON p.pid = tracks.pid""")
def pid_describe(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    return psi.describe_pids(s.packets.select("stream_id", "pid").distinct(), psi.latest_map(s.log))


@query("service_names", "SELECT stream_id, program, CASE program WHEN 1 THEN n_name ELSE 'program 30' END AS described FROM (SELECT DISTINCT stream_id FROM wire) CROSS JOIN (VALUES (1), (30)) p(program) CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey = 1)")
def service_names(spark, d):
    m = psi.latest_map(Stream.of_events(spark, d, ingest=True).log)
    programs = m.select("stream_id", F.explode("programs.program").alias("program"))
    return psi.described_programs(programs, psi.services(m)).select("stream_id", "program", "described")


@query("missing_pids", "SELECT DISTINCT stream_id, 30 AS program, 300 AS pid FROM wire")
def missing_pids(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    return psi.missing_pids(psi.latest_map(s.log), s.packets).select("stream_id", "program", "pid")


@query("event_counts", """
SELECT stream_id, event, count(*) AS n FROM (
  SELECT stream_id, 'continuity_error' AS event FROM marks WHERE bad UNION ALL SELECT stream_id, 'pcr_discontinuity' FROM clocks WHERE jump UNION ALL SELECT stream_id, 'pcr_repetition_error' FROM clocks WHERE gap > 1080000
  UNION ALL SELECT stream_id, 'late_timestamp' FROM pes WHERE skew <= 0 UNION ALL SELECT stream_id, 'pts_repetition_error' FROM pes WHERE gap > 18900000
  UNION ALL SELECT stream_id, 'pid_discovered' FROM (SELECT DISTINCT stream_id, pid FROM wire) UNION ALL SELECT stream_id, unnest(['pid_discovered', 'pid_discovered', 'pid_discovered', 'pid_discovered', 'programs_changed', 'programs_changed', 'programs_changed', 'service_information_changed']) FROM (SELECT DISTINCT stream_id FROM wire)
) GROUP BY stream_id, event""", STARTS)
def event_counts(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    log = s.log
    maps = psi.map_versions(log)
    found = events.stream_events(s.packets, log, maps, units.mapped(units.pes_headers(s.packets), maps))
    return found.filter("event <> 'scrambling_changed'").groupBy("stream_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query("stream_health", """
SELECT m.stream_id, m.bad AS continuity_errors, m.tei AS transport_errors, c.jump AS pcr_discontinuities, m.bad + m.tei + c.jump = 0 AS is_healthy, o.seconds AS observed_seconds FROM
 (SELECT stream_id, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE tei) AS tei FROM marks GROUP BY 1) m JOIN (SELECT stream_id, count(*) FILTER (WHERE jump) AS jump FROM clocks GROUP BY 1) c USING (stream_id)
 JOIN (SELECT stream_id, max(seconds) AS seconds FROM clocks WHERE pid = 256 GROUP BY 1) o USING (stream_id)""")
def stream_health(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    log = s.log
    return health.stream_stats(s.packets, psi.map_versions(log), log).select("stream_id", "continuity_errors", "transport_errors", "pcr_discontinuities", "is_healthy", "observed_seconds")


@plain("bcd_dates", """
SELECT o_orderkey AS id, o_orderdate AS start_ts, CAST(o_orderkey % 86400 AS INT) AS duration_s FROM orders""")
def bcd_dates(spark, d):
    """Order dates as broadcast dates (day number and BCD) and back."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    digits = lambda c: (F.floor(c / 10) * 16 + c % 10).cast("int")
    mjd = (F.datediff(F.to_date("t"), F.lit("1970-01-01")) + 40587).cast("int")
    length = F.col("o_orderkey") % 86400
    back = text.start_time_col(mjd, digits(F.hour("t")), digits(F.minute("t")), digits(F.second("t")))
    span = text.duration_col(digits(F.floor(length / 3600)), digits(F.floor(length / 60) % 60), digits(length % 60))
    return o.select(F.col("o_orderkey").alias("id"), back.cast("timestamp_ntz").alias("start_ts"), span.cast("int").alias("duration_s"))


@plain("running_status_labels", "SELECT n_nationkey AS id, CASE n_nationkey % 8 WHEN 0 THEN 'UNDEFINED' WHEN 1 THEN 'NOT_RUNNING' WHEN 2 THEN 'STARTS_IN_A_FEW_SECONDS' WHEN 3 THEN 'PAUSING' WHEN 4 THEN 'RUNNING' WHEN 5 THEN 'SERVICE_OFF_AIR' ELSE 'RESERVED' END AS status FROM nation")
def running_status_labels(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), dims.running_status(F.col("n_nationkey") % 8).alias("status"))


@plain("stream_type_labels", "SELECT p_partkey AS id, CASE p_partkey % 256 " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in dims.DESCRIPTION.items()) + " ELSE 'type 0x' || upper(to_hex(p_partkey % 256)) END AS label, CASE " + " ".join(f"WHEN p_partkey % 256 IN ({', '.join(str(c) for c, k in dims.KIND.items() if k == kind)}) THEN '{kind}'" for kind in ("VIDEO", "AUDIO", "DATA")) + " ELSE 'UNKNOWN' END AS kind FROM part")
def stream_type_labels(spark, d):
    code = F.col("p_partkey") % 256
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), dims.stream_label(code).alias("label"), dims.stream_kind(code).alias("kind"))


@plain("segmentation_labels", "SELECT p_partkey AS id, CASE p_partkey % 96 " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in dims.SEGMENTATION.items()) + " ELSE 'Unknown' END AS label, p_partkey % 96 > 1 AND p_partkey % 2 = 0 AS is_start, p_partkey % 96 BETWEEN 52 AND 59 AS is_placement FROM part")
def segmentation_labels(spark, d):
    code = F.col("p_partkey") % 96
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), dims.segmentation_label(code).alias("label"), dims.is_segmentation_start(code).alias("is_start"), dims.is_placement_opportunity(code).alias("is_placement"))


@plain("codec_strings_avc", "SELECT o_orderkey AS id, 'avc1.' || lower(lpad(to_hex(o_orderkey % 16777216), 6, '0')) AS codec FROM orders")
def codec_strings_avc(spark, d):
    sps = F.unhex(F.concat(F.lit("67"), F.lpad(F.hex(F.col("o_orderkey") % 16777216), 6, "0")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.avc_codec_col(sps).alias("codec"))


@plain("dvb_text", "SELECT doc_id, text AS decoded FROM documents")
def dvb_text(spark, d):
    """Texts as UTF-8 broadcast strings and back."""
    return table(spark, d, "documents").select("doc_id", text.dvb_text_col(F.concat(F.unhex(F.lit("15")), F.col("text").cast("binary"))).alias("decoded"))


@plain("section_round_trip", "SELECT doc_id, CAST(greatest(1, ceil(length(text) / 900.0)) AS BIGINT) AS n_sections, CAST(strlen(text) AS BIGINT) AS n_bytes, text AS body FROM documents")
def section_round_trip(spark, d):
    """Each whole text as numbered private sections cut into packets, reassembled and joined."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = [r["text"][i : i + 900].encode() for i in range(0, max(1, len(r["text"])), 900)]
                bodies = [p for k, x in enumerate(parts) for p in enumerate(S.section_payloads(S.section(0x80, 1, x, number=k % 256, last=(len(parts) - 1) % 256), r["doc_id"] % 5))]
                out += [{"stream_id": str(r["doc_id"]), "packet_no": i, "raw": S.packet(500, i, p, pusi=k == 0)} for i, (k, p) in enumerate(bodies)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("stream_id", pa.string()), ("packet_no", pa.int64()), ("raw", pa.binary())]))

    p = packets_from_raw(docs.mapInArrow(cut, "stream_id string, packet_no long, raw binary"))
    found = scte.assembled_sections(p).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sort_array(F.collect_list(F.struct("packet_no", "ordinal", "body"))).alias("parts"))
    body = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["body"])), ""))
    return found.select(F.col("stream_id").cast("long").alias("doc_id"), "n_sections", F.octet_length(body).cast("long").alias("n_bytes"), F.decode(body, "UTF-8").alias("body"))


@plain("splice_pre_roll", """
WITH s AS (SELECT o_orderkey AS id, (o_orderkey * 7919) % 8589934592 AS raw, (o_custkey * 1000003) % 8589934592 AS adjust, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 7919 + 90000 * (o_custkey % 7) + o_custkey * 1000003) % 8589934592 END AS video, (o_orderkey * 104729) % 2576980377600 AS pcr FROM orders),
t AS (SELECT *, (raw + adjust) % 8589934592 AS splice_time, coalesce(video, (pcr // 300) % 8589934592) AS now FROM s),
u AS (SELECT *, (splice_time - now + 8589934592) % 8589934592 AS ahead FROM t)
SELECT id, splice_time, CASE WHEN ahead >= 4294967296 THEN ahead - 8589934592 ELSE ahead END AS pre_roll_ticks, CASE WHEN video IS NULL THEN 'PCR' ELSE 'VIDEO_PTS' END AS pre_roll_basis, CASE WHEN id % 2 = 0 THEN 'event ' || id || ' out' ELSE 'time_signal' END AS description FROM u""")
def splice_pre_roll(spark, d):
    """Cues written as sections and read back."""
    o = table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "(o_orderkey * 7919) % 8589934592 AS raw", "(o_custkey * 1000003) % 8589934592 AS adjust", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 7919 + 90000 * (o_custkey % 7) + o_custkey * 1000003) % 8589934592 END AS arrival_video_pts", "(o_orderkey * 104729) % 2576980377600 AS arrival_pcr"
    )

    def write(batches):
        for batch in batches:
            bodies = []
            for r in batch.to_pylist():
                time = (0xFE << 32 | r["raw"]).to_bytes(5, "big")
                insert = r["id"].to_bytes(4, "big") + b"\x7f\xcf" + time + bytes(4)
                bodies.append(S.splice_info(5, insert, adjust=r["adjust"]) if r["id"] % 2 == 0 else S.splice_info(6, time, adjust=r["adjust"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(bodies, pa.binary())], names=["id", "arrival_video_pts", "arrival_pcr", "body"])

    rows = o.mapInArrow(write, "id long, arrival_video_pts long, arrival_pcr long, body binary")
    return scte.with_pre_roll(scte.parse_sections(rows)).select("id", "splice_time", "pre_roll_ticks", "pre_roll_basis", "description")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-PID health of the streams that the events table encodes."""
    s = Stream.of_events(spark, sf_dir, ingest=True)
    return health.derived_pid(health.pid_stats(s.packets, s.maps)).filter(_ES)


from tsloom.plans import feeds, media, programs, splices  # noqa: E402, F401  they register themselves
