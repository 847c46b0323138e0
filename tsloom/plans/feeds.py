"""Queries over files, chunks and live feeds of the encoded events, and over PES packets and units of other tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from tsloom.operators import events, health, psi, units
from tsloom.plans.registry import plain, query
from tsloom.plans.wire import Stream, raw_packets
from tsloom.session import shared_dir, ship, staged, table
from tsloom.sources import synth as S
from tsloom.sources.packets import packets_from_chunks, packets_from_raw, read_ts, write_ts
from tsloom.streaming.live import live_events, live_stats, tap

RAW = "stream_id string, packet_no long, raw binary"
#: A read of any size a task gives the same rows; this one cuts the files of small tables, too.
BYTES_PER_TASK = 188 * 9973


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _named(df):
    """Streams called by their files' names."""
    return df.withColumn("stream_id", F.regexp_extract("stream_id", r"([^/]+)\.ts$", 1))


@query("ts_file_packets", """
SELECT stream_id, pid, count(*) AS packets, CAST(sum(CASE WHEN flag THEN size + CASE WHEN pts IS NULL THEN 0 ELSE 14 END ELSE 0 END) AS BIGINT) AS payload_bytes, min(place) AS first_packet, CAST(sum(place) AS BIGINT) AS places
FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY packet_no) - 1 AS place FROM wire) GROUP BY stream_id, pid""")
def ts_file_packets(spark, d):
    """Each stream as a file that ends inside a packet, read at fixed strides."""
    path = _folder(spark, "feeds")
    write_ts(raw_packets(spark, d), path, b"\x47 half a packet")
    p = _named(read_ts(spark, path, bytes_per_task=BYTES_PER_TASK))
    return p.groupBy("stream_id", "pid").agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").cast("long").alias("payload_bytes"), F.min("packet_no").alias("first_packet"), F.sum("packet_no").alias("places"))


_JUNK = "n % 50 = 10 AND n <= total - 10"


@query("realigned_losses", f"""
SELECT stream_id, place AS before_packet_no, 1 + event_id % 400 AS bytes_discarded, (SELECT count(*) FROM wire x WHERE x.stream_id = w.stream_id) AS packets
FROM (SELECT *, row_number() OVER s AS n, row_number() OVER s AS place, count(*) OVER (PARTITION BY stream_id) AS total FROM wire WINDOW s AS (PARTITION BY stream_id ORDER BY packet_no)) w WHERE {_JUNK}""")
def realigned_losses(spark, d):
    """Each stream as a file with junk between packets: what realignment discards, and where."""
    path = _folder(spark, "broken")
    spread = raw_packets(spark, d).selectExpr("*", "floor(packet_no / 2) AS event_id", "row_number() OVER (PARTITION BY stream_id ORDER BY packet_no) AS n", "count(*) OVER (PARTITION BY stream_id) AS total")
    junk = F.unhex(F.when(F.expr(_JUNK), F.expr("repeat('00', CAST(1 + event_id % 400 AS INT))")).otherwise(""))
    write_ts(spread.select("stream_id", "packet_no", F.concat("raw", junk).alias("raw")), path)
    p, losses = read_ts(spark, path, realign=True, bytes_per_task=BYTES_PER_TASK)
    return _named(losses.join(p.groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets")), "stream_id")).select("stream_id", "before_packet_no", "bytes_discarded", "packets")


@query("sync_lost_events", f"""
SELECT stream_id, count(*) AS places, CAST(sum(1 + event_id % 400) AS BIGINT) AS bytes_discarded, false AS is_healthy
FROM (SELECT *, row_number() OVER s AS n, count(*) OVER (PARTITION BY stream_id) AS total FROM wire WINDOW s AS (PARTITION BY stream_id ORDER BY packet_no)) w WHERE {_JUNK} GROUP BY stream_id""")
def sync_lost_events(spark, d):
    """The same junk between chunks of a feed, as events and in the stream's health; how many events a run of junk makes hangs on the chunks."""
    rows = raw_packets(spark, d).selectExpr("*", "floor(packet_no / 2) AS event_id", "row_number() OVER (PARTITION BY stream_id ORDER BY packet_no) AS n", "count(*) OVER (PARTITION BY stream_id) AS total")
    junk = F.unhex(F.when(F.expr(_JUNK), F.expr("repeat('00', CAST(1 + event_id % 400 AS INT))")).otherwise(""))
    # The feed is written, realigned and scanned once each.
    p, losses = packets_from_chunks(staged(rows.select("stream_id", F.col("packet_no").alias("chunk_no"), F.concat("raw", junk).alias("data")), "chunks"))
    p, losses = health.Scans(staged(p.drop("payload"), "packets")), staged(losses, "losses")
    said = events.stream_events(p, sync_losses=losses).filter("event = 'sync_lost'").groupBy("stream_id").agg(F.sum("a").alias("bytes_discarded"), F.count_distinct("packet_no").alias("places"), F.count(F.lit(1)).alias("n"))
    return health.stream_stats(p, sync_losses=losses).join(said, "stream_id").filter("n = sync_losses").select("stream_id", "places", "bytes_discarded", "is_healthy")


@query("chunked_packets", "SELECT stream_id, pid, count(*) AS packets, CAST(sum(cc) AS BIGINT) AS counters FROM wire GROUP BY stream_id, pid")
def chunked_packets(spark, d):
    """Packets of a feed whose chunks are cut at any byte."""
    p, _ = packets_from_chunks(_chunks(spark, d))
    return p.groupBy("stream_id", "pid").agg(F.count(F.lit(1)).alias("packets"), F.sum("cc").alias("counters"))


def _chunks(spark, d):
    """Every packet in two pieces."""
    cut = "CAST(1 + packet_no % 187 AS INT)"
    pieces = raw_packets(spark, d).selectExpr("stream_id", "packet_no", f"substring(raw, 1, {cut}) AS a", f"substring(raw, {cut} + 1) AS b")
    return pieces.selectExpr("stream_id", "stack(2, 2 * packet_no, a, 2 * packet_no + 1, b) AS (chunk_no, data)")


def _stored_chunks(spark, d):
    path = _folder(spark, "chunks")
    chunks = _chunks(spark, d)
    chunks.write.parquet(path)
    return spark.readStream.schema(chunks.schema).parquet(path)


@query("live_figures", """
SELECT m.stream_id, m.packets, m.payload_bytes, m.continuity_errors, m.packets_lost, m.duplicates, m.transport_errors, c.pcr_discontinuities, c.pcr_repetition_errors FROM
 (SELECT stream_id, count(*) AS packets, CAST(sum(CASE WHEN flag THEN size + CASE WHEN pts IS NULL THEN 0 ELSE 14 END ELSE 0 END) AS BIGINT) AS payload_bytes, count(*) FILTER (WHERE bad) AS continuity_errors, CAST(coalesce(sum(lost) FILTER (WHERE bad), 0) AS BIGINT) AS packets_lost, count(*) FILTER (WHERE dup) AS duplicates, count(*) FILTER (WHERE tei) AS transport_errors FROM marks GROUP BY 1) m
 JOIN (SELECT stream_id, count(*) FILTER (WHERE jump) AS pcr_discontinuities, count(*) FILTER (WHERE gap > 1080000) AS pcr_repetition_errors FROM clocks GROUP BY 1) c USING (stream_id)""")
def live_figures(spark, d):
    """Figures of a feed as the streaming query has them once it has taken every chunk."""
    ship(spark)
    out, state = _folder(spark, "figures"), _folder(spark, "state")
    q = live_stats(_stored_chunks(spark, d)).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda batch, epoch: batch.write.mode("append").parquet(out)).start()
    q.awaitTermination()
    columns = ["packets", "payload_bytes", "continuity_errors", "packets_lost", "duplicates", "transport_errors", "pcr_discontinuities", "pcr_repetition_errors"]
    return spark.read.parquet(out).groupBy("stream_id").agg(F.max_by(F.struct(*columns), "packets").alias("s")).select("stream_id", "s.*")


@query("live_event_counts", """
SELECT stream_id, event, count(*) AS n FROM (
  SELECT stream_id, 'continuity_error' AS event FROM marks WHERE bad UNION ALL SELECT stream_id, 'pcr_discontinuity' FROM clocks WHERE jump UNION ALL SELECT stream_id, 'pcr_repetition_error' FROM clocks WHERE gap > 1080000
  UNION ALL SELECT stream_id, 'pid_discovered' FROM (SELECT DISTINCT stream_id, pid FROM wire)
  UNION ALL SELECT stream_id, 'scrambling_changed' FROM (SELECT *, scr <> 0 AS now, coalesce(lag(scr <> 0) OVER (PARTITION BY stream_id, pid ORDER BY packet_no), false) AS was FROM wire WHERE NOT tei) WHERE now <> was
) GROUP BY stream_id, event""")
def live_event_counts(spark, d):
    """Events that the streaming query appends."""
    ship(spark)
    out, state = _folder(spark, "events"), _folder(spark, "state")
    q = live_events(_stored_chunks(spark, d)).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("stream_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query("tapped_chunks", "SELECT stream_id, 2 * count(*) AS chunks, 188 * count(*) AS n_bytes FROM wire GROUP BY stream_id")
def tapped_chunks(spark, d):
    """What a tap passes on while its listener fails at every batch."""
    ship(spark)
    out, state = _folder(spark, "forwarded"), _folder(spark, "state")

    def alarm(batch, epoch):
        raise RuntimeError("this listener always fails")

    q = tap(_stored_chunks(spark, d), lambda batch, epoch: batch.write.mode("append").parquet(out), alarm, state)
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).groupBy("stream_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("data")).alias("n_bytes"))


@query("packet_texts", """
SELECT stream_id, packet_no, 'TsPacket[pid=0x' || lower(to_hex(pid)) || ', cc=' || cc || ', ' || CASE WHEN flag AND size + CASE WHEN pts IS NULL THEN 0 ELSE 14 END < 184 THEN 'ADAPTATION_AND_PAYLOAD' WHEN flag THEN 'PAYLOAD_ONLY' ELSE 'ADAPTATION_ONLY' END
  || ', payload=' || CASE WHEN flag THEN size + CASE WHEN pts IS NULL THEN 0 ELSE 14 END ELSE 0 END || ' bytes' || CASE WHEN scr <> 0 THEN ', scrambled' ELSE '' END || ']' AS described, pcr / 27000000 AS pcr_seconds FROM wire""")
def packet_texts(spark, d):
    return packets_from_raw(raw_packets(spark, d)).select("stream_id", "packet_no", health.packet_text().alias("described"), (F.col("pcr") / 27_000_000).alias("pcr_seconds"))


@query("malformed_rows", "SELECT stream_id, count(*) FILTER (WHERE event_id % 7 <> 0) AS packets FROM wire GROUP BY stream_id")
def malformed_rows(spark, d):
    """Null rows, rows without a sync byte, of another size, and with an adaptation field past the end are no packets."""
    spoil = F.expr("CASE event_id % 28 WHEN 0 THEN NULL WHEN 7 THEN concat(X'48', substring(raw, 2)) WHEN 14 THEN substring(raw, 1, 187) WHEN 21 THEN concat(substring(raw, 1, 3), X'20FF', substring(raw, 6)) ELSE raw END")
    rows = raw_packets(spark, d).withColumn("event_id", F.expr("floor(packet_no / 2)"))
    return packets_from_raw(rows.select("stream_id", "packet_no", spoil.alias("raw"))).groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets"))


@query("pid_rates", """
SELECT stream_id, pid, packets, points, gops, CASE WHEN points > 0 THEN gops / points ELSE 0 END AS damaged_gop_rate, CASE WHEN points > 0 THEN packets / points ELSE 0 END AS gop_length_packets, pcrs > 0 AS carries_pcr, CASE WHEN packets + lost > 0 THEN lost / (packets + lost) ELSE 0 END AS loss_rate, widest / 27000 AS max_pcr_interval_ms FROM
 (SELECT stream_id, pid, count(*) AS packets, count(*) FILTER (WHERE rap) AS points, count(DISTINCT gop - rap::INT) FILTER (WHERE (tei OR bad) AND gop - rap::INT > 0) AS gops, coalesce(sum(CAST(lost AS BIGINT)) FILTER (WHERE bad), 0)::BIGINT AS lost FROM marks GROUP BY 1, 2)
 JOIN (SELECT stream_id, pid, count(*) AS pcrs, coalesce(max(gap), 0) AS widest FROM clocks GROUP BY 1, 2) USING (stream_id, pid)""")
def pid_rates(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    rows = health.derived_pid(health.pid_stats(s.packets, s.maps)).filter("pid BETWEEN 256 AND 259")
    return rows.select("stream_id", "pid", "packets", F.col("random_access_points").alias("points"), F.col("damaged_gops").alias("gops"), "damaged_gop_rate", "gop_length_packets", "carries_pcr", "loss_rate", "max_pcr_interval_ms")


@query("stream_rates", """
SELECT o.stream_id, errored_seconds, observed_seconds, errored_seconds / observed_seconds AS errored_second_rate, lost / (packets + lost) AS loss_rate FROM
 (SELECT stream_id, max(seconds) AS observed_seconds FROM clocks WHERE pid = 256 GROUP BY 1) o
 JOIN (SELECT stream_id, count(*) + 6 AS packets, coalesce(sum(CAST(lost AS BIGINT)) FILTER (WHERE bad), 0)::BIGINT AS lost FROM marks GROUP BY 1) USING (stream_id)
 JOIN (SELECT stream_id, count(*) FILTER (WHERE seconds IS DISTINCT FROM before) AS errored_seconds FROM (
  SELECT b.stream_id, c.seconds, lag(c.seconds) OVER (PARTITION BY b.stream_id ORDER BY b.packet_no) AS before FROM bad b ASOF JOIN (SELECT stream_id, packet_no, seconds FROM clocks WHERE pid = 256) c
  ON b.stream_id = c.stream_id AND b.packet_no > c.packet_no) GROUP BY 1) USING (stream_id)""")
def stream_rates(spark, d):
    s = Stream.of_events(spark, d, ingest=True)
    return health.stream_stats(s.packets, s.maps).select("stream_id", "errored_seconds", "observed_seconds", "errored_second_rate", "loss_rate")


_IDS = "CASE k % 5 WHEN 0 THEN 224 WHEN 1 THEN 192 WHEN 2 THEN 189 WHEN 3 THEN 190 ELSE 239 END"


@plain("pes_headers", f"""
WITH o AS (SELECT o_orderkey AS k, {_IDS} AS id, (o_orderkey * 7919000 + o_custkey) % 8589934592 AS pts FROM orders)
SELECT k AS packet_no, CAST(id AS INT) AS pes_stream_id, CASE WHEN id <> 190 AND k % 3 < 2 THEN pts END AS pts, CASE WHEN id <> 190 AND k % 3 = 1 THEN (pts + 8589931000) % 8589934592 END AS dts,
  id BETWEEN 224 AND 239 AS is_video, id BETWEEN 192 AND 223 AS is_audio, CASE WHEN id <> 190 AND k % 3 < 2 THEN pts / 90000 END AS pts_seconds, CAST(CASE WHEN id = 190 THEN 6 WHEN k % 3 = 0 THEN 14 WHEN k % 3 = 1 THEN 19 ELSE 9 END AS INT) AS header_length FROM o""")
def pes_headers(spark, d):
    """PES packets of every kind of stream id, with no stamp, one or two."""
    ship(spark)
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "(o_orderkey * 7919000 + o_custkey) % 8589934592 AS pts").selectExpr("*", f"{_IDS} AS id")

    def write(batches):
        for batch in batches:
            raw = []
            for r in batch.to_pylist():
                pts = r["pts"] if r["k"] % 3 < 2 else None
                body = S.pes(r["id"], b"data", pts, (r["pts"] + 8589931000) % (1 << 33) if r["k"] % 3 == 1 else None) if r["id"] != 190 else b"\0\0\1\xbe\0\4xxxx"
                raw.append(("s", r["k"], S.packet(256, r["k"], body, pusi=True)))
            yield pa.RecordBatch.from_pylist([dict(zip(("stream_id", "packet_no", "raw"), x, strict=True)) for x in raw], schema=pa.schema([("stream_id", pa.string()), ("packet_no", pa.int64()), ("raw", pa.binary())]))

    found = units.pes_headers(packets_from_raw(o.mapInArrow(write, RAW)))
    return found.select("packet_no", "pes_stream_id", "pts", "dts", "is_video", "is_audio", "pts_seconds", "header_length")


#: Bytes of a unit, for this query: the engine's own limit is 8 MiB.
SMALL_UNIT = 2000


@plain("unit_sizes", f"""
WITH u AS (SELECT doc_id, source, strlen(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS unit_no, count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT source AS stream_id, unit_no, CASE WHEN doc_id % 7 = 0 THEN 'bad_header' WHEN n > {SMALL_UNIT} THEN 'size' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 3000 END AS pts,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id * 3000 - 900 ELSE doc_id * 3000 END AS decode_timestamp, unit_no = total AS is_tail FROM u""")
def unit_sizes(spark, d):
    """Each text as a unit of its source's track: too large ones, empty ones and such without a header are told apart."""
    u = units.access_units(_text_units(spark, d), max_unit=SMALL_UNIT)
    return u.select("stream_id", "unit_no", "status", "pts", "decode_timestamp", "is_tail")


def _text_units(spark, d):
    ship(spark)
    docs = table(spark, d, "documents").selectExpr("source", "doc_id", "coalesce(text, '') AS text").withColumn("head", F.expr("CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 2 = 0 THEN 19 ELSE 14 END"))
    many = docs.withColumn("many", F.expr("CAST(greatest(1, ceil((head + octet_length(text)) / 184.0)) AS LONG)"))
    many = many.withColumn("before", F.expr("coalesce(sum(many) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))

    def write(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw, key = r["text"].encode(), r["doc_id"]
                body = b"?" + raw if key % 7 == 0 else S.pes(0xE0, raw, key * 3000, key * 3000 - 900 if key % 2 == 0 else None)
                rows = S.pes_packets(256, r["before"] % 16, body)
                yield pa.record_batch([pa.array([r["source"]] * len(rows)), pa.array([r["before"] + i for i in range(len(rows))], pa.int64()), pa.array(rows, pa.binary())], names=["stream_id", "packet_no", "raw"])

    return packets_from_raw(many.mapInArrow(write, RAW))


@plain("unit_bytes", "SELECT source AS stream_id, doc_id * 3000 AS pts, coalesce(text, '') AS data FROM documents WHERE doc_id % 7 <> 0 AND strlen(coalesce(text, '')) > 0")
def unit_bytes(spark, d):
    """The bytes of every sound unit, whole texts."""
    u = units.access_units(_text_units(spark, d)).filter("status = 'ok'")
    return u.select("stream_id", "pts", F.decode("data", "UTF-8").alias("data"))


@query("known_streams", "SELECT DISTINCT stream_id, true AS is_known FROM wire")
def known_streams(spark, d):
    return psi.is_known(psi.latest_map(Stream.of_events(spark, d, ingest=True).log))
