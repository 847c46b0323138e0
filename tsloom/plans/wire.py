"""The driver's events table as transport streams: an encoding that SQL can follow.

WIRE is the encoding in SQL that Spark and DuckDB share; packets() turns its
rows into 188-byte packets, adds tables in front, and reads them back with the
real source, so every query runs the real engine on real packets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tsloom.operators import psi, units
from tsloom.session import ship, staged
from tsloom.sources import synth as S
from tsloom.sources.packets import packets_from_raw

WIRE = """
e AS (SELECT event_id, 's' || CAST(user_id % 3 AS STRING) AS stream_id, 256 + CAST(floor(user_id / 3.0) AS BIGINT) % 4 AS pid, event_type, value, {us} AS us,
        CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END AS flag FROM {events}),
g AS (SELECT *, CAST(floor(us * 27 / 100000.0) AS BIGINT) % 540000000 AS clock, SUM(flag) OVER (PARTITION BY stream_id, pid ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sent FROM e),
h AS (SELECT event_id, stream_id, event_id * 2 AS packet_no, CAST(pid AS INT) AS pid, CAST((sent + 15) % 16 AS INT) AS cc, flag = 1 AS flag, event_type = 'error' AND event_id % 89 = 0 AS tei, event_type = 'click' AS rai, event_id % 23 = 0 AS disc,
        CASE WHEN CAST(floor(value) AS BIGINT) % 17 = 3 THEN 2 ELSE 0 END AS scr, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN clock END AS pcr,
        CASE WHEN flag = 1 AND event_type = 'view' THEN (CAST(floor(clock / 300.0) AS BIGINT) + CAST(floor(value * 1000) AS BIGINT) % 40000 - 2000 + 8589934592) % 8589934592 END AS pts,
        CAST(20 + event_id % 100 AS INT) AS size
      FROM g WHERE NOT (event_type = 'signup' AND event_id % 97 = 0)),
wire AS (SELECT * FROM h UNION ALL SELECT event_id, stream_id, packet_no + 1, pid, cc, flag, tei, rai, disc, scr, pcr, pts, size FROM h WHERE event_id % 211 = 0)
"""
DUCK = WIRE.format(us="epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')", events="events")
SPARK = WIRE.format(us="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)", events="{events}")

#: Program maps in front of each stream: (program, PMT PID, PCR PID, [(type, PID)]).
PROGRAMS = [(1, 4096, 256, [(0x1B, 256), (0x0F, 257)]), (30, 4097, 258, [(0x24, 258), (0x81, 259), (0x86, 300)])]


def _tables(services: list[tuple[int, str]]) -> list[tuple[int, bytes]]:
    """(packet number, packet) of the tables, which come before all events."""
    raw = [(0, S.pat(1, {n: pid for n, pid, _, _ in PROGRAMS}))]
    raw += [(pid, S.pmt(n, pcr, [(kind, es, *([S.descriptor(10, b"eng\0")] if kind == 0x0F else [])) for kind, es in tracks])) for n, pid, pcr, tracks in PROGRAMS]
    raw.append((17, S.sdt(1, services)))
    out = [(pid, p, i) for pid, section in raw for i, p in enumerate(S.section_payloads(section))]
    return [(k - len(out), S.packet(pid, i, p, pusi=i == 0)) for k, (pid, p, i) in enumerate(out)]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = []
        for r in batch.to_pylist():
            body = bytes([r["event_id"] % 251]) * r["size"]
            payload = None if not r["flag"] else body if r["pts"] is None else S.pes(0xE0, body, r["pts"])
            raw.append(S.packet(r["pid"], r["cc"], payload, pusi=r["pts"] is not None, tei=r["tei"], scrambling=r["scr"], discontinuity=r["disc"], random_access=r["rai"], pcr=r["pcr"]))
        yield pa.record_batch([batch.column(batch.schema.get_field_index("stream_id")), batch.column(batch.schema.get_field_index("packet_no")), pa.array(raw, pa.binary())], names=["stream_id", "packet_no", "raw"])


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows (stream_id, packet_no, raw), without tables."""
    ship(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    rows = spark.sql(f"WITH {SPARK} SELECT * FROM wire", events=events)
    return rows.mapInArrow(_encode, "stream_id string, packet_no long, raw binary")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_packets(spark, sf_dir)
    names = [(r["n_nationkey"], r["n_name"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25 rows
    front = [(s, n, bytearray(p)) for s in ("s0", "s1", "s2") for n, p in _tables(names)]
    return packets_from_raw(raw.unionByName(spark.createDataFrame(front, "stream_id string, packet_no long, raw binary")))


class Stream:
    """Packets and what the engine derives from them, lazily and once.

    The table log is a sliver of the packets that most operators join with, so
    it is staged.  Queries of several passes ingest the packets first: as a
    columnar table each pass reads only the header columns that it needs.
    """

    def __init__(self, packets: DataFrame):
        self.packets = packets

    @classmethod
    def of_events(cls, spark: SparkSession, sf_dir: str, ingest: bool = False) -> Stream:
        p = packets(spark, sf_dir)
        return cls(staged(p, "packets") if ingest else p)

    @cached_property
    def log(self) -> DataFrame:
        return staged(psi.table_log(self.packets), "table-log")

    @cached_property
    def maps(self) -> DataFrame:
        return psi.map_versions(self.log)

    @cached_property
    def pes(self) -> DataFrame:
        return units.mapped(units.pes_headers(self.packets), self.maps)
