"""Where queries and the SQL that gives the same rows are registered."""

from __future__ import annotations

from tsloom.plans.wire import DUCK

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: CTEs of the oracles behind `wire`: marks (continuity and random access), clocks (PCR rows), errors.
MARKS = """
m0 AS (SELECT *, lag(cc) OVER p AS pc, lag(tei) OVER p AS pt, rai AND NOT tei AS rap FROM wire WINDOW p AS (PARTITION BY stream_id, pid ORDER BY packet_no)),
m1 AS (SELECT *, NOT tei AND pc IS NOT NULL AND NOT pt AS cmp, CASE WHEN flag THEN (pc + 1) % 16 ELSE pc END AS expected FROM m0),
marks AS (SELECT *, coalesce(cmp AND cc <> expected AND NOT disc AND flag AND cc = pc, false) AS dup, coalesce(cmp AND cc <> expected AND NOT disc AND NOT (flag AND cc = pc), false) AS bad, (cc - expected + 16) % 16 AS lost,
  sum(CASE WHEN rap THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, pid ORDER BY packet_no ROWS UNBOUNDED PRECEDING) AS gop FROM m1),
c0 AS (SELECT *, lag(pcr) OVER (PARTITION BY stream_id, pid ORDER BY packet_no) AS prev FROM wire WHERE pcr IS NOT NULL AND NOT tei),
c1 AS (SELECT *, pcr - prev AS delta, pcr // 27000000 AS sec FROM c0),
c2 AS (SELECT *, coalesce(NOT disc AND (delta < 0 OR delta > 2700000), false) AS jump, CASE WHEN sec = lag(sec) OVER (PARTITION BY stream_id, pid ORDER BY packet_no) THEN 0 ELSE 1 END AS turn FROM c1),
clocks AS (SELECT *, CASE WHEN NOT disc AND NOT jump AND delta > 0 THEN delta END AS gap, CAST(sum(turn) OVER (PARTITION BY stream_id, pid ORDER BY packet_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seconds FROM c2),
bad AS (SELECT stream_id, packet_no, pid FROM marks WHERE tei OR bad UNION ALL SELECT stream_id, packet_no, pid FROM clocks WHERE jump)
"""
STARTS = """
, pes0 AS (SELECT w.stream_id, w.pid, w.packet_no, w.pts, c.pcr AS clock FROM wire w ASOF JOIN (SELECT stream_id, pid AS cpid, packet_no, pcr FROM clocks) c
    ON w.stream_id = c.stream_id AND (CASE WHEN w.pid < 258 THEN 256 ELSE 258 END) = c.cpid AND w.packet_no >= c.packet_no WHERE w.pts IS NOT NULL AND NOT w.tei),
pes1 AS (SELECT *, clock - lag(clock) OVER (PARTITION BY stream_id, pid ORDER BY packet_no) AS gap, pts - clock // 300 AS raw FROM pes0),
pes AS (SELECT *, CASE WHEN raw < -4294967296 THEN raw + 8589934592 WHEN raw > 4294967296 THEN raw - 8589934592 ELSE raw END AS skew FROM pes1)
"""
UNITS = """
, a0 AS (SELECT *, CASE WHEN tei THEN -1 WHEN flag THEN cc END AS state FROM wire),
a1 AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY stream_id, pid ORDER BY packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a0),
a2 AS (SELECT *, coalesce(flag AND NOT tei AND prev >= 0, false) AS known FROM a1),
a3 AS (SELECT *, known AND cc <> (prev + 1) % 16 AS gap, pts IS NOT NULL AND NOT tei AS start FROM a2 WHERE NOT (known AND cc = prev)),
a4 AS (SELECT *, CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, pid ORDER BY packet_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit_no, lead(start AND gap) OVER (PARTITION BY stream_id, pid ORDER BY packet_no) AS next_gap FROM a3),
units AS (SELECT stream_id, pid, unit_no, min(packet_no) AS first_packet, CAST(sum(CASE WHEN flag AND NOT tei THEN size ELSE 0 END) AS BIGINT) AS size, bool_or((NOT start AND (gap OR tei)) OR coalesce(next_gap, false)) AS damaged, max(pts) FILTER (WHERE start) AS pts
  FROM a4 WHERE unit_no > 0 GROUP BY ALL)
"""
ES = "pid BETWEEN 256 AND 259"


def query(name: str, sql: str | None = None, extra: str = ""):
    def register(make):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = f"WITH {DUCK.strip()}, {MARKS.strip()} {extra.strip()} {sql.strip()}"
        return make

    return register


def plain(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make

    return register
