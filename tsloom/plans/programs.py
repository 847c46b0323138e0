"""Queries over tables that change, repeat and break, over networks, lookups, guides and broadcast texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tsloom.functions import text
from tsloom.operators import events, health, psi
from tsloom.plans.registry import plain
from tsloom.session import ship, staged, table
from tsloom.sources import synth as S
from tsloom.sources.packets import packets_from_raw

RAW = "stream_id string, packet_no long, raw binary"
_RAW = pa.schema([("stream_id", pa.string()), ("packet_no", pa.int64()), ("raw", pa.binary())])


def encoded(rows, write):
    """Packets that write(row) makes of each row: (stream_id, packet_no, raw) tuples."""

    def run(batches):
        for batch in batches:
            out = [dict(zip(("stream_id", "packet_no", "raw"), x, strict=True)) for r in batch.to_pylist() for x in write(r)]
            yield pa.RecordBatch.from_pylist(out, schema=_RAW)

    return packets_from_raw(rows.mapInArrow(run, RAW))


def framed(stream: str, number: int, pid: int, section: bytes, **options) -> list[tuple]:
    """The packets of a section, one behind the other."""
    return [(stream, number + i, S.packet(pid, i, p, pusi=i == 0, **options)) for i, p in enumerate(S.section_payloads(section))]


# Each order is a table of its stream, by the remainder of its key: a PAT that names one program or two, the PMT of
# program 1, an SDT, or a packet on the PAT's PID that can't be used (corrupt, scrambled, or the tail of a section never
# begun).  Some tables fail their checksum, some hold for later only.  A clock reference follows each; on the wire it
# begins anew where its bits end, what the queries read goes on.
_ORDERS = """
o AS (SELECT 't' || CAST(o_custkey % 3 AS STRING) AS stream_id, o_orderkey AS k, o_custkey AS c, o_orderstatus = 'F' AS two, o_orderpriority AS name,
        CAST(SUM(CASE WHEN o_custkey % 7 = 0 THEN 9000000 ELSE 2000000 END) OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS BIGINT) AS pcr FROM {orders}),
k AS (SELECT *, k % 4 AS kind, k % 44 = 0 OR k % 52 = 1 OR k % 38 = 2 AS spoiled, k % 60 = 5 AS later FROM o)"""

_TABLES = f"""
WITH {_ORDERS.format(orders='orders').strip()},
pats AS (SELECT *, lag(two) OVER (PARTITION BY stream_id ORDER BY k) AS was FROM k WHERE kind = 0 AND NOT spoiled),
begun AS (SELECT stream_id, min(k) AS first FROM pats GROUP BY stream_id),
pmts AS (SELECT p.*, lag(c % 2) OVER (PARTITION BY p.stream_id ORDER BY k) AS was FROM k p JOIN begun USING (stream_id) WHERE kind = 1 AND NOT spoiled AND NOT later AND k > first),
sdts AS (SELECT *, lag(name) OVER (PARTITION BY stream_id ORDER BY k) AS was FROM k WHERE kind = 2 AND NOT spoiled),
changes AS (SELECT stream_id, 2 * k AS packet_no, 'programs' AS kind FROM pats WHERE two IS DISTINCT FROM was UNION ALL SELECT stream_id, 2 * k, 'programs' FROM pmts WHERE c % 2 IS DISTINCT FROM was
  UNION ALL SELECT stream_id, 2 * k, 'services' FROM sdts WHERE name IS DISTINCT FROM was),
timed AS (SELECT s.stream_id, s.pid, s.k, k.pcr FROM (SELECT stream_id, 0 AS pid, k FROM pats UNION ALL SELECT stream_id, 4096, k FROM pmts) s ASOF JOIN k ON s.stream_id = k.stream_id AND s.k > k.k),
gaps AS (SELECT *, pcr - lag(pcr) OVER (PARTITION BY stream_id, pid ORDER BY k) AS gap FROM timed),
"""


def table_packets(spark, d):
    ship(spark)
    # A stream's clock was summed in one task; all tasks write packets.
    rows = spark.sql(f"WITH {_ORDERS} SELECT * FROM k", orders=table(spark, d, "orders")).repartition("k")

    def write(r):
        stream, at, key = r["stream_id"], 2 * r["k"], r["k"]
        out = [(stream, at + 1, S.packet(256, 0, None, pcr=r["pcr"]))]
        if r["kind"] == 0:
            out += framed(stream, at, 0, S.pat(1, {1: 4096, 2: 4097} if r["two"] else {1: 4096}, version=key % 32, spoil=r["spoiled"]))
        elif r["kind"] == 1:
            tracks = [(0x1B, 256), (0x0F, 257 + r["c"] % 2, S.descriptor(10, b"eng\0" if r["c"] % 2 else b"fra\0"))]
            out += framed(stream, at, 4096, S.pmt(1, 256, tracks, current=not r["later"], spoil=r["spoiled"]))
        elif r["kind"] == 2:
            out += framed(stream, at, 17, S.sdt(1, [(1, r["name"]), (2, "fixed")], spoil=r["spoiled"]))
        else:
            stray = key % 16 == 7
            payload = bytes(184) if stray else S.section_payloads(S.pat(9, {7: 777}))[0]
            out.append((stream, at, S.packet(0, 0, payload, pusi=not stray, tei=key % 16 == 3, scrambling=2 if key % 16 in (11, 15) else 0)))
        return out

    return staged(encoded(rows, write), "tables")


@plain("table_health", f"""{_TABLES.strip()}
crc AS (SELECT stream_id, count(*) FILTER (WHERE spoiled AND (kind = 0 OR kind = 1 AND k > first)) AS crc_errors, count(*) FILTER (WHERE spoiled AND kind = 2) AS dvb_crc_errors FROM k JOIN begun USING (stream_id) GROUP BY stream_id)
SELECT stream_id, crc_errors, dvb_crc_errors, count(*) FILTER (WHERE gap > 13500000 AND pid = 0) AS pat_repetition_errors, count(*) FILTER (WHERE gap > 13500000 AND pid = 4096) AS pmt_repetition_errors, max(gap) AS max_table_interval FROM gaps JOIN crc USING (stream_id) GROUP BY ALL""")
def table_health(spark, d):
    """Checksum failures and repetition of tables on the reference clock."""
    p = health.unwrapped(table_packets(spark, d))
    log = staged(psi.table_log(p), "table-log")
    return health.stream_stats(p, psi.map_versions(log), log).select("stream_id", "crc_errors", "dvb_crc_errors", "pat_repetition_errors", "pmt_repetition_errors", "max_table_interval")


@plain("table_changes", f"{_TABLES.strip()} last AS (SELECT stream_id, packet_no, kind, lead(packet_no) OVER (PARTITION BY stream_id ORDER BY packet_no) AS to_packet, row_number() OVER (PARTITION BY stream_id ORDER BY packet_no) AS version_no FROM changes) SELECT stream_id, CAST(version_no AS INT) AS version_no, kind, packet_no AS from_packet, to_packet FROM last")
def table_changes(spark, d):
    """The versions of each stream's map: only real changes make one."""
    return psi.map_versions(staged(psi.table_log(table_packets(spark, d)), "table-log")).select("stream_id", "version_no", "kind", "from_packet", "to_packet")


@plain("table_events", f"""{_TABLES.strip()}
said AS (SELECT stream_id, 2 * k AS packet_no, 'table_repetition_error' AS event, pid, gap AS a FROM gaps WHERE gap > 13500000
  UNION ALL SELECT stream_id, 2 * k, 'programs_changed', 0, (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM pmts m WHERE m.stream_id = p.stream_id AND m.k < p.k) FROM pats p WHERE two IS DISTINCT FROM was
  UNION ALL SELECT stream_id, 2 * k, 'programs_changed', 4096, 1 FROM pmts WHERE c % 2 IS DISTINCT FROM was UNION ALL SELECT stream_id, 2 * k, 'service_information_changed', 17, 2 FROM sdts WHERE name IS DISTINCT FROM was)
SELECT stream_id, packet_no, event, CAST(pid AS INT) AS pid, CAST(a AS BIGINT) AS a FROM said""")
def table_events(spark, d):
    """What changing and late tables say as events."""
    p = health.unwrapped(table_packets(spark, d))
    log = staged(psi.table_log(p), "table-log")
    found = events.stream_events(p, log, psi.map_versions(log))
    return found.filter("event IN ('table_repetition_error', 'programs_changed', 'service_information_changed')").select("stream_id", "packet_no", "event", "pid", "a")


@plain("latest_programs", f"""{_TABLES.strip()} tail AS (SELECT 1)
SELECT p.stream_id, 1 AS program, 257 + m.audio AS pid, CASE WHEN m.audio = 1 THEN 'eng' ELSE 'fra' END AS language, two, s.name AS service FROM
 (SELECT stream_id, arg_max(two, k) AS two FROM pats GROUP BY 1) p JOIN (SELECT stream_id, CAST(arg_max(c % 2, k) AS INT) AS audio FROM pmts GROUP BY 1) m USING (stream_id) JOIN (SELECT stream_id, arg_max(name, k) AS name FROM sdts GROUP BY 1) s USING (stream_id)""")
def latest_programs(spark, d):
    """What each stream's map says in the end."""
    m = psi.latest_map(psi.table_log(table_packets(spark, d)))
    two = m.select("stream_id", (F.size("pmt_pids") == 2).alias("two"))
    named = psi.services(m).filter("service_id = 1").select("stream_id", F.col("name").alias("service"))
    audio = psi.tracks(m).filter("raw_type = 15").select("stream_id", "program", "pid", "language")
    return audio.join(two, "stream_id").join(named, "stream_id")


@plain("networks", """
SELECT r_name AS stream_id, CAST(r_regionkey AS INT) AS network_id, r_name AS name, CAST(n_nationkey AS INT) AS ts_id, CAST(n_nationkey * 10 + i AS INT) AS service_id, CAST(i AS INT) AS type
FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest([1, 2]) AS i)""")
def networks(spark, d):
    """Each region's nations as the transport streams of a network, two services each."""
    ship(spark)
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_nationkey")).alias("nations"))

    def write(r):
        own = S.descriptor(0x40, r["r_name"].encode())
        streams = b""
        for n in r["nations"]:
            listed = S.descriptor(0x41, b"".join((n * 10 + i).to_bytes(2, "big") + bytes([i]) for i in (1, 2)))
            streams += n.to_bytes(2, "big") + b"\0\1" + (0xF000 | len(listed)).to_bytes(2, "big") + listed
        body = (0xF000 | len(own)).to_bytes(2, "big") + own + (0xF000 | len(streams)).to_bytes(2, "big") + streams
        return framed(r["r_name"], 0, 16, S.section(0x40, r["r_regionkey"], body))

    m = psi.latest_map(psi.table_log(encoded(rows, write)))
    each = m.select("stream_id", "network.network_id", "network.name", F.explode("network.streams").alias("t")).select("stream_id", "network_id", "name", "t.ts_id", F.explode("t.services").alias("s"))
    return each.select("stream_id", "network_id", "name", "ts_id", "s.service_id", "s.type")


@plain("program_lookups", """
SELECT n_name AS stream_id, n_nationkey % 5 <> 4 AS is_known, CASE WHEN n_nationkey % 5 <> 4 THEN CAST(CASE WHEN n_nationkey % 3 = 0 THEN 300 ELSE 302 END AS INT) END AS french, CASE WHEN n_nationkey % 5 <> 4 THEN CAST(301 AS INT) END AS video,
  CASE WHEN n_nationkey % 5 <> 4 AND n_nationkey % 2 = 0 THEN 'CUEI' END AS registration, CASE WHEN n_nationkey % 5 <> 4 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'deu,FRA' ELSE 'deu' END END AS languages FROM nation""")
def program_lookups(spark, d):
    """Tracks by language and kind, registration, and whether a program association came at all."""
    ship(spark)

    def write(r):
        stream, n = r["n_name"], r["n_nationkey"]
        out = framed(stream, 4, 17, S.sdt(1, [(1, stream)]))
        if n % 5 == 4:
            return out
        spoken = b"deu\0FRA\0" if n % 3 == 0 else b"deu\0"
        tracks = [(0x0F, 300, S.descriptor(10, spoken)), (0x1B, 301), (0x81, 302, S.descriptor(10, b"fra\1"))]
        return framed(stream, 0, 0, S.pat(1, {n + 1: 4096})) + framed(stream, 1, 4096, S.pmt(n + 1, 301, tracks, S.descriptor(5, b"CUEI") if n % 2 == 0 else b"")) + out

    m = psi.latest_map(psi.table_log(encoded(table(spark, d, "nation").select("n_nationkey", "n_name"), write))).persist()
    french = psi.stream_with_language(m, "Fra").select("stream_id", F.col("pid").alias("french"))
    video = psi.first_video(m).select("stream_id", F.col("pid").alias("video"))
    spoken = psi.tracks(m).filter("pid = 300").select("stream_id", F.array_join("languages", ",").alias("languages"))
    own = m.select("stream_id", F.explode("programs").alias("p")).select("stream_id", "p.registration")
    out = psi.is_known(m)
    for more in (french, video, own, spoken):
        out = out.join(more, "stream_id", "left")
    return out


@plain("epg_merge", "SELECT n_nationkey AS service_id, CAST(i AS INT) AS position, n_nationkey * 10 + i AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * i AS start_ts, CAST(1800 AS INT) AS duration_s, n_name || ' ' || i AS name FROM nation CROSS JOIN (SELECT unnest([0, 1]) AS i)")
def epg_merge(spark, d):
    """Present and following events of each service, sent as two sections out of order, twice."""
    return psi.guide(psi.table_log(_guides(spark, d))).select("service_id", "position", "event_id", F.col("start").alias("start_ts"), "duration_s", "name")


@plain("guide_events", "SELECT n_name AS stream_id, CAST(i AS BIGINT) AS packet_no, CAST(n_nationkey AS BIGINT) AS service_id, CAST(CASE WHEN i = 0 THEN 1 ELSE 2 END AS BIGINT) AS events FROM nation CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)")
def guide_events(spark, d):
    """Every guide section says that the guide may have changed."""
    p = _guides(spark, d)
    log = psi.table_log(p)
    return events.stream_events(p, log, psi.map_versions(log)).filter("event = 'events_changed'").select("stream_id", "packet_no", F.col("a").alias("service_id"), F.col("b").alias("events"))


def _guides(spark, d):
    ship(spark)

    def write(r):
        out, key = [], r["n_nationkey"]
        for again in range(2):
            for i in (1, 0):
                title = f"{r['n_name']} {i}".encode() if again else b"old"
                d1 = S.descriptor(0x4D, b"eng" + bytes([len(title) + 1]) + b"\x15" + title + b"\0")
                body = bytes([0, 1, 0, 1, 0, 0x4E]) + (key * 10 + i).to_bytes(2, "big") + (60310).to_bytes(2, "big") + bytes([i, 0, 0, 0, 0x30, 0]) + (4 << 13 | len(d1)).to_bytes(2, "big") + d1
                out += framed(r["n_name"], len(out), 18, S.section(0x4E, key, body, number=i, last=1))
        return out

    return encoded(table(spark, d, "nation").select("n_nationkey", "n_name"), write)


@plain("dvb_charsets", r"""
SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_name || 'é' WHEN 1 THEN p_name || 'Ö' WHEN 2 THEN p_name || 'А' WHEN 3 THEN p_name || '€' WHEN 4 THEN p_name || 'é' WHEN 5 THEN repeat('�', length(p_name)) WHEN 6 THEN p_name || '¤' || chr(10) || 'ß' ELSE p_name || '�' END AS decoded FROM part""")
def dvb_charsets(spark, d):
    """Names in ISO 6937, 8859-15 and 8859-5, UTF-16 and UTF-8, in a reserved set, with a currency sign, and ending in a lone accent."""
    name = F.col("p_name").cast("binary")
    lit = lambda digits: F.unhex(F.lit(digits))
    kinds = [
        F.concat(name, lit("C265")), F.concat(lit("0B"), name, lit("D6")), F.concat(lit("100005"), name, lit("B0")), F.concat(lit("11"), F.encode("p_name", "UTF-16BE"), lit("20AC")), F.concat(lit("15"), name, lit("C3A9")),
        F.concat(lit("1F"), name), F.concat(name, lit("248AFB")), F.concat(name, lit("C8")),
    ]
    raw = F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.dvb_text_col(raw).alias("decoded"))


@plain("crc32_mpeg", """
WITH bits AS (SELECT b, list_reduce(list_prepend(b::BIGINT * 16777216, range(8)), lambda c, i: CASE WHEN c >= 2147483648 THEN xor((c * 2) % 4294967296, 79764919) ELSE c * 2 END) AS row FROM range(256) r(b)),
t AS (SELECT list(row ORDER BY b) AS rows FROM bits),
p AS (SELECT p_partkey AS id, list_transform(range(1, strlen(p_name) + 1), lambda i: ascii(p_name[i])::BIGINT) AS bytes FROM part)
SELECT id, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor((c * 256) % 4294967296, rows[xor(c // 16777216, b) + 1])) AS crc, true AS valid FROM p, t""")
def crc32_mpeg(spark, d):
    """The checksum of each name; behind its own data it leaves no remainder."""
    p = table(spark, d, "part").withColumn("raw", F.col("p_name").cast("binary"))
    p = p.withColumn("crc", text.crc32_mpeg_col(F.col("raw")))
    whole = F.concat("raw", F.unhex(F.lpad(F.hex("crc"), 8, "0")))
    return p.select(F.col("p_partkey").alias("id"), "crc", (text.crc32_mpeg_col(whole) == 0).alias("valid"))


_COMPAT = {0: ("60000000", "6"), 1: ("20000000", "4"), 2: ("80000001", "80000001")}


@plain("codec_strings_hevc", f"""
SELECT o_orderkey AS id, 'hev1.' || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END || (1 + o_orderkey % 5) || '.' || CASE o_custkey % 3 {' '.join(f"WHEN {k} THEN '{v[1]}'" for k, v in _COMPAT.items())} END
  || '.' || CASE WHEN o_orderkey % 8 >= 4 THEN 'H' ELSE 'L' END || (30 + o_orderkey % 150) || '.' || upper(lpad(to_hex(16 + o_custkey % 200), 2, '0')) || CASE WHEN o_orderkey % 7 = 0 THEN '.00.07' ELSE '' END AS codec FROM orders""")
def codec_strings_hevc(spark, d):
    """Names of HEVC parameter sets, from profile, compatibility flags, tier, level and constraint bytes."""
    general = F.expr("(o_orderkey % 4) * 64 + CASE WHEN o_orderkey % 8 >= 4 THEN 32 ELSE 0 END + 1 + o_orderkey % 5")
    flags = F.element_at(F.array(*(F.lit(v[0]) for v in _COMPAT.values())), (F.col("o_custkey") % 3 + 1).cast("int"))
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    more = F.when(F.col("o_orderkey") % 7 == 0, "0007000000").otherwise("0000000000")
    sps = F.unhex(F.concat(F.lit("420101"), byte(general), flags, byte(16 + F.col("o_custkey") % 200), more, byte(30 + F.col("o_orderkey") % 150)))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.hevc_codec_col(sps).alias("codec"))
