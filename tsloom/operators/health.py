"""Stream health: continuity, clocks, repetition, skew, errored seconds, damaged pictures.

All of it is windows and aggregates over header columns; payloads aren't read.
Packets of a PID are ordered once; what hangs on another PID's clock (errors,
tables, PES starts) is sparse and meets the sparse clock rows in an as-of merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsloom.functions.wire import NULL_PID, PAT_PID, PCR_HZ, WRAP33
from tsloom.session import staged

#: Packets of a stream that a window runs over.
CHUNK = 1 << 20
PCR_JUMP, PCR_LIMIT, PTS_LIMIT, TABLE_LIMIT = PCR_HZ // 10, PCR_HZ * 40 // 1000, PCR_HZ * 700 // 1000, PCR_HZ * 500 // 1000


class Scans:
    """Packets with their two scans, stored: for figures that need them several times.  Operators here take it for packets."""

    def __init__(self, packets: DataFrame):
        self.packets = packets
        self.marked, self.clock = staged(marked(packets), "marked"), staged(pcr_rows(packets), "clock")


def marked(packets: DataFrame | Scans) -> DataFrame:
    """Packets (null ones left out) with continuity, random-access and scrambling marks.

    The counter moves with the payload flag, not with payload bytes; a packet
    after a corrupt one only seeds the comparison.

    A prefix scan of two levels: windows run over CHUNK packets of a stream, and
    what a chunk's first packets must know of those before (last counter, last
    scrambling, random-access points so far) is carried over a table with a row
    for each PID and chunk.  A PID of any length is thus spread over many tasks.
    """
    if isinstance(packets, Scans):
        return packets.marked
    p = packets.filter(F.col("pid") != NULL_PID).select("stream_id", "packet_no", "tei", "pid", "scrambling_control", "afc", "cc", "discontinuity", "random_access", "pcr", "payload_len")
    p = p.withColumns(
        {
            "chunk": F.floor(F.col("packet_no") / F.lit(CHUNK)), "announced": F.coalesce("discontinuity", F.lit(False)), "rai": F.coalesce("random_access", F.lit(False)) & ~F.col("tei"), "scrambled": (F.col("scrambling_control") != 0) & ~F.col("tei"),
        }
    )
    sound = F.when(~F.col("tei"), F.col("scrambled"))
    keys = ["stream_id", "pid", "chunk"]
    ends = p.groupBy(*keys).agg(F.max_by(F.struct("cc", "tei"), "packet_no").alias("end"), F.max_by("scrambled", F.when(~F.col("tei"), F.col("packet_no"))).alias("end_scrambled"), F.sum(F.col("rai").cast("long")).alias("points"))
    chunks = W.partitionBy("stream_id", "pid").orderBy("chunk")
    earlier = chunks.rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, F.lag("end").over(chunks).alias("end"), F.last("end_scrambled", ignorenulls=True).over(earlier).alias("end_scrambled"), F.coalesce(F.sum("points").over(earlier), F.lit(0)).alias("points"))
    p = p.join(carried, keys)
    order = W.partitionBy(*keys).orderBy("packet_no")
    before = F.coalesce(F.lag(F.struct("cc", "tei")).over(order), F.col("end"))
    p = p.withColumns(
        {
            "before": before, "was_scrambled": F.coalesce(F.last(sound, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("end_scrambled"), F.lit(False)),
            "gop": F.col("points") + F.sum(F.col("rai").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    prev, flag = F.col("before.cc"), F.col("afc").bitwiseAND(1) == 1
    expected = F.when(flag, (prev + 1) % 16).otherwise(prev)
    compared = ~F.col("tei") & prev.isNotNull() & ~F.coalesce("before.tei", F.lit(False))
    off = compared & (F.col("cc") != expected) & ~F.col("announced")
    twice = flag & (F.col("cc") == prev)
    p = p.withColumns({"expected": expected, "duplicate": F.coalesce(off & twice, F.lit(False)), "cc_error": F.coalesce(off & ~twice, F.lit(False)), "lost": F.pmod(F.col("cc") - expected, F.lit(16))})
    return p.drop("before", "end", "end_scrambled", "points", "chunk", "discontinuity", "random_access", "scrambling_control")


def pcr_rows(packets: DataFrame | Scans) -> DataFrame:
    """Clock references with their interval, what it breaches, and the clock's count of seconds seen so far.

    Scanned in chunks like marked(): the last reference and the seconds before a
    chunk are carried over a table with a row for each PID and chunk.
    """
    if isinstance(packets, Scans):
        return packets.clock
    keys = ["stream_id", "pid", "chunk"]
    q = packets.filter((F.col("pid") != NULL_PID) & ~F.col("tei") & F.col("pcr").isNotNull())
    q = q.select("stream_id", "packet_no", "pid", "pcr", F.coalesce("discontinuity", F.lit(False)).alias("announced"), F.floor(F.col("packet_no") / F.lit(CHUNK)).alias("chunk"))
    inside, chunks = W.partitionBy(*keys).orderBy("packet_no"), W.partitionBy("stream_id", "pid").orderBy("chunk")
    ends = q.groupBy(*keys).agg(F.max_by("pcr", "packet_no").alias("end"))
    q = q.join(ends.select(*keys, F.lag("end").over(chunks).alias("carried")), keys)
    q = q.withColumn("prev_pcr", F.coalesce(F.lag("pcr").over(inside), F.col("carried"))).drop("carried")
    raw, second = F.col("pcr") - F.col("prev_pcr"), lambda c: F.floor(F.col(c) / F.lit(PCR_HZ))
    wrap = WRAP33 * 300
    q = q.withColumns({"second": second("pcr"), "delta": F.when(raw < -(wrap // 2), raw + wrap).otherwise(raw)})
    jump = ~F.col("announced") & ((F.col("delta") < 0) | (F.col("delta") > PCR_JUMP))
    q = q.withColumn("jump", F.coalesce(jump, F.lit(False)))
    steady = ~F.col("announced") & ~F.col("jump") & (F.col("delta") > 0)
    q = q.withColumns({"interval": F.when(steady, F.col("delta")), "late": F.coalesce(steady & (F.col("delta") > PCR_LIMIT), F.lit(False)), "turn": (F.col("prev_pcr").isNull() | (F.col("second") != second("prev_pcr"))).cast("long")})
    turns = q.groupBy(*keys).agg(F.sum("turn").alias("turns"))
    turns = turns.select(*keys, F.coalesce(F.sum("turns").over(chunks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    q = q.join(turns, keys)
    return q.withColumn("seconds", F.col("before") + F.sum("turn").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("before", "chunk")


def unwrapped(packets: DataFrame) -> DataFrame:
    """packets whose clock references count on where their 42 bits begin anew, so that times far apart can be compared.

    Of two references of a PID the step is the short way round, unless the later
    is announced as discontinuous.  The few packets where a clock turns are found
    in chunks like pcr_rows; all others meet them as spans of packet numbers.
    """
    keys, wrap = ["stream_id", "pid", "chunk"], WRAP33 * 300
    q = packets.filter((F.col("pid") != NULL_PID) & ~F.col("tei") & F.col("pcr").isNotNull())
    q = q.select("stream_id", "pid", "packet_no", "pcr", F.coalesce("discontinuity", F.lit(False)).alias("announced"), F.floor(F.col("packet_no") / F.lit(CHUNK)).alias("chunk"))
    ends = q.groupBy(*keys).agg(F.max_by("pcr", "packet_no").alias("end"))
    carried = ends.select(*keys, F.lag("end").over(W.partitionBy("stream_id", "pid").orderBy("chunk")).alias("carried"))
    step = F.col("pcr") - F.coalesce(F.lag("pcr").over(W.partitionBy(*keys).orderBy("packet_no")), F.col("carried"))
    turn = F.when(~F.col("announced") & (step < -(wrap // 2)), 1).when(~F.col("announced") & (step > wrap // 2), -1)
    own = W.partitionBy("t_stream", "t_pid").orderBy("from_packet")
    turns = q.join(carried, keys).withColumn("turn", turn).filter("turn IS NOT NULL").select(F.col("stream_id").alias("t_stream"), F.col("pid").alias("t_pid"), F.col("packet_no").alias("from_packet"), "turn")
    turns = turns.select("t_stream", "t_pid", "from_packet", F.lead("from_packet").over(own).alias("to_packet"), F.sum("turn").over(own.rowsBetween(W.unboundedPreceding, 0)).alias("turns"))
    inside = (F.col("stream_id") == F.col("t_stream")) & (F.col("pid") == F.col("t_pid")) & F.col("pcr").isNotNull() & (F.col("packet_no") >= F.col("from_packet")) & (F.col("to_packet").isNull() | (F.col("packet_no") < F.col("to_packet")))
    # A row for each 26.5 hours of a clock.
    return packets.join(F.broadcast(turns), inside, "left").withColumn("pcr", F.col("pcr") + F.coalesce("turns", F.lit(0)) * F.lit(wrap)).select(*packets.columns)


def bindings(maps: DataFrame) -> DataFrame:
    """Rows (stream_id, from_packet, to_packet, version_no, pid, clock_pid): each PID's program clock by map version; a later program wins."""
    p = maps.filter("programs IS NOT NULL").select("stream_id", "version_no", "from_packet", "to_packet", F.posexplode("programs").alias("pos", "p")).filter(F.col("p.pcr_pid") != NULL_PID)
    p = p.select("*", F.explode(F.array_distinct(F.concat(F.array("p.pcr_pid"), F.col("p.streams.pid")))).alias("pid"))
    return p.groupBy("stream_id", "version_no", "from_packet", "to_packet", "pid").agg(F.max_by("p.pcr_pid", "pos").alias("clock_pid"))


def reference_clock(clock: DataFrame, maps: DataFrame | None) -> DataFrame:
    """(stream_id, ref_pid): the PID of the first clock reference or the first that a map declares, whichever comes first."""
    seen = clock.groupBy("stream_id").agg(F.min(F.struct("packet_no", F.lit(0).alias("by_map"), "pid")).alias("f"))
    if maps is not None:
        own = maps.select("stream_id", "from_packet", "version_no", F.posexplode("programs").alias("pos", "p")).filter(F.col("p.pcr_pid") != NULL_PID)
        own = own.groupBy("stream_id").agg(F.min(F.struct("from_packet", "version_no", "pos", F.col("p.pcr_pid").alias("pid"))).alias("m"))
        seen = seen.unionByName(own.select("stream_id", F.struct(F.col("m.from_packet").alias("packet_no"), F.lit(1).alias("by_map"), "m.pid").alias("f")))
    return seen.groupBy("stream_id").agg(F.min("f").alias("f")).select("stream_id", F.col("f.pid").alias("ref_pid"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: Column, values: list[str], same: bool) -> DataFrame:
    """left with the values of the last right row of the key before packet `at`, or up to it where same.

    A merge: both sides are dealt by key and CHUNK packets and walked once in
    order; what a chunk must know of those before is carried over a table with a
    row for each.  right has the keys, packet_no and the values.
    """
    rank = 0 if same else 2
    held = F.struct(*values)
    a = left.select(*keys, at.alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    b = right.select(*keys, F.col("packet_no").alias("_at"), F.lit(rank).alias("_side"), held.alias("_held"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("_at") / F.lit(CHUNK)))
    order = W.partitionBy(*keys, "_chunk").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "_chunk").agg(F.max_by("_held", F.when(F.col("_held").isNotNull(), F.col("_at"))).alias("_end"))
    ends = ends.select(*[F.col(k).alias(f"_e_{k}") for k in (*keys, "_chunk")], F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried IS NOT NULL")
    found = both.withColumn("_found", F.last("_held", ignorenulls=True).over(order)).filter("_side = 1")
    here = F.lit(True)
    for k in (*keys, "_chunk"):
        here = here & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    found = found.join(ends, here, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select("_row.*", *[F.col("_found")[v].alias(v) for v in values])


def with_clock(rows: DataFrame, maps: DataFrame | None, reference: DataFrame, same_map: bool) -> DataFrame:
    """rows (stream_id, packet_no, pid) with clock_pid: their program's clock as of then, else the reference clock, with own_clock telling which."""
    rows = rows.join(reference, "stream_id", "left")
    if maps is None:
        return rows.withColumn("clock_pid", F.col("ref_pid"))
    b = bindings(maps).withColumnRenamed("pid", "b_pid").withColumnRenamed("stream_id", "b_stream")
    p = F.col("packet_no")
    inside = ((p >= F.col("from_packet")) & (F.col("to_packet").isNull() | (p < F.col("to_packet")))) if same_map else ((p > F.col("from_packet")) & (F.col("to_packet").isNull() | (p <= F.col("to_packet"))))
    joined = rows.join(b, (F.col("stream_id") == F.col("b_stream")) & (F.col("pid") == F.col("b_pid")) & inside, "left")
    return joined.withColumn("clock_pid", F.coalesce("clock_pid", "ref_pid")).drop("b_stream", "b_pid", "from_packet", "to_packet", "version_no")


def errors(packets: DataFrame, log: DataFrame | None = None, sync_losses: DataFrame | None = None) -> DataFrame:
    """Rows (stream_id, packet_no, pid, error, sees_own_pcr) of everything that makes a second errored."""
    m = marked(packets)
    rows = m.filter("tei OR cc_error").select("stream_id", "packet_no", "pid", F.when(F.col("tei"), "transport").otherwise("continuity").alias("error"), F.lit(False).alias("own_pcr"))
    jumps = pcr_rows(packets).filter("jump").select("stream_id", "packet_no", "pid", F.lit("pcr_jump").alias("error"), F.lit(False).alias("own_pcr"))
    rows = rows.unionByName(jumps)
    if log is not None:
        rows = rows.unionByName(log.filter("kind = 'psi_crc_error'").select("stream_id", "packet_no", "pid", F.lit("crc").alias("error"), F.lit(True).alias("own_pcr")))
    if sync_losses is not None:
        rows = rows.unionByName(sync_losses.select("stream_id", F.col("before_packet_no").alias("packet_no"), F.lit(None).cast("int").alias("pid"), F.lit("sync").alias("error"), F.lit(False).alias("own_pcr")))
    return rows


def errored_seconds(packets: DataFrame, maps: DataFrame | None = None, log: DataFrame | None = None, sync_losses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per PID, per stream) errored seconds: a PID's on its program's clock, a stream's on the reference clock."""
    clock = pcr_rows(packets)
    reference = reference_clock(clock, maps)
    ticks = clock.select("stream_id", F.col("pid").alias("clock_pid"), "packet_no", "seconds")
    rows = with_clock(errors(packets, log, sync_losses), maps, reference, same_map=False)
    # A CRC error is noticed after the packet's own clock reference, the others before it.
    at = F.col("packet_no") + F.col("own_pcr").cast("long")
    keys = ["stream_id", "clock_pid"]
    own = as_of(rows.filter("pid IS NOT NULL"), ticks, keys, at, ["seconds"], same=False)
    order = W.partitionBy("stream_id", "pid").orderBy("packet_no", F.col("own_pcr").cast("int"), "error")
    own = own.filter("seconds > 0").withColumn("new", ~F.col("seconds").eqNullSafe(F.lag("seconds").over(order)))
    per_pid = own.groupBy("stream_id", "pid").agg(F.count_if("new").alias("errored_seconds"))
    whole = as_of(rows.drop("clock_pid").withColumn("clock_pid", F.col("ref_pid")), ticks, keys, at, ["seconds"], same=False)
    order = W.partitionBy("stream_id").orderBy("packet_no", F.col("own_pcr").cast("int"), "error")
    whole = whole.filter("seconds > 0").withColumn("new", ~F.col("seconds").eqNullSafe(F.lag("seconds").over(order)))
    return per_pid, whole.groupBy("stream_id").agg(F.count_if("new").alias("errored_seconds"))


def repetition(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """rows (keys, packet_no, ordinal, clock) with interval (positive ones) and breach: first seen seeds, no folding of wraps."""
    order = W.partitionBy(*keys).orderBy("packet_no", "ordinal")
    gap = F.col("clock") - F.lag("clock").over(order)
    return rows.withColumn("interval", F.when(gap > 0, gap)).withColumn("breach", F.coalesce(F.col("interval") > limit, F.lit(False)))


def table_repetition(packets: DataFrame, log: DataFrame, maps: DataFrame) -> DataFrame:
    """Current sections on table PIDs with the reference clock up to them."""
    clock = pcr_rows(packets)
    rows = log.filter(F.col("kind").eqNullSafe("section") & F.col("section.is_current") & ~F.col("pid").isin(16, 17, 18)).select("stream_id", "packet_no", "ordinal", "pid")
    rows = rows.join(reference_clock(clock, maps).withColumnRenamed("ref_pid", "clock_pid"), "stream_id")
    ticks = clock.select("stream_id", F.col("pid").alias("clock_pid"), "packet_no", F.col("pcr").alias("clock"))
    timed = as_of(rows, ticks, ["stream_id", "clock_pid"], F.col("packet_no"), ["clock"], same=True)
    return repetition(timed.filter("clock IS NOT NULL"), ["stream_id", "pid"], TABLE_LIMIT)


def pes_timing(pes: DataFrame, packets: DataFrame, maps: DataFrame | None) -> DataFrame:
    """PES starts with a PTS on their program's clock: repetition and skew (in 90 kHz ticks, folded to half the range)."""
    clock = pcr_rows(packets)
    rows = pes.filter("pts IS NOT NULL").withColumn("ordinal", F.lit(0))
    rows = with_clock(rows, maps, reference_clock(clock, maps), same_map=True)
    ticks = clock.select("stream_id", F.col("pid").alias("clock_pid"), "packet_no", F.col("pcr").alias("clock"))
    timed = as_of(rows, ticks, ["stream_id", "clock_pid"], F.col("packet_no"), ["clock"], same=True).filter("clock IS NOT NULL")
    timed = repetition(timed, ["stream_id", "pid"], PTS_LIMIT)
    return timed.withColumn("skew", folded(F.col("pts") - F.floor(F.col("clock") / F.lit(300)))).withColumn("is_late", F.col("skew") <= 0)


def folded(ticks: Column) -> Column:
    """A difference of 33-bit times, the short way round."""
    return F.when(ticks < -(WRAP33 // 2), ticks + WRAP33).when(ticks > WRAP33 // 2, ticks - WRAP33).otherwise(ticks)


def damaged_gops(m: DataFrame) -> DataFrame:
    """Intervals between random-access points that an error hit; an error on the point itself belongs to the one before."""
    before = F.col("gop") - F.col("rai").cast("long")
    return m.filter("tei OR cc_error").withColumn("before", before).filter("before > 0").groupBy("stream_id", "pid").agg(F.count_distinct("before").alias("damaged_gops"))


def packet_counts(packets: DataFrame) -> DataFrame:
    """Packets, payload bytes and first packet of each PID: one aggregate, nothing is ordered."""
    found = packets.filter(F.col("pid") != NULL_PID).groupBy("stream_id", "pid")
    return found.agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").cast("long").alias("payload_bytes"), F.min("packet_no").alias("first_packet"))


def pid_counters(packets: DataFrame) -> DataFrame:
    """Counters of each PID that need no tables: per interval between random-access points first, then per PID."""
    m = marked(packets)
    live = F.when(~F.col("tei"), F.col("packet_no"))
    g = m.groupBy("stream_id", "pid", "gop").agg(
        F.min("packet_no").alias("first_packet"), F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("payload_bytes"), F.count_if("cc_error").alias("continuity_errors"),
        F.coalesce(F.sum(F.when(F.col("cc_error"), F.col("lost"))), F.lit(0)).cast("long").alias("packets_lost"), F.count_if("tei").alias("transport_errors"), F.count_if("duplicate").alias("duplicates"),
        F.max(F.struct(live.alias("at"), "scrambled")).alias("last"), F.count_if("rai").alias("random_access_points"), F.count_if(~F.col("tei")).alias("sound"),
    )
    sums = ["packets", "payload_bytes", "continuity_errors", "packets_lost", "transport_errors", "duplicates", "random_access_points"]
    out = g.groupBy("stream_id", "pid").agg(
        F.min("first_packet").alias("first_packet"), *[F.sum(c).cast("long").alias(c) for c in sums], F.max("last").alias("last"), F.when(F.max("gop") > 0, F.max_by("sound", "gop") - 1).alias("packets_since_random_access"),
    )
    out = out.withColumn("scrambled", F.when(F.col("last.at").isNotNull(), F.col("last.scrambled")).otherwise(False)).drop("last")
    return out.join(damaged_gops(m), ["stream_id", "pid"], "left").fillna(0, ["damaged_gops"])


def clock_counters(packets: DataFrame) -> DataFrame:
    q = pcr_rows(packets)
    return q.groupBy("stream_id", "pid").agg(
        F.count(F.lit(1)).alias("pcr_count"), F.max_by("pcr", "packet_no").alias("last_pcr"), F.count_if("jump").alias("pcr_discontinuities"), F.count_if("late").alias("pcr_repetition_errors"),
        F.coalesce(F.max("interval"), F.lit(0)).alias("max_pcr_interval"), F.max("seconds").alias("observed_seconds"),
    )


def pid_stats(packets: DataFrame, maps: DataFrame | None = None, log: DataFrame | None = None, pes: DataFrame | None = None, sync_losses: DataFrame | None = None) -> DataFrame:
    """All figures of each PID; absent values are null."""
    packets = packets if isinstance(packets, Scans) else Scans(packets)
    keys = ["stream_id", "pid"]
    out = pid_counters(packets).join(clock_counters(packets).drop("observed_seconds"), keys, "left").join(errored_seconds(packets, maps, log, sync_losses)[0], keys, "left")
    zero = ["pcr_count", "pcr_discontinuities", "pcr_repetition_errors", "max_pcr_interval", "errored_seconds"]
    if pes is not None:
        heads = pes.groupBy(*keys).agg(F.count(F.lit(1)).alias("pes_packets"), F.max_by("pes_stream_id", "packet_no").alias("pes_stream_id"), F.max_by("pts", F.when(F.col("pts").isNotNull(), F.col("packet_no"))).alias("last_pts"), F.max_by("dts", F.when(F.col("dts").isNotNull(), F.col("packet_no"))).alias("last_dts"))
        t = pes_timing(pes, packets, maps)
        times = t.groupBy(*keys).agg(F.count_if("breach").alias("pts_repetition_errors"), F.coalesce(F.max("interval"), F.lit(0)).alias("max_pts_interval"), F.max_by("skew", "packet_no").alias("pts_skew"), F.min("skew").alias("min_pts_skew"), F.count_if("is_late").alias("late_timestamps"))
        out = out.join(heads, keys, "left").join(times, keys, "left")
        zero += ["pes_packets", "pts_repetition_errors", "max_pts_interval", "late_timestamps"]
    return out.fillna(0, zero)


def stream_stats(packets: DataFrame | Scans, maps: DataFrame | None = None, log: DataFrame | None = None, pes: DataFrame | None = None, sync_losses: DataFrame | None = None) -> DataFrame:
    """All figures of each stream; payload bytes count null packets' too."""
    scans = packets if isinstance(packets, Scans) else Scans(packets)
    totals = scans.packets.groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("payload_bytes"), F.count_if(F.col("pid") == NULL_PID).alias("null_packets"))
    pids = pid_stats(scans, maps, log, pes, sync_losses)
    sums = ["continuity_errors", "packets_lost", "transport_errors", "duplicates", "pcr_discontinuities", "pcr_repetition_errors", *(["pes_packets", "pts_repetition_errors", "late_timestamps"] if pes is not None else [])]
    out = totals.join(pids.groupBy("stream_id").agg(*[F.sum(c).alias(c) for c in sums]), "stream_id", "left").fillna(0, sums)
    out = out.join(errored_seconds(scans, maps, log, sync_losses)[1], "stream_id", "left")
    ref = reference_clock(pcr_rows(scans), maps).withColumnRenamed("ref_pid", "pid")
    seen = clock_counters(scans).select("stream_id", "pid", "observed_seconds").join(ref, ["stream_id", "pid"], "left_semi").select("stream_id", "observed_seconds")
    out, zero = out.join(seen, "stream_id", "left"), ["errored_seconds", "observed_seconds", "sync_losses", "crc_errors", "dvb_crc_errors"]
    if sync_losses is not None:
        out = out.join(sync_losses.groupBy("stream_id").agg(F.count(F.lit(1)).alias("sync_losses")), "stream_id", "left")
    else:
        out = out.withColumn("sync_losses", F.lit(0).cast("long"))
    if log is not None:
        ends = log.filter("kind IN ('psi_end', 'dvb_end')").groupBy("stream_id").agg(F.sum(F.when(F.col("kind") == "psi_end", F.col("crc_errors"))).alias("crc_errors"), F.sum(F.when(F.col("kind") == "dvb_end", F.col("crc_errors"))).alias("dvb_crc_errors"))
        t = table_repetition(scans, log, maps)
        gaps = t.groupBy("stream_id").agg(F.count_if(F.col("breach") & (F.col("pid") == PAT_PID)).alias("pat_repetition_errors"), F.count_if(F.col("breach") & (F.col("pid") != PAT_PID)).alias("pmt_repetition_errors"), F.coalesce(F.max("interval"), F.lit(0)).alias("max_table_interval"))
        out, zero = out.join(ends, "stream_id", "left").join(gaps, "stream_id", "left"), [*zero, "pat_repetition_errors", "pmt_repetition_errors", "max_table_interval"]
    else:
        out = out.withColumns({"crc_errors": F.lit(0).cast("long"), "dvb_crc_errors": F.lit(0).cast("long")})
    return derived_stream(out.fillna(0, zero))


# How a packet's text names what it carries, by adaptation field control.
CARRIES = ("RESERVED", "PAYLOAD_ONLY", "ADAPTATION_ONLY", "ADAPTATION_AND_PAYLOAD")


def packet_text() -> Column:
    """One line for a packet; its form is fixed."""
    carries = F.element_at(F.array(*map(F.lit, CARRIES)), F.col("afc") + 1)
    scrambled = F.when(F.col("scrambling_control") != 0, ", scrambled").otherwise("")
    return F.concat(F.lit("TsPacket[pid=0x"), F.lower(F.hex("pid")), F.lit(", cc="), F.col("cc"), F.lit(", "), carries, F.lit(", payload="), F.col("payload_len"), F.lit(" bytes"), scrambled, F.lit("]"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def derived_stream(s: DataFrame) -> DataFrame:
    healthy = (F.col("continuity_errors") == 0) & (F.col("transport_errors") == 0) & (F.col("sync_losses") == 0) & (F.col("crc_errors") == 0) & (F.col("pcr_discontinuities") == 0)
    sent = F.col("packets") + F.col("packets_lost")
    return s.withColumns({"is_healthy": healthy, "loss_rate": ratio(F.col("packets_lost"), sent), "errored_second_rate": ratio(F.col("errored_seconds"), F.col("observed_seconds"))})


def derived_pid(s: DataFrame) -> DataFrame:
    """Rates and units of pid_stats."""
    points = F.col("random_access_points")
    return s.withColumns(
        {
            "loss_rate": ratio(F.col("packets_lost"), F.col("packets") + F.col("packets_lost")), "carries_pcr": F.col("pcr_count") > 0, "last_pcr_seconds": F.col("last_pcr") / PCR_HZ, "max_pcr_interval_ms": F.col("max_pcr_interval") / (PCR_HZ / 1000),
            "damaged_gop_rate": ratio(F.col("damaged_gops"), points), "gop_length_packets": ratio(F.col("packets"), points),
        }
    )
