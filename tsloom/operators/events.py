"""The stream's events in order, from windows over packets and the table log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsloom.operators.health import Scans, marked, pcr_rows, pes_timing, table_repetition

#: Place of each event within its packet.
ORDER = ["sync_lost", "pid_discovered", "scrambling_changed", "continuity_error", "pcr_discontinuity", "pcr_repetition_error", "table_repetition_error", "programs_changed", "service_information_changed", "events_changed", "pts_repetition_error", "late_timestamp"]


def _rows(df: DataFrame, event: str, a=None, b=None, c=None) -> DataFrame:
    number = lambda x: F.lit(None).cast("long") if x is None else x.cast("long")
    return df.select("stream_id", "packet_no", F.lit(ORDER.index(event)).alias("ordinal"), F.lit(event).alias("event"), "pid", number(a).alias("a"), number(b).alias("b"), number(c).alias("c"))


def stream_events(packets: DataFrame | Scans, log: DataFrame | None = None, maps: DataFrame | None = None, pes: DataFrame | None = None, sync_losses: DataFrame | None = None) -> DataFrame:
    packets = packets if isinstance(packets, Scans) else Scans(packets)
    m, q = marked(packets), pcr_rows(packets)
    first = m.groupBy("stream_id", "pid").agg(F.min("packet_no").alias("packet_no"))
    parts = [
        _rows(first, "pid_discovered"), _rows(m.filter("NOT tei AND scrambled <> was_scrambled"), "scrambling_changed", F.col("scrambled").cast("int")), _rows(m.filter("cc_error"), "continuity_error", F.col("expected"), F.col("cc"), F.col("lost")),
        _rows(q.filter("jump"), "pcr_discontinuity", F.col("prev_pcr"), F.col("pcr")), _rows(q.filter("late"), "pcr_repetition_error", F.col("interval")),
    ]
    if sync_losses is not None:
        parts.append(_rows(sync_losses.select("stream_id", F.col("before_packet_no").alias("packet_no"), F.lit(None).cast("int").alias("pid"), "bytes_discarded"), "sync_lost", F.col("bytes_discarded")))
    if log is not None:
        parts += [
            _rows(table_repetition(packets, log, maps).filter("breach"), "table_repetition_error", F.col("interval")), _rows(log.filter("kind = 'programs'"), "programs_changed", F.size("map.programs")),
            _rows(log.filter("kind = 'services'"), "service_information_changed", F.size("map.services")), _rows(log.filter("kind = 'guide'"), "events_changed", F.col("guide.service_id"), F.size("guide.events")),
        ]
    if pes is not None:
        t = pes_timing(pes, packets, maps)
        parts += [_rows(t.filter("breach"), "pts_repetition_error", F.col("interval")), _rows(t.filter("is_late"), "late_timestamp", F.col("skew"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
