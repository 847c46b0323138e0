"""Repackaging of H.264 and AAC access units as fragmented MP4."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsloom.functions.mp4 import AacTimeline, AvcSettings, Sample, adts, fragment, init_segment
from tsloom.operators.ordered import ordered_fold
from tsloom.operators.psi import latest_map, tracks
from tsloom.operators.units import access_units
from tsloom.session import staged

H264, ADTS_AAC = 0x1B, 0x0F
_END = 1 << 62


def chosen_tracks(log: DataFrame) -> DataFrame:
    """(stream_id, video_pid, audio_pid): the first program with H.264, and its first ADTS AAC track or null."""
    t = tracks(latest_map(log).select("stream_id", "programs"))
    pick = lambda raw: F.min_by("pid", F.when(F.col("raw_type") == raw, F.col("track_pos")))
    p = t.groupBy("stream_id", "program_pos").agg(pick(H264).alias("video_pid"), pick(ADTS_AAC).alias("audio_pid"), F.count_if(F.col("raw_type") == H264).alias("v"), F.count_if(F.col("raw_type") == ADTS_AAC).alias("a"))
    p = p.filter("v > 0").withColumn("audio_pid", F.when(F.col("a") > 0, F.col("audio_pid")))
    return p.groupBy("stream_id").agg(F.min_by(F.struct("video_pid", "audio_pid"), "program_pos").alias("t")).select("stream_id", "t.*")


def closed(units: DataFrame) -> DataFrame:
    """units with closed_by: the packet that begins the next one, or a last place."""
    return units.withColumn("closed_by", F.coalesce(F.lead("first_packet").over(W.partitionBy("stream_id", "pid").orderBy("unit_no")), F.lit(_END)))


def _scan(codec):
    def scan(units: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in units:
            yield pd.DataFrame([{"sps": codec.sets(d)[0], "pps": codec.sets(d)[1], "sample": codec.sample(d), "is_key": codec.is_key(d)} for d in s], columns=["sps", "pps", "sample", "is_key"])

    return scan


def video_samples(units: DataFrame, codec=AvcSettings) -> DataFrame:
    """Samples of complete units from the first with both parameter sets known, with the fragment each belongs to."""
    u = closed(units).filter("status = 'ok'").withColumn("n", F.pandas_udf(_scan(codec), "sps array<binary>, pps array<binary>, sample binary, is_key boolean")("data")).drop("data")
    so_far = W.partitionBy("stream_id", "pid").orderBy("unit_no").rowsBetween(W.unboundedPreceding, 0)
    known = F.bool_or(F.size("n.sps") > 0).over(so_far) & F.bool_or(F.size("n.pps") > 0).over(so_far)
    u = u.withColumn("known", known).filter("known")
    # The first fragment may begin before any random-access picture.
    return u.withColumn("fragment_no", F.sum(F.col("n.is_key").cast("long")).over(so_far)).select("stream_id", "pid", "unit_no", "fragment_no", "closed_by", F.coalesce("decode_timestamp", F.lit(-1)).alias("decode"), F.coalesce("pts", "decode_timestamp", F.lit(-1)).alias("present"), F.col("n.is_key").alias("is_key"), F.col("n.sample").alias("sample"))


def dropped_before_settings(units: DataFrame, codec=AvcSettings) -> DataFrame:
    ok = units.filter("status = 'ok'").groupBy("stream_id", "pid").agg(F.count(F.lit(1)).alias("all"))
    return ok.join(video_samples(units, codec).groupBy("stream_id", "pid").agg(F.count(F.lit(1)).alias("kept")), ["stream_id", "pid"], "left").select("stream_id", "pid", (F.col("all") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def _fragments(track: int):
    def build(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for numbers, samples in batches:
            yield pd.Series([fragment(track, int(n), [Sample(x["sample"], x["decode"], x["present"], x["is_key"]) for x in s]) for n, s in zip(numbers, samples, strict=True)], dtype=object)

    return build


def video_fragments(units: DataFrame, track: int = 1, codec=AvcSettings) -> DataFrame:
    """(stream_id, pid, fragment_no, sequence, samples, emitted_by, phase, data): closed by the next random-access picture."""
    s = video_samples(units, codec)
    g = s.groupBy("stream_id", "pid", "fragment_no").agg(F.sort_array(F.collect_list(F.struct("unit_no", "decode", "present", "is_key", "sample"))).alias("samples"), F.min_by("closed_by", "unit_no").alias("opened"))
    order = W.partitionBy("stream_id", "pid").orderBy("fragment_no")
    g = g.withColumns({"sequence": F.row_number().over(order), "emitted_by": F.coalesce(F.lead("opened").over(order), F.lit(_END)), "is_last": F.lead("opened").over(order).isNull()})
    return g.select("stream_id", "pid", "fragment_no", "sequence", F.size("samples").alias("samples"), "emitted_by", F.when(F.col("is_last"), 2).otherwise(0).alias("phase"), F.pandas_udf(_fragments(track), "binary")("sequence", "samples").alias("data"))


class _AudioFold:
    def __init__(self, key: tuple, track: int):
        self.key, self.line = {"stream_id": key[0], "pid": key[1]}, AacTimeline(track)

    def step(self, row: dict) -> list[dict]:
        if row["status"] in ("loss", "size"):
            self.line.discontinuity()
        if row["status"] != "ok" or (data := self.line.add(row["data"], row["pts"])) is None:
            return []
        return [self.key | {"sequence": self.line.sequence, "emitted_by": row["closed_by"], "phase": 1, "data": data}]

    def end(self) -> list[dict]:
        self.line.finish()
        return []


def audio_fragments(units: DataFrame, track: int = 2) -> DataFrame:
    """A fragment for each unit that completes frames; ValueError where the timeline breaks."""
    rows = closed(units).select("stream_id", "pid", "unit_no", "status", "pts", "closed_by", "data")
    return ordered_fold(rows, ["stream_id", "pid"], "unit_no", lambda key: _AudioFold(key, track), "stream_id string, pid int, sequence int, emitted_by long, phase int, data binary")


def _inits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for sequence, picture, frame in batches:
        out = [init_segment(([bytes(x) for x in a], [bytes(x) for x in b]), adts(f) if f is not None else None) for a, b, f in zip(sequence, picture, frame, strict=True)]
        yield pd.Series(out, dtype=object)


def init_segments(video: DataFrame, audio: DataFrame | None, codec=AvcSettings) -> DataFrame:
    """(stream_id, data): the parameter sets in order of appearance, each once, are all that travels of the video."""
    found = F.pandas_udf(lambda s: pd.DataFrame([dict(zip(("sps", "pps"), codec.sets(d), strict=True)) for d in s], columns=["sps", "pps"]), "sps array<binary>, pps array<binary>")("data")
    v = video.filter("status = 'ok'").select("stream_id", "unit_no", found.alias("n"))
    each = [v.select("stream_id", "unit_no", F.lit(kind).alias("kind"), F.posexplode(f"n.{kind}").alias("place", "set")) for kind in ("sps", "pps")]
    once = each[0].unionByName(each[1]).groupBy("stream_id", "kind", "set").agg(F.min(F.struct("unit_no", "place")).alias("first"))
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("first", "set")))), lambda x: x["set"]).alias(kind) for kind in ("sps", "pps")]
    v = once.groupBy("stream_id").agg(*lists).filter("size(sps) > 0 AND size(pps) > 0")
    if audio is None:
        v = v.withColumn("frame", F.lit(None).cast("binary"))
    else:
        v = v.join(audio.filter("status = 'ok'").groupBy("stream_id").agg(F.min_by(F.substring("data", 1, 16), "unit_no").alias("frame")), "stream_id", "left")
    return v.select("stream_id", F.pandas_udf(_inits, "binary")("sps", "pps", "frame").alias("data"))


def remux(packets: DataFrame, log: DataFrame) -> DataFrame:
    """Segments (stream_id, position, data) of each stream's file: the init segment, then fragments as they were finished, numbered through."""
    t = chosen_tracks(log)
    video = access_units(packets.join(t.select("stream_id", F.col("video_pid").alias("pid")), ["stream_id", "pid"], "left_semi"))
    audio = access_units(packets.join(t.select("stream_id", F.col("audio_pid").alias("pid")), ["stream_id", "pid"], "left_semi"))
    # Assembled once: the init segment and the fragments both read it.
    video = staged(video, "video-units")
    columns = ["stream_id", "emitted_by", "phase", "sequence", "data"]
    media = staged(video_fragments(video).select(*columns).unionByName(audio_fragments(audio).select(*columns)), "fragments")
    # Fragments are numbered without their bytes.
    order = W.partitionBy("stream_id").orderBy("emitted_by", "phase", "sequence")
    numbered = media.drop("data").withColumn("position", F.row_number().over(order))
    number = F.unhex(F.lpad(F.hex(F.col("position").cast("long")), 8, "0"))
    media = media.join(numbered, columns[:-1]).select("stream_id", "position", F.concat(F.substring("data", 1, 20), number, F.expr("substring(data, 25)")).alias("data"))
    return init_segments(video, audio).select("stream_id", F.lit(0).alias("position"), "data").unionByName(media)


def write_mp4(segments: DataFrame, stream_id: str, path: str) -> int:
    """Writes one stream's segments to a local file, segment by segment; returns its size."""
    size = 0
    with open(path, "wb") as file:
        for row in segments.filter(F.col("stream_id") == stream_id).orderBy("position").select("data").toLocalIterator():
            size += file.write(row["data"])
    return size
