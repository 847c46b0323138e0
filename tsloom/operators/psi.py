"""Program tables: sections, map versions, services and programme events of each stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsloom.functions import dims, tables
from tsloom.functions.wire import EIT_PID, NIT_PID, NULL_PID, PAT_PID, SDT_PID
from tsloom.operators import health
from tsloom.operators.ordered import ordered_fold, parsed

_DESCRIPTORS = "array<struct<tag:int,payload:binary>>"
MAP = (
    "struct<ts_id:int,network_pid:int,pmt_pids:array<struct<program:int,pid:int>>,"
    f"programs:array<struct<program:int,pcr_pid:int,registration:string,descriptors:{_DESCRIPTORS},streams:array<struct<pid:int,raw_type:int,languages:array<string>,descriptors:{_DESCRIPTORS}>>>>,"
    f"services:array<struct<service_id:int,running_status:int,scrambled:boolean,eit_schedule:boolean,eit_present_following:boolean,type:int,provider:string,name:string,descriptors:{_DESCRIPTORS}>>,"
    "network:struct<network_id:int,name:string,streams:array<struct<ts_id:int,original_network_id:int,services:array<struct<service_id:int,type:int>>>>>>"
)
GUIDE = "struct<service_id:int,ts_id:int,original_network_id:int,events:array<struct<event_id:int,start:timestamp_ntz,duration_s:int,running_status:int,scrambled:boolean,language:string,name:string,text:string>>>"
LOG = f"stream_id string, packet_no long, ordinal int, kind string, pid int, section struct<table_id:int,ext:int,version:int,section_no:int,last_section_no:int,is_current:boolean,is_long:boolean,body:binary>, map {MAP}, guide {GUIDE}, crc_errors long"


class TableFold:
    """State of a stream's tables.  Its log tells, per packet: crc_error, section, programs, services, guide; and end."""

    def __init__(self, key: tuple):
        self.stream_id = key[0]
        self.psi: dict[int, tables.Sections] = {}
        self.dvb: dict[int, tables.Sections] = {}
        self.ts_id = self.network_pid = None
        self.pmt_pids: dict[int, int] = {}
        self.programs: dict[int, dict] = {}
        self.services: dict[int, dict] = {}
        self.network: dict | None = None
        self.guides: dict[int, dict[int, dict]] = {}

    def snapshot(self) -> dict:
        return {"ts_id": self.ts_id, "network_pid": self.network_pid, "pmt_pids": [{"program": k, "pid": v} for k, v in self.pmt_pids.items()], "programs": list(self.programs.values()), "services": list(self.services.values()), "network": self.network}

    def guide(self, service: int) -> dict:
        """The service's sections in order of their numbers, as one."""
        parts = [e for _, e in sorted(self.guides[service].items())]
        return parts[0] | {"events": [x for e in parts for x in e["events"]]}

    def step(self, row: dict) -> list[dict]:
        pid, out = row["pid"], []
        number = {"stream_id": self.stream_id, "packet_no": row["packet_no"], "pid": pid}

        def log(kind: str, **more) -> None:
            out.append({"ordinal": len(out), "kind": kind, **number, **more})

        payload = row["payload"] or b""
        unusable = bool(row["tei"]) or row["scrambling_control"] != 0
        if pid in self.psi or pid == PAT_PID or pid in self.pmt_pids.values():
            sections = self.psi.setdefault(pid, tables.Sections())
            before = sections.crc_errors
            found = sections.feed(payload, row["pusi"], unusable)
            if sections.crc_errors > before:
                log("psi_crc_error", crc_errors=sections.crc_errors - before)
            for s in found:
                log("section", section=s)
                if s["is_current"] and self._program_table(pid, s):
                    log("programs", map=self.snapshot())
        if pid in (NIT_PID, SDT_PID, EIT_PID):
            sections = self.dvb.setdefault(pid, tables.Sections())
            before = sections.crc_errors
            found = sections.feed(payload, row["pusi"], unusable)
            if sections.crc_errors > before:
                log("dvb_crc_error", crc_errors=sections.crc_errors - before)
            for s in found:
                log("section", section=s)
                if s["is_current"]:
                    self._service_table(s, log)
        return out

    def _program_table(self, pid: int, s: dict) -> bool:
        """Whether the section changed the programs."""
        if pid == PAT_PID and s["table_id"] == tables.PAT:
            if (t := tables.pat(s)) is None:
                return False
            before = (self.ts_id, list(self.pmt_pids.items()), self.programs)
            self.ts_id, self.network_pid = t["ts_id"], t["network_pid"]
            self.pmt_pids = {x["program"]: x["pid"] for x in t["programs"]}
            self.programs = {k: self.programs[k] for k in self.pmt_pids if k in self.programs}
            for gone in [p for p in self.psi if p != PAT_PID and p not in self.pmt_pids.values()]:
                del self.psi[gone]
            # Maps are equal whatever their order.
            return (before[0], dict(before[1]), before[2]) != (self.ts_id, self.pmt_pids, self.programs)
        if s["table_id"] == tables.PMT and (t := tables.pmt(s)) is not None:
            changed = self.programs.get(t["program"]) != t
            self.programs = self.programs | {t["program"]: t}
            return changed
        return False

    def _service_table(self, s: dict, log) -> None:
        if s["table_id"] == tables.SDT and (t := tables.sdt(s)) is not None:
            new = {x["service_id"]: x for x in t["services"]}
            if new != self.services:
                self.services = new
                log("services", map=self.snapshot())
            self.services = new
        elif s["table_id"] == tables.NIT and (t := tables.nit(s)) is not None:
            changed, self.network = t != self.network, t
            if changed:
                log("services", map=self.snapshot())
        elif s["table_id"] == tables.EIT and (t := tables.eit(s)) is not None:
            self.guides.setdefault(t["service_id"], {})[t["section_no"]] = t
            log("guide", guide=self.guide(t["service_id"]))

    def end(self) -> list[dict]:
        """The live assemblers' failures: a delisted table takes its count along."""
        last = {"stream_id": self.stream_id, "packet_no": None, "ordinal": 0}
        live = [("psi_end", self.psi), ("dvb_end", self.dvb)]
        return [last | {"kind": kind, "crc_errors": sum(s.crc_errors for s in group.values())} for kind, group in live]


_IN = ["stream_id", "packet_no", "pid", "tei", "scrambling_control", "pusi", "payload"]


def table_log(packets: DataFrame) -> DataFrame:
    """What the tables of each stream say, packet by packet (schema LOG).

    Only table PIDs go through the fold: first the PAT's own, to learn which PMT
    PIDs it ever names, then all of them together.
    """
    sound = packets.filter(~F.col("tei") & (F.col("pid") != NULL_PID)).select(*_IN)
    pats = ordered_fold(sound.filter(F.col("pid") == PAT_PID), ["stream_id"], "packet_no", TableFold, LOG)
    named = pats.filter("kind = 'programs'").select("stream_id", F.explode("map.pmt_pids.pid").alias("pid")).distinct()
    fixed = sound.filter(F.col("pid").isin(PAT_PID, NIT_PID, SDT_PID, EIT_PID))
    others = sound.filter(~F.col("pid").isin(PAT_PID, NIT_PID, SDT_PID, EIT_PID)).join(named, ["stream_id", "pid"], "left_semi")
    return ordered_fold(fixed.unionByName(others), ["stream_id"], "packet_no", TableFold, LOG)


def sections(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'section'").select("stream_id", "pid", "packet_no", "ordinal", "section.*")


def map_versions(log: DataFrame) -> DataFrame:
    """Program map versions with the packets they hold for: after from_packet, up to and including to_packet.

    Numbered in chunks like health.marked(): a window keeps its rows in memory
    that it doesn't give back to what follows in its task, and maps are long.
    The versions before a chunk and the first packet behind it are carried over
    a table with a row for each.  The log is read twice, so it is better staged.
    """
    rows = log.filter("kind IN ('programs', 'services')").select("stream_id", "kind", "packet_no", "ordinal", F.floor(F.col("packet_no") / F.lit(health.CHUNK)).alias("chunk"), "map.*")
    chunks = W.partitionBy("stream_id").orderBy("chunk")
    ends = rows.groupBy("stream_id", "chunk").agg(F.count(F.lit(1)).alias("versions"), F.min("packet_no").alias("first_packet"))
    before = F.coalesce(F.sum("versions").over(chunks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = ends.select(F.col("stream_id").alias("e_stream"), F.col("chunk").alias("e_chunk"), before.alias("before"), F.lead("first_packet").over(chunks).alias("behind"))
    rows = rows.join(carried, F.col("stream_id").eqNullSafe(F.col("e_stream")) & (F.col("chunk") == F.col("e_chunk")))
    order = W.partitionBy("stream_id", "chunk").orderBy("packet_no", "ordinal")
    version, to_packet = (F.col("before") + F.row_number().over(order)).cast("int"), F.coalesce(F.lead("packet_no").over(order), F.col("behind"))
    return rows.select("stream_id", version.alias("version_no"), "kind", F.col("packet_no").alias("from_packet"), to_packet.alias("to_packet"), *parsed(MAP).names)


def latest_map(log: DataFrame) -> DataFrame:
    return log.filter("kind IN ('programs', 'services')").groupBy("stream_id").agg(F.max_by("map", F.struct("packet_no", "ordinal")).alias("map")).select("stream_id", "map.*")


def tracks(maps: DataFrame) -> DataFrame:
    """One row for each track, in map order, with kind and label; keeps the other columns of maps."""
    programs = maps.select("*", F.posexplode("programs").alias("program_pos", "p")).select("*", F.posexplode("p.streams").alias("track_pos", "t"))
    raw = F.col("t.raw_type")
    return programs.select(
        *[c for c in maps.columns if c not in ("programs", "pmt_pids", "services", "network")], "program_pos", "track_pos", F.col("p.program").alias("program"), F.col("p.pcr_pid").alias("pcr_pid"), F.col("t.pid").alias("pid"),
        raw.alias("raw_type"), dims.stream_kind(raw).alias("kind_of_stream"), dims.stream_label(raw).alias("label"), F.get("t.languages", F.lit(0)).alias("language"), F.col("t.languages").alias("languages"), F.col("t.descriptors").alias("descriptors"),
    )


def services(maps: DataFrame) -> DataFrame:
    s = maps.select("stream_id", F.explode("services").alias("s"))
    return s.select("stream_id", "s.service_id", dims.running_status(F.col("s.running_status")).alias("running_status"), "s.scrambled", "s.eit_schedule", "s.eit_present_following", "s.type", "s.provider", "s.name")


def guide(log: DataFrame) -> DataFrame:
    """Programme events of each service as last merged; position 0 is on now, 1 is next."""
    last = log.filter("kind = 'guide'").groupBy("stream_id", "guide.service_id").agg(F.max_by("guide", F.struct("packet_no", "ordinal")).alias("g"))
    e = last.select("stream_id", "service_id", F.posexplode("g.events").alias("position", "e"))
    end = F.timestamp_seconds(F.unix_timestamp("e.start") + F.col("e.duration_s"))
    return e.select("stream_id", "service_id", "position", "e.event_id", "e.start", end.alias("end"), "e.duration_s", dims.running_status(F.col("e.running_status")).alias("running_status"), "e.scrambled", "e.language", "e.name", "e.text")


def described_programs(programs: DataFrame, named: DataFrame) -> DataFrame:
    """programs (stream_id, program, ...) with the service's name, or "program N"."""
    names = named.select("stream_id", F.col("service_id").alias("program"), F.col("name").alias("service_name"))
    return programs.join(names, ["stream_id", "program"], "left").withColumn("described", F.coalesce("service_name", F.concat(F.lit("program "), F.col("program"))))


def describe_pids(pids: DataFrame, maps: DataFrame) -> DataFrame:
    """pids (stream_id, pid) with what each carries: fixed tables first, then PMTs, then tracks; else null."""
    named = services(maps)
    pmts = described_programs(maps.select("stream_id", F.posexplode("pmt_pids").alias("pos", "x")).select("stream_id", "pos", "x.program", "x.pid"), named)
    pmts = pmts.groupBy("stream_id", "pid").agg(F.min_by("described", "pos").alias("pmt_of"))
    own = described_programs(tracks(maps), named)
    text = F.concat_ws(" ", "described", "label", F.when(F.col("language").isNotNull(), F.concat(F.lit("["), F.col("language"), F.lit("]"))))
    own = own.groupBy("stream_id", "pid").agg(F.min_by(text, F.struct("program_pos", "track_pos")).alias("track"))
    fixed = fixed_description(F.col("pid"))
    found = pids.join(pmts, ["stream_id", "pid"], "left").join(own, ["stream_id", "pid"], "left")
    return found.withColumn("description", F.coalesce(fixed, F.concat(F.lit("PMT for "), F.col("pmt_of")), F.col("track"))).drop("pmt_of", "track")


def fixed_description(pid: Column) -> Column:
    return F.when(pid == PAT_PID, "PAT").when(pid == NULL_PID, "null packets").when(pid == NIT_PID, "NIT").when(pid == SDT_PID, "SDT").when(pid == EIT_PID, "EIT")


def stream_with_language(maps: DataFrame, language: str) -> DataFrame:
    """The first track of each program that has the language, whatever its case."""
    some = tracks(maps).filter(F.exists("languages", lambda x: F.lower(x) == language.lower()))
    return some.groupBy("stream_id", "program").agg(F.min_by("pid", "track_pos").alias("pid"))


def first_video(maps: DataFrame) -> DataFrame:
    return tracks(maps).filter("kind_of_stream = 'VIDEO'").groupBy("stream_id", "program").agg(F.min_by("pid", "track_pos").alias("pid"))


def is_known(maps: DataFrame) -> DataFrame:
    """Whether a stream's PAT has been seen."""
    return maps.select("stream_id", F.col("ts_id").isNotNull().alias("is_known"))


def missing_pids(maps: DataFrame, packets: DataFrame) -> DataFrame:
    """Tracks that a program map lists and no packet carries."""
    return tracks(maps).select("stream_id", "program", "pid").join(packets.select("stream_id", "pid").distinct(), ["stream_id", "pid"], "left_anti")
