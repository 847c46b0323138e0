"""One stream's analyzer, packet by packet: the state of the live query and the oracle of the batch operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from tsloom.functions.wire import NULL_PID, PCR_HZ, WRAP33, pes_header
from tsloom.operators.health import PCR_JUMP, PCR_LIMIT, PTS_LIMIT, TABLE_LIMIT
from tsloom.operators.psi import TableFold


@dataclass
class Spacing:
    """Time between occurrences; only growing time counts."""

    limit: int
    at: int | None = None
    breaches: int = 0
    widest: int = 0

    def gap(self, delta: int) -> int:
        """delta where it breaches the limit, else 0."""
        if delta > self.widest:
            self.widest = delta
        if delta <= self.limit:
            return 0
        self.breaches += 1
        return delta

    def now(self, time: int) -> int:
        before, self.at = self.at, time
        return 0 if before is None else self.gap(time - before)


@dataclass
class Clock:
    pcr: int | None = None
    second: int | None = None
    seconds: int = 0

    def tick(self, pcr: int) -> None:
        self.pcr = pcr
        if pcr // PCR_HZ != self.second:
            self.second = pcr // PCR_HZ
            self.seconds += 1


@dataclass
class Pid:
    pid: int
    first_packet: int
    packets: int = 0
    payload_bytes: int = 0
    continuity_errors: int = 0
    packets_lost: int = 0
    transport_errors: int = 0
    duplicates: int = 0
    scrambled: bool = False
    cc: int | None = None
    random_access_points: int = 0
    packets_since_random_access: int | None = None
    gop_hit: bool = False
    damaged_gops: int = 0
    pcr_count: int = 0
    last_pcr: int | None = None
    pcr_discontinuities: int = 0
    pcr_spacing: Spacing = field(default_factory=lambda: Spacing(PCR_LIMIT))
    pts_spacing: Spacing = field(default_factory=lambda: Spacing(PTS_LIMIT))
    pts_skew: int | None = None
    min_pts_skew: int | None = None
    late_timestamps: int = 0
    pes_packets: int = 0
    pes_stream_id: int | None = None
    last_pts: int | None = None
    last_dts: int | None = None
    errored_seconds: int = 0
    errored_in: int | None = None

    def row(self) -> dict:
        """Figures named as in health.pid_stats."""
        hidden = ("cc", "gop_hit", "pcr_spacing", "pts_spacing", "errored_in")
        own = {k: v for k, v in self.__dict__.items() if k not in hidden}
        return own | {"pcr_repetition_errors": self.pcr_spacing.breaches, "max_pcr_interval": self.pcr_spacing.widest, "pts_repetition_errors": self.pts_spacing.breaches, "max_pts_interval": self.pts_spacing.widest}


class Analyzer:
    """feed() takes packet rows in order and returns events (ordinal, event, pid, a, b, c)."""

    def __init__(self, stream_id: str = ""):
        self.pids: dict[int, Pid] = {}
        self.tables = TableFold((stream_id,))
        self.clocks: dict[int, Clock] = {}
        self.bound: dict[int, int] = {}
        self.reference: int | None = None
        self.packets = self.payload_bytes = self.null_packets = self.sync_losses = 0
        self.errored_seconds, self.errored_in = 0, None
        self.table_spacing: dict[int, Spacing] = {}

    def _clock(self, pid: int) -> Clock:
        if self.reference is None:
            self.reference = pid
        return self.clocks.setdefault(pid, Clock())

    def _clock_of(self, pid: int) -> Clock | None:
        found = self.bound.get(pid, self.reference)
        return None if found is None else self.clocks[found]

    def _errored(self, s: Pid | None) -> None:
        own = self._clock_of(s.pid) if s else None
        if own and own.seconds and own.seconds != s.errored_in:
            s.errored_in = own.seconds
            s.errored_seconds += 1
        ref = self.clocks.get(self.reference)
        if ref and ref.seconds and ref.seconds != self.errored_in:
            self.errored_in = ref.seconds
            self.errored_seconds += 1

    @staticmethod
    def _hit_gop(s: Pid) -> None:
        if s.random_access_points and not s.gop_hit:
            s.gop_hit = True
            s.damaged_gops += 1

    def sync_lost(self, skipped: int) -> list[dict]:
        self.sync_losses += 1
        self._errored(None)
        return [{"ordinal": 0, "event": "sync_lost", "pid": None, "a": skipped, "b": None, "c": None}]

    def feed(self, row: dict) -> list[dict]:
        out: list[dict] = []

        def say(ordinal: int, event: str, pid: int | None, a=None, b=None, c=None) -> None:
            out.append({"ordinal": ordinal, "event": event, "pid": pid, "a": a, "b": b, "c": c})

        pid = row["pid"]
        self.packets += 1
        self.payload_bytes += row["payload_len"]
        if pid == NULL_PID:
            self.null_packets += 1
            return out
        s = self.pids.get(pid)
        if s is None:
            s = self.pids[pid] = Pid(pid, row["packet_no"])
            say(1, "pid_discovered", pid)
        s.packets += 1
        s.payload_bytes += row["payload_len"]
        if row["tei"]:
            s.transport_errors += 1
            self._errored(s)
            self._hit_gop(s)
            s.cc = None
            return out
        scrambled = row["scrambling_control"] != 0
        if scrambled != s.scrambled:
            s.scrambled = scrambled
            say(2, "scrambling_changed", pid, int(scrambled))
        self._continuity(s, row, say)
        if row["random_access"]:
            s.random_access_points += 1
            s.packets_since_random_access, s.gop_hit = 0, False
        elif s.random_access_points:
            s.packets_since_random_access += 1
        if row["pcr"] is not None:
            self._pcr(s, row, say)
        self._tables(s, row, say)
        if row["pusi"] and row["payload_len"] > 0 and any(t["pid"] == pid for p in self.tables.programs.values() for t in p["streams"]):
            self._pes(s, row, say)
        return out

    def _continuity(self, s: Pid, row: dict, say) -> None:
        before, s.cc = s.cc, row["cc"]
        if before is None:
            return
        flag = row["afc"] & 1
        expected = (before + 1) % 16 if flag else before
        if s.cc == expected or row["discontinuity"]:
            return
        if flag and s.cc == before:
            s.duplicates += 1
            return
        lost = (s.cc - expected) % 16
        s.continuity_errors += 1
        s.packets_lost += lost
        self._errored(s)
        self._hit_gop(s)
        say(3, "continuity_error", s.pid, expected, s.cc, lost)

    def _pcr(self, s: Pid, row: dict, say) -> None:
        pcr, before = row["pcr"], s.last_pcr
        s.pcr_count += 1
        if before is not None and not row["discontinuity"]:
            delta = pcr - before
            if -delta > WRAP33 * 150:
                delta += WRAP33 * 300
            if delta < 0 or delta > PCR_JUMP:
                s.pcr_discontinuities += 1
                self._errored(s)
                say(4, "pcr_discontinuity", s.pid, before, pcr)
            elif wide := s.pcr_spacing.gap(delta):
                say(5, "pcr_repetition_error", s.pid, wide)
        s.last_pcr = pcr
        self._clock(s.pid).tick(pcr)

    def _tables(self, s: Pid, row: dict, say) -> None:
        for x in self.tables.step(row):
            if x["kind"] == "psi_crc_error":
                self._errored(s)
            elif x["kind"] == "section" and x["section"]["is_current"] and s.pid not in (16, 17, 18):
                ref = self.clocks.get(self.reference)
                if ref and ref.pcr is not None:
                    spacing = self.table_spacing.setdefault(s.pid, Spacing(TABLE_LIMIT))
                    if wide := spacing.now(ref.pcr):
                        say(6, "table_repetition_error", s.pid, wide)
            elif x["kind"] == "programs":
                self.bound = {}
                for p in x["map"]["programs"]:
                    if p["pcr_pid"] != NULL_PID:
                        self._clock(p["pcr_pid"])
                        self.bound |= dict.fromkeys([p["pcr_pid"], *(t["pid"] for t in p["streams"])], p["pcr_pid"])
                say(7, "programs_changed", s.pid, len(x["map"]["programs"]))
            elif x["kind"] == "services":
                say(8, "service_information_changed", s.pid, len(x["map"]["services"]))
            elif x["kind"] == "guide":
                say(9, "events_changed", s.pid, x["guide"]["service_id"], len(x["guide"]["events"]))

    def _pes(self, s: Pid, row: dict, say) -> None:
        head = pes_header(row["payload"])
        if head is None:
            return
        s.pes_packets += 1
        s.pes_stream_id = head["stream_id"]
        s.last_dts = head["dts"] if head["dts"] is not None else s.last_dts
        if (pts := head["pts"]) is None:
            return
        s.last_pts = pts
        clock = self._clock_of(s.pid)
        if clock is None or clock.pcr is None:
            return
        if wide := s.pts_spacing.now(clock.pcr):
            say(10, "pts_repetition_error", s.pid, wide)
        skew = pts - clock.pcr // 300
        skew += WRAP33 if skew < -WRAP33 // 2 else -WRAP33 if skew > WRAP33 // 2 else 0
        s.pts_skew = skew
        s.min_pts_skew = skew if s.min_pts_skew is None else min(s.min_pts_skew, skew)
        if skew <= 0:
            s.late_timestamps += 1
            say(11, "late_timestamp", s.pid, skew)

    def stats(self) -> dict:
        """Figures named as in health.stream_stats, without rates."""
        rows = [s.row() for s in self.pids.values()]
        sums = ("continuity_errors", "packets_lost", "transport_errors", "duplicates", "pcr_discontinuities", "pcr_repetition_errors", "pes_packets", "pts_repetition_errors", "late_timestamps")
        ends = {x["kind"]: x["crc_errors"] for x in self.tables.end()}
        ref = self.clocks.get(self.reference)
        spaced = self.table_spacing
        return {k: sum(r[k] for r in rows) for k in sums} | {
            "packets": self.packets, "payload_bytes": self.payload_bytes, "null_packets": self.null_packets, "sync_losses": self.sync_losses, "crc_errors": ends["psi_end"], "dvb_crc_errors": ends["dvb_end"],
            "errored_seconds": self.errored_seconds, "observed_seconds": ref.seconds if ref else 0, "pat_repetition_errors": sum(x.breaches for p, x in spaced.items() if p == 0),
            "pmt_repetition_errors": sum(x.breaches for p, x in spaced.items() if p), "max_table_interval": max((x.widest for x in spaced.values()), default=0),
        }
