"""Sources, access units, keyframes and splice events on written streams."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tsloom.functions.wire import decode_packets, pes_header
from tsloom.operators import fmp4, health, psi, scte, units
from tsloom.plans import splices
from tsloom.plans.media import AVC_SPS as SPS
from tsloom.session import staged
from tsloom.sources import synth as S
from tsloom.sources.packets import Realigner, _decode_runs, packets_from_raw, read_ts, write_ts


def video(n=50, gop=10):
    """A made H.264 stream in packets: a delimiter, parameter sets and a key picture every `gop` units."""
    out, cc = [S.packet(0, 0, S.section_payloads(S.pat(1, {1: 4096}))[0], pusi=True), S.packet(4096, 0, S.section_payloads(S.pmt(1, 256, [(0x1B, 256)]))[0], pusi=True)], 0
    for k in range(n):
        key = k % gop == 0
        nals = [b"\x09\xf0", *([SPS, b"\x68\xeb\xe3\xcb"] if key else []), (b"\x65" if key else b"\x41") + bytes([k + 1]) * (700 if key else 90)]
        unit = S.pes_packets(256, cc, S.pes(0xE0, b"".join(b"\0\0\0\1" + x for x in nals), 90000 + 3600 * k, 86400 + 3600 * k), random_access=key, pcr=(80000 + 3600 * k) * 300)
        out += unit
        cc += len(unit)
    return out


def frame(spark, raw):
    return packets_from_raw(spark.createDataFrame([("s", i, bytearray(p)) for i, p in enumerate(raw)], "stream_id string, packet_no long, raw binary").repartition(4))


def rows_of(raw):
    data = b"".join(raw)
    return decode_packets(np.frombuffer(data, np.uint8), np.arange(len(data) // 188), pa.array(["s"] * (len(data) // 188))).to_pylist()


def test_sources_agree(spark, tmp_path):
    raw = video(40)
    path = tmp_path / "a.ts"
    path.write_bytes(b"".join(raw) + b"tail")
    want = [(r["packet_no"], r["pid"], r["cc"], r["pcr"], bytes(r["payload"])) for r in rows_of(raw)]
    key = lambda df: sorted((r.packet_no, r.pid, r.cc, r.pcr, bytes(r.payload)) for r in df.collect())
    assert key(read_ts(spark, str(path), "s")) == key(read_ts(spark, f"file://{path}", "s", bytes_per_task=188 * 5)) == want
    assert {r.stream_id for r in read_ts(spark, str(path)).select("stream_id").distinct().collect()} == {str(path)}
    load = lambda **o: spark.read.format("transport_stream").options(**o).load(str(path))
    assert key(load(bytes_per_task=188 * 7)) == want
    assert {r.payload for r in load(payload="false").select("payload").collect()} == {None}
    (tmp_path / "broken.ts").write_bytes(b"xx" + b"".join(raw[:30]) + b"?" * 50 + b"".join(raw[30:]) + b"G")
    for step in (1 << 20, 188 * 5, 188 * 31):
        p, losses = read_ts(spark, str(tmp_path / "broken.ts"), "s", realign=True, bytes_per_task=step)
        assert key(p) == want and sorted((r.before_packet_no, r.bytes_discarded) for r in losses.collect()) == [(0, 2), (30, 50)]
    chunks = spark.createDataFrame([("s", 0, bytearray(b"".join(raw)))], "stream_id string, packet_no long, raw binary")
    write_ts(chunks.select("stream_id", "packet_no", "raw"), str(tmp_path / "out"), b"tail")
    assert (tmp_path / "out" / "s.ts").read_bytes() == b"".join(raw) + b"tail"
    bad = [raw[0], b"\0" + raw[1][1:], raw[2][:3] + b"\x20\xff" + raw[2][5:]]
    assert [r["packet_no"] for r in rows_of(bad)] == [0]


def test_runs_of_a_batch_are_decoded_together():
    raw = video(40)
    cuts = [0, 1, 2, 3, 10, 10, 11, 50, len(raw)]
    runs = [("s" if a < 11 else "t", 5 * a, b"".join(raw[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    batch = pa.record_batch([pa.array(x) for x in zip(*runs, strict=True)], names=["stream_id", "first", "raw"])
    got = list(_decode_runs([batch]))
    want = [r | {"stream_id": s, "packet_no": first + i} for s, first, x in runs if x for i, r in enumerate(rows_of([x]))]
    assert len(got) == 1 and got[0].to_pylist() == want and list(_decode_runs([batch.slice(0, 0)])) == []


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_cues_where_clocks_begin_anew(spark, monkeypatch, chunk):
    monkeypatch.setattr(health, "CHUNK", chunk)
    raw, times = [S.packet(0, 0, S.section_payloads(S.pat(1, {1: 4096}))[0], pusi=True), S.packet(4096, 0, S.section_payloads(S.pmt(1, 256, [(0x1B, 256), (0x86, 500)]))[0], pusi=True)], [(1 << 33) + 3600 * n for n in range(-3, 4)]
    for i, t in enumerate(times):
        insert = (i // 2).to_bytes(4, "big") + b"\x7f" + (b"\x4f" if i % 2 else b"\xcf") + splices._time(t + 90000) + b"\0\1\1\2"
        raw += [S.packet(256, i, S.pes(0xE0, b"v", t), pusi=True), S.packet(600, 0, None, pcr=300 * t + 5), S.packet(500, i, S.section_payloads(S.splice_info(5, insert))[0], pusi=True)]
    p = health.unwrapped(frame(spark, raw))
    found = scte.on_timeline(scte.splice_events(p, psi.map_versions(psi.table_log(p))))
    assert sorted(tuple(r) for r in found.select("arrival_pcr", "arrival_video_pts", "splice_time", "pre_roll_ticks").collect()) == [(300 * t + 5, t, t + 90000, 90000) for t in times]
    pairs = scte.out_in_pairs(found).select("event_id", "out_time", "in_time").collect()
    assert sorted(tuple(r) for r in pairs) == [(i, times[2 * i] + 90000, times[2 * i + 1] + 90000 if i < 3 else None) for i in range(4)]


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_tables_where_clocks_begin_anew(spark, monkeypatch, chunk):
    monkeypatch.setattr(health, "CHUNK", chunk)
    step = 900_000_000_000
    times = [step * n for n in range(12)]
    raw = [x for t in times for x in (S.packet(256, 0, None, pcr=t), S.packet(0, 0, S.section_payloads(S.pat(1, {1: 4096}))[0], pusi=True))]
    p = health.unwrapped(frame(spark, raw))
    assert sorted(r.pcr for r in p.filter("pcr IS NOT NULL").collect()) == times
    log = psi.table_log(p)
    gaps = [r.interval for r in health.table_repetition(p, log, psi.map_versions(log)).orderBy("packet_no").collect()]
    assert gaps == [None] + [b - a for a, b in zip(times, times[1:], strict=False)]


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_map_versions_are_numbered_in_chunks(spark, monkeypatch, chunk):
    """A window over all versions of a stream would hold their maps in memory."""
    monkeypatch.setattr(health, "CHUNK", chunk)
    named = [1, 1, 2, 3, 3, 4, 5, 5, 5, 6, 7, 8]
    raw = [S.packet(0, i, S.section_payloads(S.pat(1, {n: 4096}))[0], pusi=True) for i, n in enumerate(named)]
    maps = psi.map_versions(psi.table_log(frame(spark, raw)))
    at = [i for i, n in enumerate(named) if i == 0 or n != named[i - 1]]
    want = [(i + 1, a, b, named[a]) for i, (a, b) in enumerate(zip(at, [*at[1:], None], strict=True))]
    assert sorted((r.version_no, r.from_packet, r.to_packet, r.pmt_pids[0].program) for r in maps.collect()) == want
    assert not re.search(r"windowspecdefinition\(stream_id#\d+, packet_no#", maps._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("seed", range(2))
def test_realigned_ranges_against_one_pass(spark, tmp_path, seed):
    """Junk with false sync bytes, cut packets and long gaps: ranges of any size give what one pass over the bytes gives."""
    rng, data = random.Random(seed), b""
    for k in range(160):
        data += S.packet(256, k, bytes([0x47 if rng.random() < 0.02 else k % 256]) * 184)
        if rng.random() < 0.12:
            data += bytes(rng.choice([0x47, 0, 1]) for _ in range(rng.choice([1, 3, 187, 188, 600])))
        if rng.random() < 0.05:
            data = data[: -rng.randint(1, 187)]
    (tmp_path / "a.ts").write_bytes(data)
    one = Realigner()
    runs, gaps = one.feed(data)
    want = [bytes(r["payload"]) for r in rows_of([b"".join(runs)])] if runs else []
    losses = {}
    for n, k in gaps:
        losses[n] = losses.get(n, 0) + k
    for step in (188 * 4, 188 * 9 + 5, 188 * 50, 1 << 20):
        p, lost = read_ts(spark, str(tmp_path / "a.ts"), "s", realign=True, bytes_per_task=step)
        assert [bytes(r.payload) for r in p.orderBy("packet_no").collect()] == want
        assert {r.before_packet_no: r.bytes_discarded for r in lost.collect()} == losses


def assembled(rows):
    """Plain assembly: (status, data) of each unit that a start begins."""
    out, prev, unit = [], None, None

    def close():
        if unit is not None:
            head, data, hit = unit
            out.append(("bad_header", None) if head is None else ("empty", None) if not data else ("loss", None) if hit else ("ok", data))

    for r in rows:
        if r["tei"]:
            prev = None
            if unit:
                unit[2] = True
            continue
        if r["afc"] & 1:
            if prev == r["cc"]:
                continue
            if prev is not None and r["cc"] != (prev + 1) % 16 and unit:
                unit[2] = True
            prev = r["cc"]
        if r["pusi"]:
            close()
            head = pes_header(r["payload"])
            unit = [head, r["payload"][head["header_length"] :] if head else b"", False]
        elif unit and unit[0]:
            unit[1] += r["payload"]
    close()
    return out


@pytest.mark.parametrize("seed", range(2))
def test_access_units_on_a_damaged_track(spark, seed):
    rng, raw, cc = random.Random(seed), [], 0
    for k in range(120):
        body = S.pes(0xE0, bytes([k]) * rng.choice([0, 5, 100, 300, 700]), 1000 * k) if rng.random() < 0.95 else b"not a header"
        for p in S.pes_packets(256, cc, body):
            cc += 1
            x = rng.random()
            if x < 0.03:
                continue
            if x < 0.06:
                p = p[:1] + bytes([p[1] | 0x80]) + p[2:]
            raw.append(p)
            if rng.random() < 0.05:
                raw.append(p)
            if rng.random() < 0.05:
                raw.append(S.packet(256, cc - 1, None, pcr=k))
    found = units.access_units(frame(spark, raw)).orderBy("unit_no").collect()
    got = [(u.status, bytes(u.data) if u.data is not None else None) for u in found if u.unit_no]
    want = assembled(rows_of(raw))
    assert got == want and {"ok", "loss", "empty", "bad_header"} <= {s for s, _ in want}
    c = units.unit_counters(units.access_units(frame(spark, raw)), flush=True).first()
    assert (c.completed, c.discarded_for_loss) == (sum(s == "ok" for s, _ in want), sum(s == "loss" for s, _ in want))


def test_keyframes_carry_parameter_sets(spark):
    tables = [S.packet(0, 0, S.section_payloads(S.pat(1, {1: 4096}))[0], pusi=True), S.packet(4096, 0, S.section_payloads(S.pmt(1, 256, [(0x0F, 300), (0x1B, 256)]))[0], pusi=True)]
    code = b"\0\0\0\1"
    data = [[b"\x65early"], [SPS, b"\x68p1", b"\x65one"], [b"\x41x"], [b"\x09\xf0", b"\x65two"], [b"\x68p2", b"\x65three"], [b"\x65tail"]]
    raw, cc = list(tables), 0
    for k, nals in enumerate(data):
        more = S.pes_packets(256, cc, S.pes(0xE0, b"".join(code + n for n in nals), 3600 * k))
        raw += more
        cc += len(more)
    p = frame(spark, raw)
    maps = psi.map_versions(psi.table_log(p))
    got = [(r.pts, bytes(r.data)) for r in units.keyframes(p, maps).orderBy("pts").collect()]
    join = lambda *n: b"".join(code + x for x in n)
    assert got == [(3600, join(SPS, b"\x68p1", b"\x65one")), (10800, join(SPS, b"\x68p1", b"\x65two")), (14400, join(b"\x68p2", b"\x65three"))]
    assert units.latest_keyframe(units.keyframes(p, maps)).first().keyframes_taken == 3
    assert units.keyframes(p, maps, include_tail=True).count() == 4
    assert units.keyframes(p, maps, max_bytes=40).filter("skipped_for_size").count() == 2


def test_splice_events(spark):
    raw = [S.packet(0, 0, S.section_payloads(S.pat(1, {1: 4096}))[0], pusi=True), S.packet(4096, 0, S.section_payloads(S.pmt(1, 256, [(0x1B, 256), (0x86, 500)]))[0], pusi=True)]
    time = lambda t: (0xFE << 32 | t).to_bytes(5, "big")
    insert = lambda n, out, t: n.to_bytes(4, "big") + b"\x7f" + (b"\xef" if out else b"\x4f") + time(t) + ((0xFE << 32 | 180000).to_bytes(5, "big") if out else b"") + b"\0\1\1\2"
    seg = b"CUEI" + (7).to_bytes(4, "big") + b"\x7f\xff" + (180000).to_bytes(5, "big") + b"\x03\x0cABCD0123456H" + b"\x34\0\0"
    cues = [S.splice_info(5, insert(1001, True, 403200)), S.splice_info(6, time(500000), S.descriptor(2, seg)), S.splice_info(5, insert(1001, False, 583200)), S.splice_info(6, b"\x7f"), S.splice_info(5, b"x", encrypted=True)]
    broken = bytearray(S.splice_info(6, time(1)))
    broken[-1] ^= 1
    raw.append(S.packet(500, 0, S.section_payloads(cues[0])[0], pusi=True, pcr=None))
    raw.append(S.packet(900, 0, None, pcr=200000 * 300))
    for k, cue in enumerate([*cues, bytes(broken)]):
        raw.append(S.packet(500, k + 1, S.section_payloads(cue)[0], pusi=True))
        if k == 0:
            raw.append(S.packet(256, 0, S.pes(0xE0, b"v", 2**33 - 100), pusi=True))
    p = frame(spark, raw)
    maps = psi.map_versions(psi.table_log(p))
    e = scte.splice_events(p, maps).orderBy("sequence")
    got = [(r.sequence, r.splice_time, r.pre_roll_basis, r.pre_roll_ticks, r.description) for r in e.collect()]
    assert got == [
        (1, 403200, "NONE", None, "event 1001 out for 2.0s"), (2, 403200, "PCR", 203200, "event 1001 out for 2.0s"), (3, 500000, "VIDEO_PTS", 500100, "Provider Placement Opportunity Start [ABCD0123456H] for 2.0s"),
        (4, 583200, "VIDEO_PTS", 583300, "event 1001 in"), (5, None, "NONE", None, "time_signal"), (6, None, "NONE", None, "encrypted splice_insert"),
    ]
    c = scte.counters(scte.splice_sections(p, maps)).first()
    assert (c.sections_read, c.sections_unreadable, c.splice_pids) == (6, 1, [500])
    assert [(r.out_sequence, r.in_sequence, r.in_time) for r in scte.out_in_pairs(e).orderBy("out_sequence").collect()] == [(1, 4, 583200), (2, 4, 583200)]


def test_splice_sections_are_assembled_once(spark):
    raw = [S.packet(0, 0, S.section_payloads(S.pat(1, {1: 4096}))[0], pusi=True), S.packet(4096, 0, S.section_payloads(S.pmt(1, 256, [(0x1B, 256), (0x86, 500)]))[0], pusi=True)]
    raw.append(S.packet(500, 0, S.section_payloads(S.splice_info(6, splices._time(5)))[0], pusi=True))
    p = staged(frame(spark, raw), "packets")
    found = scte.splice_events(p, psi.map_versions(staged(psi.table_log(p), "log")))
    assert not re.search("MapInArrow|ArrowEvalPython", found._jdf.queryExecution().optimizedPlan().toString())
    assert [(r.sequence, r.splice_time) for r in found.collect()] == [(1, 5)]


def test_remux_writes_a_file(spark, tmp_path):
    p = frame(spark, video(30))
    segments = fmp4.remux(p, psi.table_log(p))
    size = fmp4.write_mp4(segments, "s", str(tmp_path / "a.mp4"))
    data = (tmp_path / "a.mp4").read_bytes()
    at, kinds = 0, []
    while at < len(data):
        kinds.append(data[at + 4 : at + 8].decode())
        at += int.from_bytes(data[at : at + 4], "big")
    assert at == size == len(data) and kinds == ["ftyp", "moov", *["moof", "mdat"] * 3]
    assert [int.from_bytes(data[i + 8 : i + 12], "big") for i in range(len(data)) if data[i : i + 4] == b"mfhd"] == [1, 2, 3]


def test_audio_and_video_are_interleaved_as_finished(spark):
    adts = lambda n: (0xFFF1 << 40 | 1 << 38 | 3 << 34 | 2 << 30 | (7 + n) << 13 | 0x7FF << 2).to_bytes(7, "big") + bytes(n)
    pictures = video(30)
    raw = [pictures[0], S.packet(4096, 0, S.section_payloads(S.pmt(1, 256, [(0x1B, 256), (0x0F, 257)]))[0], pusi=True)]
    cc = 0
    for k, p in enumerate(pictures[2:]):
        raw.append(p)
        if k % 12 == 5:
            audio = S.pes_packets(257, cc, S.pes(0xC0, adts(100) * 3, 90000 + 5760 * (k // 12)))
            raw += audio
            cc += len(audio)
    p = frame(spark, raw)
    segments = fmp4.remux(p, psi.table_log(p)).orderBy("position").collect()
    tracks = [int.from_bytes(bytes(r.data)[44:48], "big") for r in segments[1:]]
    assert set(tracks) == {1, 2} and tracks.count(1) == 3 and tracks[-1] == 1
    assert bytes(segments[0].data).count(b"trak") == 2
