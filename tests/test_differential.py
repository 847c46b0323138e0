"""Batch operators and live query against the packet-by-packet analyzer, on generated damaged streams."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tsloom.functions.wire import PACKET, decode_packets
from tsloom.operators import events, health, psi, units
from tsloom.sources import synth as S
from tsloom.sources.packets import packets_from_chunks, packets_from_raw
from tsloom.streaming.core import Analyzer
from tsloom.streaming.live import live_events, live_stats


def damaged(seed, n=900):
    """Two programs with clocks of their own, services, a table that changes, and every kind of damage."""
    rng = random.Random(seed)
    cc, out, clocks = {}, [], {256: rng.randrange(10**9), 512: 2**33 * 300 - 27_000_000}

    def nxt(pid):
        cc[pid] = cc.get(pid, -1) + 1
        return cc[pid]

    def table(pid, raw, pointer=0):
        for i, p in enumerate(S.section_payloads(raw, pointer)):
            out.append(S.packet(pid, nxt(pid), p, pusi=i == 0, tei=rng.random() < 0.01))

    version = 0
    for k in range(n):
        if k % 60 == 5:
            programs = {1: 4096, 2: 4097} if k // 60 % 4 != 3 else {1: 4096}
            table(0, S.pat(1, programs, version=version % 32, spoil=rng.random() < 0.1), rng.choice([0, 0, 3]))
        if k % 60 == 7:
            if rng.random() < 0.3:
                version += 1
            extra = [(0x0F, 300 + version % 3, S.descriptor(10, b"eng\0"))]
            table(4096, S.pmt(1, 256, [(0x1B, 256), *extra], S.descriptor(5, b"CUEI") * rng.choice([1, 60]), current=rng.random() < 0.9, spoil=rng.random() < 0.1))
        if k % 60 == 9:
            table(4097, S.pmt(2, rng.choice([512, 512, 0x1FFF]), [(0x24, 512), (0x86, 700)]))
        if k % 90 == 20:
            table(17, S.sdt(1, [(1, "Uno"), (2, f"Due {k // 300}")], spoil=rng.random() < 0.2))
        pid = rng.choice([256, 256, 512, 512, 300, 301, 8191, 900])
        if pid == 8191:
            out.append(S.packet(8191, 0, bytes(184)))
            continue
        clock = pid if pid in clocks else 256
        clocks[clock] += rng.choice([10**5, 6 * 10**5, 12 * 10**5, 10**6, 10**6, 3 * 10**6]) if rng.random() < 0.97 else -(10**7)
        clocks[clock] %= 2**33 * 300
        pcr = clocks[clock] if pid in clocks and rng.random() < 0.5 else None
        options = {"pcr": pcr, "random_access": rng.random() < 0.08, "discontinuity": rng.random() < 0.03, "tei": rng.random() < 0.03, "scrambling": 2 if rng.random() < 0.02 else 0}
        c = nxt(pid)
        if rng.random() < 0.03:
            c = nxt(pid)
        if rng.random() < 0.1:
            out.append(S.packet(pid, c - 1, None, **options))
            cc[pid] -= 1
        elif rng.random() < 0.4:
            pts = (clocks[clock] // 300 + rng.randrange(-3000, 90000)) % 2**33
            out.append(S.packet(pid, c, S.pes(0xE0, bytes(60), pts, pts if rng.random() < 0.3 else None), pusi=True, **options))
        else:
            out.append(S.packet(pid, c, bytes(100), **options))
        if rng.random() < 0.03:
            out.append(out[-1])
    return out


def analyzed(packets):
    rows = decode_packets(np.frombuffer(b"".join(packets), np.uint8), np.arange(len(packets)), pa.array(["s"] * len(packets))).to_pylist()
    a = Analyzer("s")
    said = [(r["packet_no"], e["ordinal"], e["event"], e["pid"], e["a"], e["b"], e["c"]) for r in rows for e in a.feed(r)]
    return a, said


@pytest.mark.parametrize("seed", range(3))
def test_batch_agrees_with_the_analyzer(spark, seed, monkeypatch):
    monkeypatch.setattr(health, "CHUNK", (37, 250, 1 << 20)[seed])
    raw = damaged(seed)
    a, said = analyzed(raw)
    table = spark.createDataFrame([("s", i, bytearray(p)) for i, p in enumerate(raw)], "stream_id string, packet_no long, raw binary").repartition(5)
    p = packets_from_raw(table).cache()
    log = psi.table_log(p).cache()
    maps = psi.map_versions(log).cache()
    pes = units.mapped(units.pes_headers(p), maps).cache()
    stats = health.pid_stats(p, maps, log, pes).collect()
    assert {r.pid for r in stats} == set(a.pids)
    for r in stats:
        want = a.pids[r.pid].row()
        got = {k: r[k] for k in want}
        assert got == want, r.pid
    whole = health.stream_stats(p, maps, log, pes).first()
    assert {k: whole[k] for k in a.stats()} == a.stats()
    got = sorted(((r.packet_no, r.ordinal, r.event, r.pid, r.a, r.b, r.c) for r in events.stream_events(p, log, maps, pes).collect()), key=str)
    assert got == sorted(said, key=str)
    assert sum(x[2] == "continuity_error" for x in said) > 5 and sum(x[2] == "programs_changed" for x in said) > 2 and a.errored_seconds > 1


def test_chunks_and_live_query(spark, tmp_path):
    raw = damaged(7, 400)
    data = b"junk" * 50 + b"".join(raw[:200]) + b"xyz" + b"".join(raw[200:])
    rng = random.Random(1)
    cuts = sorted(rng.sample(range(len(data)), 40))
    pieces = [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)], strict=True)]
    chunks = spark.createDataFrame([("s", i, bytearray(d)) for i, d in enumerate(pieces)], "stream_id string, chunk_no long, data binary")
    p, losses = packets_from_chunks(chunks)
    assert p.count() == len(raw)
    assert sum(r.bytes_discarded for r in losses.collect()) == 203
    for k in range(3):
        chunks.filter(f"chunk_no BETWEEN {k * 14} AND {k * 14 + 13}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    for make, mode, name in ((live_events, "append", "live_ev"), (live_stats, "update", "live_st")):
        q = make(source).writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    a, said = analyzed(raw)
    got = [(r.packet_no, r.ordinal, r.event, r.pid, r.a, r.b, r.c) for r in spark.table("live_ev").collect() if r.event != "sync_lost"]
    assert sorted(got, key=str) == sorted(said, key=str)
    last = spark.table("live_st").orderBy("packets", ascending=False).first()
    want = a.stats()
    assert last.packets == len(raw) and last.continuity_errors == want["continuity_errors"] and last.sync_losses > 0
    assert len(b"".join(raw)) == len(raw) * PACKET
