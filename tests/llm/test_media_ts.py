import hashlib
import zlib

import numpy as np

from tsloom.llm import media_ts as M
from tsloom.sources import synth as S


def test_round_trip_of_every_size():
    rng = np.random.default_rng(1)
    for blocks in [*range(1, 140), 64 * 8, 64 * 20 + 5, 5000]:
        payload = rng.integers(0, 256, blocks * 192, dtype=np.uint8).tobytes()
        x = M.read(M.store(payload))
        assert x["payload"] == payload and not x["cc_errors"] and x["program"] == 1 and x["streams"] == [(0x100, 6)]
        assert x["pts"].tolist() == [90_000 + k * 64 * 36 for k in range(-(-blocks // 64))]
        assert x["random"].tolist() == [k % 8 == 0 for k in range(len(x["pts"]))]


def plain_store(payload):
    """Packet by packet with the other writer: (stream, units)."""
    out, cc, units = [], 0, [payload[i : i + 192 * 64] for i in range(0, len(payload), 192 * 64)]
    for k, unit in enumerate(units):
        if k % 8 == 0:
            out += [S.packet(0, k // 8, S.section_payloads(S.pat(1, {1: 0x1000}))[0], pusi=True), S.packet(0x1000, k // 8, S.section_payloads(S.pmt(1, 0x100, [(6, 0x100)]))[0], pusi=True)]
        pts = 90_000 + 36 * 64 * k
        pes = b"\0\0\1\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + S.stamp(2, pts) + unit
        out.append(S.packet(0x100, cc, pes[:176], pusi=True, random_access=k % 8 == 0, pcr=(pts - 45_000) * 300))
        cc += 1
        for i in range(176, len(pes), 184):
            out.append(S.packet(0x100, cc, pes[i : i + 184]))
            cc += 1
    return b"".join(out), units


def test_stored_bytes_against_another_writer():
    rng = np.random.default_rng(2)
    for blocks in [*range(1, 70), 64 * 9, 64 * 17 + 3]:
        payload = rng.integers(0, 256, blocks * 192, dtype=np.uint8).tobytes()
        assert M.store(payload) == plain_store(payload)[0]


def test_query_against_another_writer(spark, tmp_path):
    """Null, empty and very long texts, every column of the contract and the feature."""
    rows = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 97), (5, "long text " * 300_000), (None, "x"), (6, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) for r in M.query(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        media, units = plain_store(payload)
        feature = f"program=1 packets={len(media) // 188} units={len(units)} random={-(-len(units) // 8)} first_pts=90000 last_pts={90000 + 2304 * (len(units) - 1)} cc_errors=0 crc32={zlib.crc32(payload)}"
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    assert got == sorted(want, key=str)


def test_damage_is_reported():
    payload = bytes(range(192)) * 64 * 20
    media = M.store(payload)
    gone = media[: 188 * 80] + media[188 * 81 :]
    x = M.read(gone)
    assert x["cc_errors"] == 1 and x["kept"].sum() == 19 and len(x["payload"]) == 19 * 64 * 192
    twice = media[: 188 * 81] + media[188 * 80 :]
    assert M.read(twice)["payload"] == payload and not M.read(twice)["cc_errors"]
    bad = bytearray(media)
    bad[20] ^= 1  # the first PAT: its CRC fails, a later one serves
    assert M.read(bytes(bad))["payload"] == payload
    assert M.read(b"")["payload"] == b"" and M.read(b"x" * 400)["lost_bytes"] == 400


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a" * 192), (4, "a" * 193), (None, "é" * 5000), (1, None)]
    df = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, media string")
    got = sorted(((r.doc_id or 0), r.n_bytes, bytes(r.payload)) for r in M.read_media(M.store_texts(df)).collect())
    pad = lambda b: b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
    assert got == sorted(((i or 0), len((t or "").encode()), pad((t or "").encode())) for i, t in rows)
    assert M.read_media(M.store_texts(df.limit(0))).count() == 0


def test_documents(spark, sf):
    got = {r.doc_id: r for r in M.query(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = (d.text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = M.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
