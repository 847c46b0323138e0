import re

import numpy as np
import pytest
import xxhash

from tsloom.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def classes(ids, fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            groups.setdefault(find(i), []).append(ids[i])
    return [min(groups.get(find(i), [None])) if groups.get(find(i)) else None for i in range(len(fps))]


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "a b c d"), (2, "A  B\tc\nd"), (3, None), (4, ""), (5, " \n"), (6, "one"), (None, "one"), (7, "one two"), (8, long), (9, long + " x"), (9, long), (10, "é ü x y z"), (11, "x" * 100 + " b " + "y" * 70)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = brute([t for _, t in rows])
    want = sorted((i is None, i or 0, f, c) for (i, _), f, c in zip(rows, fps, classes([i for i, _ in rows], fps), strict=True))
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    fps = brute([r.text for r in docs])
    want = classes([r.doc_id for r in docs], fps)
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(docs, fps, want, strict=True)}


@pytest.mark.parametrize("seed", range(4))
def test_no_link_is_lost(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(map(int, base))
    for b in base[:8]:
        for _ in range(60):
            f = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                f ^= 1 << int(bit)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.fp: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = classes(signed, fps)
    assert [roots.get(f, f) for f in signed] == want


def test_hot_keys_are_dealt_anew(spark, monkeypatch):
    """50,000 fingerprints that agree in 32 bits, some of them chained, in bounded time."""
    import time

    rng = np.random.default_rng(9)
    fps = set(map(int, rng.integers(0, 1 << 32, 50_000)))
    for f in sorted(fps)[::500]:
        for _ in range(5):
            f ^= 1 << int(rng.integers(0, 32))
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64) | np.uint64(0xABCD1234 << 32)
    found = {}
    for hot in (4096, 100):
        monkeypatch.setattr(simhash, "HOT", hot)
        df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
        began = time.time()
        found[hot] = {r.fp & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(df)).collect()}
        assert time.time() - began < 120
    # Brute force, a fingerprint against all others at a time.
    parent = np.arange(len(fps))
    for i in range(len(fps)):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3)
        for j in near.tolist():
            a, b = i, j
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
    want = {}
    for i in range(len(fps)):
        r = i
        while parent[r] != r:
            r = parent[r]
        if r != i:
            want[int(fps[i])] = int(fps[r])
    assert found[4096] == found[100] == want and len(want) > 400


def test_levels_leave_few_free_bits():
    masks = {0}
    for level in range(simhash.LEVELS):
        masks = {n for m in sorted(masks)[:50] for n in simhash.narrower(m)}
    assert all(64 - m.bit_count() <= 9 for m in masks)
