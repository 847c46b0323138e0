import zlib

import numpy as np

from tsloom.llm import sharding as S


def test_law_and_content(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = S.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    texts = {d.doc_id: d.text for d in docs}
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 16, zlib.crc32((texts[r.doc_id] or "").encode())) for r in rows)
    kinds = {f.name: f.dataType.simpleString() for f in S.query(spark, sf).schema}
    assert kinds == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


def test_query_against_brute_force(spark, tmp_path):
    """Null, empty, repeated and very long texts; where each row goes is drawn anew in plain Python from the staged places."""
    rows = [(i, "t" * i) for i in range(70)] + [(1000, None), (1001, ""), (1001, ""), (None, "x"), (1002, "é" * 300_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.query(spark, str(tmp_path)).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    places = sorted((r.shard, r.slot) for r in got)
    sizes = [75 // 40 + (s < 75 % 40) for s in range(40)]
    assert places == [(s, k) for s in range(40) for k in range(sizes[s])]


def test_every_permutation_is_as_likely(spark):
    """Four rows of two partitions into two shards: each of the 24 orders comes about as often."""
    df = spark.createDataFrame([(i,) for i in range(4)], "x int").repartition(2).persist()
    df.count()
    part = [(r.p, r.x) for r in df.selectExpr("spark_partition_id() AS p", "x").collect()]
    sizes = {p: sum(q == p for q, _ in part) for p, _ in part}
    bounds = np.cumsum([0, *[sizes[p] for p in sorted(sizes)]])
    seen = {}
    for seed in range(4800):
        places = S.cells_of(4, 2, 1)[2]
        order = []
        for k, n in enumerate(np.diff(bounds)):
            cells = np.repeat(np.arange(len(places)), S.matrix_row(k, bounds, places, seed))
            dealt = np.empty(n, int)
            dealt[np.random.default_rng([seed, k, 1, 1]).permutation(n)] = cells
            order += dealt.tolist()
        seen[tuple(order)] = seen.get(tuple(order), 0) + 1
    assert len(seen) == 24 and max(abs(v - 200) for v in seen.values()) < 75


def test_edge_cases(spark):
    df = spark.createDataFrame([(i % 3 or None, "t" if i % 5 else None, i) for i in range(101)], "doc_id long, text string, cell int").repartition(7)
    got = S.shard_rows(df, shards=4, cell_rows=8).collect()
    again = S.shard_rows(df, shards=4, cell_rows=8).collect()
    assert sorted(r.row.cell for r in got) == list(range(101))
    assert sorted((r.row.cell, r.shard, r.slot) for r in got) == sorted((r.row.cell, r.shard, r.slot) for r in again)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(26 if s < 1 else 25)]
    assert S.shard_rows(df.limit(0), shards=4).count() == 0
    assert sorted((r.shard, r.slot) for r in S.shard_rows(df.limit(2), shards=4).collect()) == [(0, 0), (1, 0)]


def test_matrix_is_exact_and_uniform():
    bounds = np.cumsum([0, 5, 0, 9, 2, 4])
    places = S.cells_of(20, 3, 4)[2]
    total, pulls = 0, 3000
    for seed in range(pulls):
        m = np.stack([S.matrix_row(p, bounds, places, seed) for p in range(5)])
        assert (m.sum(0) == places).all() and (m.sum(1) == np.diff(bounds)).all()
        total = total + m
    want = np.outer(np.diff(bounds), places) / 20
    assert np.abs(total / pulls - want).max() < 0.1


def test_large_populations(monkeypatch):
    rng = np.random.default_rng(0)
    exact = [S.hypergeometric(rng, 300, 700, 200) for _ in range(20000)]
    monkeypatch.setattr(S, "NUMPY_LIMIT", 0)
    for good, bad in ((300, 700), (700, 300)):
        own = [S.hypergeometric(rng, good, bad, 200) for _ in range(20000)]
        mean = 200 * good / 1000
        assert abs(np.mean(own) - mean) < 0.2 and abs(np.std(own) - np.std(exact)) < 0.15
    assert abs(S.hypergeometric(rng, 10**12, 10**12, 10**10) - 5 * 10**9) < 10**6
    assert S.split(rng, np.array([3, 0, 4]), 7).tolist() == [3, 0, 4]
