import duckdb
import pytest

from tsloom.llm import decontaminate as D


@pytest.mark.parametrize("block", [1, 1 << 21])
def test_items_without_an_id_count_hits(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    a, b = (" ".join(f"{x}{i}" for i in range(14)) for x in "ab")
    items = [(None, a), (None, a + " more"), (2, b)]
    docs = [(0, a), (1, b), (2, a + " . " + b), (3, "clean"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in D.query(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(con.execute(D.ORACLE).fetchall())
    assert [r[0] for r in got if r[-1]] == [0, 1, 2]
