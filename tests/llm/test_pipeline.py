
import corpus_pipeline as P
import pytest
import test_decontaminate
import test_simhash_sets
from pyspark.sql import functions as F

from tsloom.llm import simhash

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Small tables with planted cases."""
    words = [f"w{i}" for i in range(500)]
    prose = lambda i: ". ".join(" ".join(words[(i * 37 + k * (i % 11 + 1)) % 500] for k in range(s * 9, s * 9 + 9)).capitalize() for s in range(6)) + "."
    rows, labels = [], []
    for i in range(240):
        text, toxic, good = prose(i), i % 6 == 1, i % 6 != 2
        if toxic:
            text += " vileword here."
        if not good:
            text = " | ".join(text.upper().split()) + " !!! ### $$$"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    copy = prose(0)
    rows += [(1000, copy, "en", "s", 1), (1001, copy.upper(), "en", "s", 1), (None, copy, "en", "s", 1), (1002, "Take " + PASSAGE + ".", "en", "s", 1), (1003, None, "en", "s", 0), (1004, "", None, "s", 0)]
    rows += [(None, prose(900), "en", "s", 1), (None, prose(900), "en", "s", 1)]
    d = str(tmp_path_factory.mktemp("made"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_planted_cases(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    got = P.run(spark, made).collect()
    ids = [r.doc_id for r in got]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named))
    assert all(i % 6 not in (1, 2) for i in named if i < 240)
    assert 0 in named and not {1000, 1001, 1002, 1004} & set(named)
    assert sum(i is None for i in ids) == 1  # the two nameless copies of prose(900); the one of prose(0) is in its group
    clean = {r.doc_id for r in docs.filter("doc_id < 240").collect() if r.doc_id % 6 not in (1, 2)}
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.filter("doc_id < 240 AND doc_id % 6 NOT IN (1, 2)"), shingle=5, similarity=(4, 5)).collect()}
    assert {i for i in named if i < 240} == {i for i in clean if classes[i] == i}
    assert all(r.n_tokens == len(r.ids or []) for r in got)


def test_stages_keep_the_columns(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet").withColumn("score", F.lit("own")).withColumn("fp", F.lit(1))
    empty = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, made).schema.names == docs.schema.names
        assert stage(spark, empty, made).count() == 0
    assert P.tokenize(spark, empty, made).count() == 0


def test_stages_against_brute_force(spark, sf):
    """All pairs of shingle sets, and every window of every item in every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [r.doc_id for r in P.keep_one_of_each(spark, docs, sf).collect()]
    assert sorted(kept) == sorted(set(test_simhash_sets.brute(rows).values()))
    clean = sorted(r.doc_id for r in P.drop_contaminated(spark, docs, sf).collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert clean == sorted(r[0] for r in test_decontaminate.brute(rows, items) if not r[-1])


def test_run_against_brute_force(spark, sf):
    """run() on whole tables: the classifiers' scores one by one (held against plain Python elsewhere), all pairs, every window, the library's ids."""
    import numpy as np
    import sentencepiece

    from tsloom.llm import quality, sentencepiece_viterbi, toxicity

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = lambda model, text: float(model.score(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0])
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    table = lambda: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit_on(table(), labels)
    rows = [r for r in rows if one(model, r[1]) < model.thresholds.get(r[2], model.default)]
    model = quality.fit_on(table(), labels)
    rows = [r for r in rows if one(model, r[1]) >= quality.CUT]
    kept = set(test_simhash_sets.brute([r[:2] for r in rows]).values())
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in test_decontaminate.brute([r[:2] for r in rows], items) if not r[-1]}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL)
    want = {r[0]: library.encode(r[1]) for r in rows if r[0] in clean}
    got = {r.doc_id: list(r.ids) for r in P.run(spark, sf).collect()}
    assert got == want and 50 < len(want) < 200
