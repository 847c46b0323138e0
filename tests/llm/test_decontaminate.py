import hashlib
import re

from tsloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = cut(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    found |= got
                    hit |= set(range(i, i + n))
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows_of(df):
    listed = D.F.array_join(D.F.array_sort(D.F.transform("items", lambda i: i.cast("string"))), ",")
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", D.F.size("items"), D.F.sha2(listed, 256), "contaminated").collect()), key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
DOCS = [
    (1, f"Well, {PASSAGE.upper()}! and more"), (2, None), (3, ""), (4, "..."), (5, "short item here"), (5, "short item here"), (None, PASSAGE),
    (6, " ".join(["the"] * 500)), (7, "x " * 4000 + PASSAGE), (8, PASSAGE.replace("seven", "se-ven")), (9, "été ÉTÉ 12 short ITEM here short item here"), (10, "one two three four five six seven"), (11, "eight nine ten eleven twelve thirteen fourteen"),
]
ITEMS = [(0, PASSAGE), (1, PASSAGE + " fifteen"), (2, "short, item; here"), (3, ""), (4, None), (10, " ".join(["the"] * 20)), (12, "été")]


def test_edge_cases(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, hits string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    assert rows_of(D.contamination(docs, items)) == want
    assert D.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in D.contamination(docs, items.limit(0)).collect()} == {0}
    monkeypatch.setattr(D, "BLOCK_WORDS", 10)
    assert rows_of(D.contamination(docs, items)) == want


def nearby(docs, items, slop):
    """Items with a window and a start in the document from which each word lies within slop of its place."""
    out = {}
    for doc, text in docs:
        w, found = cut(text), set()
        for item, t in items:
            v = cut(t)
            n = min(13, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for b in range(-slop, len(w) + slop):
                    if all(any(w[p] == x for p in range(max(0, b + k - slop), min(len(w), b + k + slop + 1))) for k, x in enumerate(v[i : i + n])):
                        found.add(item)
        out[doc] = sorted(found)
    return out


def test_proximity(spark):
    rows = [(1, "alpha gap beta gamma"), (2, "alpha beta gamma"), (3, "alpha a b c d beta gamma"), (4, "foo foo foo"), (5, "gamma alpha alpha beta beta"), (6, "x x x alpha"), (7, "beta gamma y y y"), (8, "gamma beta alpha")]
    items = [(7, "alpha beta gamma"), (8, "alpha beta"), (9, "gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 2, 4, 8):
        assert {r.doc_id: r.near for r in D.contamination(docs, table, slop=slop).collect()} == nearby(rows, items, slop)
    assert {r.doc_id: r["items"] for r in D.contamination(docs, table, slop=2).collect()}[1] == [9]


def test_random_texts_of_few_words(spark, monkeypatch):
    import random

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    rows = [(i, text(rng.randint(0, 40))) for i in range(60)]
    items = [(i, text(rng.choice([2, 4, 13, 14, 20]))) for i in range(12)] + [(20, rows[5][1] + " " + rows[6][1]), (21, rows[7][1][:40])]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_WORDS, 15):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        found = D.contamination(docs, table, slop=1).persist()
        assert {r.doc_id: r.near for r in found.collect()} == nearby(rows, items, 1)
        assert rows_of(found) == brute(rows, items)


def test_unlike_words_of_equal_polynomial_hashes(spark):
    """Thue-Morse words: equal under any polynomial modulo 2^64."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs, items = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in D.contamination(docs, items).collect()} == {1: 1, 2: 0}


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = D.query(spark, sf).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute(docs, items)
    short = [(i, t) for i, t in docs if len(t or "") < 1500][:40]
    want = nearby(short, items[:6], D.SLOP)
    some = D.contamination(spark.createDataFrame(short, "doc_id long, text string"), spark.createDataFrame(items[:6], "item_id long, text string"), D.SLOP)
    assert {r.doc_id: r.near for r in some.collect()} == want
    assert all(r.n_near >= r.n_items for r in got)
