import random
import re

import corpus_pipeline as P
import numpy as np
import pytest

from tsloom.llm import simhash, simhash_sets


def shingles(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    """The smallest id of each document's component, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    low = {r: min(d for (d, _), x in zip(rows, root, strict=True) if x == r) for r in root}
    return {d: low[r] for (d, _), r in zip(rows, root, strict=True)}


def copies(seed):
    """Texts, copies of them with some words changed, a passage that many share, and chains of such copies."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    common = [word() for _ in range(30)]
    texts = []
    for n in range(30):
        words = [word() for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        if n % 3 == 0:
            words = common + words
        for _ in range(rng.choice([1, 2, 12]) if n else 40):
            texts.append(" ".join(words))
            base = words
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = word()
            if n % 2:
                words, base = base, words
    texts += [None, "", " \n ", "A b  c", "a B c"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", (1, 2))
def test_stage_equal_to_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # keys of many parts
        monkeypatch.setattr(simhash_sets, "PART", 3)
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=(4, 5)).collect()} == want
    assert sorted(r.doc_id for r in P.keep_one_of_each(spark, docs, "").collect()) == sorted(set(want.values()))


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, max(1, n // 5), dtype=np.uint64)]))
        x, y = simhash_sets.sketches_of(np.concatenate([a, b]), np.array([len(a), len(b)]))
        apart = int(np.bitwise_count(x ^ y).sum())
        assert apart <= len(np.setxor1d(a, b)) and (n < 60 or apart > 5)
        table = simhash_sets._table(np.stack([x, y]))
        assert np.abs(table[0] - table[1]).max() <= apart
    assert simhash_sets.sketches_of(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [[0] * simhash_sets.WORDS] * 2
