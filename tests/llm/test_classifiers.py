import os
import re
import zlib

import numpy as np
import pytest

from tsloom.llm import quality, sample, toxicity
from tsloom.llm.textbytes import hashes, words


def bytes_of(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def toy(n, seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = list(rng.choice(vocab, int(rng.integers(5, 60))))
        y = int(rng.random() < 0.3)
        if y:
            w[int(rng.integers(len(w)))] = f"nasty{rng.integers(5)}"
        rows.append((" ".join(w), "en" if i % 2 else "de", y))
    return rows


def test_network_learns_rare_words_and_stems():
    model = toxicity.fit(toy(800), (560, 240))
    test = toy(300, 1)
    y = np.array([r[2] for r in test])
    assert ((model.score(*bytes_of([r[0] for r in test])) >= 0.3) == y).mean() > 0.97
    assert set(model.thresholds) == {"en", "de"}
    assert model.score(*bytes_of(["word1 word2 nastyness word3", "word1 word2 word3"]))[0] > 0.3
    whole = model.score(*bytes_of([r[0] for r in test]))
    alone = [float(model.score(*bytes_of([r[0]]))[0]) for r in test[:40]]
    assert whole[:40].tolist() == alone  # no effect of the batch


def test_a_single_bad_word_in_a_very_long_text():
    model = toxicity.fit(toy(800), (560, 240))
    long = " ".join(f"word{i % 300}" for i in range(30000))
    a, b = model.score(*bytes_of([long, long + " nasty1"]))
    assert a < 0.3 <= b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_cases(spark, module):
    text = {toxicity: ["fine words here", "nasty words here"], quality: ["SHOUT!! SHOUT!! ||| ###", "A plain sentence, and then another one."]}[module]
    rows = [(i, text[i % 2] + f" w{i % 7}", "en", "x", 1.0) for i in range(200)] + [(900, None, "en", "x", 1.0), (901, "", None, "x", 1.0), (None, text[1], "en", "x", 1.0), (5, text[1], "xx", "x", 1.0), (902, "z" * 200000, "en", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, stats double")
    name = {toxicity: "toxic", quality: "quality"}[module]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None)], f"doc_id long, {name} int")
    model = module.fit_on(docs, labels)
    got = module.score_texts(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.3) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 200 and r.lang == "en"]
    assert np.mean(right) > 0.95
    assert module.score_texts(docs.limit(0), model).count() == 0
    for empty in (labels.limit(0), labels.filter(f"{name} = 1")):
        constant = module.fit_on(docs, empty)
        assert len({r.score for r in module.score_texts(docs, constant).collect()}) == 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_models_are_learned_off_the_driver(spark, sf, module, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fit = module.fit
    monkeypatch.setattr(module, "fit", lambda rows, counts: (os.getpid(), rows, counts, fit(rows, counts)))
    where, rows, counts, model = module.fit_on(docs, labels)
    name, folds, held_out = ("toxic", 4, 2) if module is toxicity else ("quality", 5, 0)
    assert where != os.getpid() and (rows, counts) == sample.labelled(docs, labels, name, folds, held_out, module.SAMPLE)
    data = bytes_of([r[0] for r in rows])
    assert np.allclose(model.score(*data), fit(rows, counts).score(*data), atol=1e-4)


def test_rules_are_the_same_in_spark_and_numpy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.rules or model.linear
    got = {r.doc_id: r.score for r in quality.score_texts(docs, model).collect()}
    rows = docs.collect()
    want = model.score(*bytes_of([r.text for r in rows]))
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-12)


def test_statistics_by_hand():
    s = dict(zip(quality.STATS, quality.statistics(*bytes_of(["Ab cd!\nAb cd!\nx"]))[0], strict=True))
    assert (s["log_words"], s["log_lines"]) == (np.log1p(5), np.log1p(3))
    assert s["distinct_words"] == 3 / 5 and s["repeated_lines"] == pytest.approx(1 / 3) and s["share_upper"] == 2 / 15


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows, counts = sample.labelled(docs, labels, "toxic", 4, 2, (100, 100))
    want = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(r[0] for r in rows) == sorted(f"t{i}" for i in want) and sum(counts) == len(want)
    assert len(sample.labelled(docs, labels, "toxic", 4, 2, (3, 2))[0]) == 5


def test_the_sample_holds_whole_texts_up_to_its_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (50_000 if i == 3 else 10), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows, _ = sample.labelled(docs, labels, "toxic", 4, 2, (100, 100))
    assert max(len(r[0]) for r in rows) == 50_000
    monkeypatch.setattr(sample, "SAMPLE_BYTES", 95)
    assert [len(r[0]) for r in sample.labelled(docs.filter("doc_id <> 3"), labels, "toxic", 4, 2, (100, 100))[0]] == [10] * 9


def test_words_do_not_cross_texts():
    data, offsets = bytes_of(["ab", "cd e", "", "f"])
    from tsloom.llm.textbytes import ALNUM

    starts, ends, rows = words(data, offsets, ALNUM)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"e", b"f"] and rows.tolist() == [0, 1, 3, 3, 4]


def test_queries(spark, sf):
    for module, folds, rest in ((toxicity, 4, 2), (quality, 5, 0)):
        for r in module.query(spark, sf).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) and r.predicted == (r.score >= 0.3)


def learnable(spark, sf, label, folds, rest):
    """The texts that may be learned from, by plain Python."""
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % folds != rest}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    return docs, sorted((r.text or "", r.lang, labels[r.doc_id]) for r in docs if labels.get(r.doc_id) is not None)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_toxicity_query_against_brute_force(spark, sf):
    """Word by word, filter by filter, in plain Python."""
    docs, want = learnable(spark, sf, "toxic", 4, 2)
    rows, counts = sample.labelled(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "toxic", 4, 2, toxicity.SAMPLE)
    assert sorted(rows) == want
    model = toxicity.fit(rows, counts)
    net = model.net
    got = {r.doc_id: (r.score, r.predicted, r.toxic) for r in toxicity.query(spark, sf).collect()}

    def bucket(raw):
        h = hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        return int(h[0]) >> 20 & toxicity.BUCKETS - 1

    def vector(word):
        cut = [word] + [word[:n] if len(word) >= n else None for n in (4, 6, 8)]
        return sum(e[bucket(c) if c else toxicity.BUCKETS] for e, c in zip(net.embed, cut, strict=True))

    for r in docs[:60]:
        found = [vector(w.encode()) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r.text))]
        padded = found + [np.zeros(toxicity.DIM)] * 3
        z = float(net.shift[0])
        for i, k in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                top = max(sum(float(padded[at + j] @ net.kernel[k][j][:, f]) for j in range(k)) for at in range(max(1, len(found))))
                z += max(0.0, top + float(net.bias[k][f])) * float(net.out[i * toxicity.FILTERS + f])
        a, b = net.platt
        score = 1 / (1 + np.exp(-(a * z + b)))
        assert abs(got[r.doc_id][0] - score) < 1e-4
        assert got[r.doc_id][1] == (got[r.doc_id][0] >= 0.3) and got[r.doc_id][2] == (got[r.doc_id][0] >= model.thresholds.get(r.lang, model.default))


def plain_statistics(text):
    raw = (text or "").encode()
    low = lowered(text).encode()
    classes = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t", "newline": b"\n\r\v\f", "stop": b".", "comma": b",;:", "shout": b"!?", "bar": b"|", "symbol": b"#$%&*@^~+=<>\\/_", "bracket": b"()[]{}\"'`-", "high": range(128, 256)}
    out = {f"share_{k}": sum(b in v for b in raw) / max(1, len(raw)) for k, v in classes.items()}
    found = [w for w in re.split(rb"[ \t-\r]+", low) if w]
    n = max(1, len(found))
    alnum = lambda b: 48 <= b < 58 or 97 <= b < 123 or b >= 128
    odd = [sum(not alnum(b) for b in w) for w in found]
    lines = [x for x in low.split(b"\n") if x]
    return out | {
        "log_words": np.log1p(len(found)), "word_bytes": sum(map(len, found)) / n, "distinct_words": len(set(found)) / n, "long_words": sum(len(w) > 20 for w in found) / n, "symbol_words": sum(o >= 2 for o in odd) / n,
        "bare_words": sum(o == 0 for o in odd) / n, "log_lines": np.log1p(len(lines)), "line_words": len(found) / max(1, len(lines)), "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "words_per_stop": len(found) / (1 + raw.count(b".")),
    }


def test_quality_query_against_brute_force(spark, sf):
    """Every statistic of every text, and the rules one by one, in plain Python."""
    docs, want = learnable(spark, sf, "quality", 5, 0)
    rows, counts = sample.labelled(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "quality", 5, 0, quality.SAMPLE)
    assert sorted(rows) == want
    model = quality.fit(rows, counts)
    odd = ["", None, "A\u00e9|| !?\n\nx.x\n A\u00e9|| !?\n", "w" * 30 + "\t#1"]
    got = quality.statistics(*bytes_of([r.text for r in docs] + odd))
    plain = [plain_statistics(t) for t in [r.text for r in docs] + odd]
    assert list(plain[0]) == list(quality.STATS)
    assert np.allclose(got, [list(p.values()) for p in plain], atol=1e-12)
    scores = {r.doc_id: r.score for r in quality.query(spark, sf).collect()}
    for r, s in zip(docs, plain, strict=False):
        x = list(s.values())
        z = model.bias + sum(w for rule, w in model.rules if all((x[f] > t) == above for f, above, t in rule)) + sum(w * min(max(x[f], lo), hi) for f, lo, hi, w in model.linear)
        assert abs(scores[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9
