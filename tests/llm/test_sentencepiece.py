import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tsloom.llm import sentencepiece_viterbi as S


@pytest.fixture(scope="module")
def model():
    return S.load()


def message(*items):
    """A protocol buffer message of (number, value) fields."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in items:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram(seed):
    """A made-up unigram model: every character of its alphabet and some longer pieces, with byte pieces."""
    rng = random.Random(seed)
    letters = ["▁", *"abcdeé你"]
    more = {("▁" if rng.random() < 0.3 else "") + "".join(rng.choice(letters[1:]) for _ in range(rng.randint(2, 5))) for _ in range(120)}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((x, -rng.uniform(3, 12), 1) for x in [*letters, *sorted(more)])]
    trainer = message((3, 1), (4, len(pieces)), (35, 1))
    normalizer = message((1, b"identity"), (3, 1), (4, 0), (5, 1))
    return message(*((1, message((1, x.encode()), (2, v), (3, k))) for x, v, k in pieces), (2, trainer), (3, normalizer))


def brute(model, text):
    """Plain Viterbi over the whole text."""
    raw = ("▁" + text.replace(" ", "▁")).encode() if text else b""
    pieces = {}
    flat = {int(i): model.out_bytes[model.out_first[i] : model.out_first[i] + model.out_sizes[i]].tobytes().replace(b" ", "▁".encode()) for i in model.ids}
    for i, s in zip(model.ids.tolist(), model.score.tolist(), strict=True):
        pieces[flat[i]] = (i, s)
    best = [None] * (len(raw) + 1)
    best[0] = (0.0, 0, ())
    for e in range(1, len(raw) + 1):
        for s in range(max(0, e - model.longest), e):
            if best[s] is None:
                continue
            part = raw[s:e]
            if part in pieces:
                i, v = pieces[part]
                got = (best[s][0] + v, s, (i,))
            else:
                try:
                    if len(part.decode()) != 1:
                        continue
                except UnicodeDecodeError:
                    continue
                got = (best[s][0] + model.unknown_score, s, tuple(model.byte_id[list(part)].tolist()))
            if best[e] is None or got[0] > best[e][0]:
                best[e] = got
    out, at = [], len(raw)
    while at:
        out[:0] = best[at][2]
        at = best[at][1]
    return out


ODD = ["", " ", "  two  blanks ", "a", "\n\n x\ty", "café naïve über", "你好世界" * 30, "x" * 500, "ab" * 200 + " end", "\U0001f600 emoji \U0001f600\U0001f600", "é", "▁mark", "nul\x00byte", "<s> </s> <0x41>", "   " * 40]


def test_equal_to_plain_viterbi(model):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("ab eth ing\né你 ") for _ in range(rng.randint(1, 60))) for _ in range(150))]
    got = S.encode(model, pa.array(texts)).to_pylist()
    for t, g in zip(texts, got, strict=True):
        if len(t) < 600:
            assert g == brute(model, t), t
    assert S.decode(model, pa.array(got, pa.list_(pa.int32()))).to_pylist() == [t.replace("▁", " ") for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_library_on_unigram_models(seed):
    raw, rng = unigram(seed), random.Random(seed)
    model, library = S.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["".join(rng.choice("aabbccddeeé你  z\n") for _ in range(rng.randint(0, 150))) for _ in range(400)]
    got = S.encode(model, pa.array(texts)).to_pylist()
    want = library.encode(texts)
    total = lambda ids: sum(library.get_score(i) for i in ids)
    assert all(g == w or abs(total(g) - total(w)) < 1e-4 for g, w in zip(got, want, strict=True))  # a tie, as in "aaa"
    assert S.decode(model, pa.array(got, pa.list_(pa.int32()))).to_pylist() == texts == library.decode(got)


def test_edge_cases(spark, model):
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD, "word " * 40000, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: (r.ids, r.decoded) for r in S.decode_ids(S.encode_texts(df, model), model).collect()}
    assert got[0] == (None, None) and got[1] == ([], "")
    assert all(got[i][1] == t.replace("▁", " ") for i, t, _ in rows if t is not None)
    assert S.encode_texts(df.limit(0), model).count() == 0
    assert S.decode(model, pa.array([[1, 2, 99999, -5], None], pa.list_(pa.int32()))).to_pylist() == ["", None]


def test_query(spark, sf):
    rows = S.query(spark, sf).collect()
    assert all(r.exact and len(r.ids) == r.n_tokens for r in rows)
    assert np.mean([r.n_tokens for r in rows]) > 100
