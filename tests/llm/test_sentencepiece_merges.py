import random

import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

from tsloom.llm import sentencepiece_viterbi as S

ODD = ["", " ", "  two  blanks ", "a", "\n\n x\ty", "café naïve über", "你好世界" * 30, "x" * 500, "ab" * 200 + " end", "\U0001f600 emoji \U0001f600\U0001f600", "é", "nul\x00byte", "<s> </s> <0x41>", "   " * 40, "Internationalisation" * 30]


def test_merge_order_equal_to_the_library():
    model, library = S.load(), sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("ab eth ing\né你 ") for _ in range(rng.randint(1, 60))) for _ in range(300))]
    assert S.encode_as_trained(model, pa.array(texts)).to_pylist() == library.encode(texts)


def test_query_equal_to_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    texts = {i: t for i, t in zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True)}
    rows = S.query(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.exact and r.ids == library.encode(texts[r.doc_id]) for r in rows)
