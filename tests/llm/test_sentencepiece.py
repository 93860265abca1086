import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from lorewright.llm import sentencepiece as sp

LIB = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
CODEC = sp.codec()
TEXT = st.text(alphabet=st.sampled_from(list("ab  ▁\n\tthe ing HWlöd½🙂漢字é　x.,'-0123\x00")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encode_equals_library(text):
    assert CODEC.encode(text) == LIB.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=12))
def test_batch(texts):
    offsets, ids = CODEC.encode_batch(pa.array(texts, pa.string()))
    rows = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert rows == LIB.encode(texts) if texts else rows == []
    assert CODEC.decode_batch(offsets, ids).to_pylist() == (LIB.decode(rows) if texts else [])


def test_cut_equals_merging():
    r = random.Random(1)
    for _ in range(2000):
        word = sp.SPACE + "".join(r.choice("theringaoudsxyz") for _ in range(r.randint(1, 14)))
        assert CODEC.cut(word) == [CODEC.id[p] for p in CODEC.merge(word)]


def test_long_runs():
    for text in (" " * 1000, "a" * 3000, "aab" * 700, "x" + " " * 40 + "y"):
        assert CODEC.encode(text) == LIB.encode(text)


def test_documents(docs):
    texts = ["Hello world", "", None, "two  blanks ", "literal ▁ here", "x " * 100_000, "Hello world"]
    got = sorted(sp.encode_documents(docs(*texts)).collect(), key=lambda r: r.doc_id)
    for r, text in zip(got, texts):
        assert (r.token_ids, r.n_tokens) == ((None, None) if text is None else (LIB.encode(text), len(LIB.encode(text))))
    assert [r.round_trip for r in got] == [True, True, None, True, False, True, True]
    assert sp.encode_documents(docs().limit(0)).count() == 0


def test_decode(docs):
    texts = ["Hello wörld", "", None, " a\nb", "🙂"]
    encoded = sp.encode_documents(docs(*texts))
    assert {r.doc_id: r.text for r in sp.decode_tokens(encoded).collect()} == dict(enumerate(texts))



def test_bytes_that_are_no_text():
    ids = np.array([CODEC.byte[0xFF], CODEC.byte[0x41]], np.int32)
    assert CODEC.decode_batch(np.array([0, 2]), ids).to_pylist() == ["�A"]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m"
    path.write_bytes(bytes([18, 2, 24, 1]))
    with pytest.raises(ValueError):
        sp.Codec(str(path))


def test_clashing_columns(clashing):
    from pyspark.sql import functions as F

    assert sp.encode_documents(clashing("a b").withColumn("token_ids", F.lit(1))).first().n_tokens == 2
