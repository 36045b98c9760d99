import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtime.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def own():
    return tokens.Encoder(tokens.VOCABULARY, 500)


def encode(own, texts):
    offsets, ids = own.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=5))
def test_any_text(own, reference, texts):
    assert encode(own, texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(own, reference):
    r = random.Random(0)
    hard = ["", "a" * 20_000, " " * 9_000, "-" * 3_000 + "x", "\r\n\t \n", "don't WE'LL 'S", "<|endoftext|>", "é é", "日本語テキスト", "🚲🧪‍🔬", "\x1c\x85　x", "x  y", "ab" * 5000, "İıſ"]
    hard += ["".join(r.choice("ab  \n'tsx9²-_=é日") for _ in range(200)) for _ in range(200)]
    assert encode(own, hard) == [e.ids for e in reference.encode_batch(hard, add_special_tokens=False)]


def test_every_token_alone(own):
    v = own.vocabulary
    text = [(b, i) for b, i in v.ids.items() if b.isascii() and b.isalpha()]
    got = v.encode_words([b.decode() for b, _ in text])
    assert all(got[b.decode()] == [i] for b, i in text if v.stands(i))
    assert all(b"".join(next(k for k, j in v.ids.items() if j == t) for t in got[b.decode()]) == b for b, _ in text[:50])


def test_frame(spark, reference):
    rows = [(1, "Hello there", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "Hello there", 0), (5, "z" * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = tokens.encode_corpus(df).toPandas()
    assert len(out) == 6 and out.dtypes.index.tolist() == ["doc_id", "ids"]
    for doc, text in ((1, "Hello there"), (2, ""), (3, ""), (5, "z" * 50_000)):
        for ids in out[out.doc_id == doc].ids:
            assert list(ids) == reference.encode(text, add_special_tokens=False).ids
    assert tokens.encode_corpus(df.limit(0)).count() == 0
