import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import op8_bpe as m
from tests.llm import edge

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


ENCODER = m.Encoder(PATH)


def same(reference, texts):
    for text, mine, own in zip(texts, ENCODER.encode_batch(texts), reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.tolist() == own.ids, text
        assert ENCODER.decode(mine) == reference.decode(own.ids, skip_special_tokens=False)


def test_random_texts(reference):
    rng = random.Random(3)
    letters = "abcΑΣσςÉÉİıßǄ123½²٣'stDLl!?.,\x1c\x1d\x85  ​﻿　\n\t日本語한국👍🏽\x00<|>_-—"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [t[:5] + "<|endoftext|>" + t[5:] + "<|startoftext|>" for t in texts[:300]]
    same(reference, [*texts, "", "   ", "a" * 5000, "ab" * 300, "it's we'll I'D 's's", "x" * 64, "x" * 65])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    assert ENCODER.encode_batch([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_words_merge_the_same():
    word = b"therethehingandthiscation" * 2
    assert ENCODER.merge_many([word])[0].tolist() == ENCODER.merge_one(word).tolist()


def test_query(spark, reference):
    p = edge.by_id(m.op8_bpe_tokens(spark, "/root/testdata/sf0.001"))
    for row, text in zip(p.itertuples(), edge.by_id(edge.table(spark, "documents"))["text"], strict=True):
        own = reference.encode(text, add_special_tokens=False)
        assert row.n_tokens == len(own.ids)
        assert row.ids_sha256 == sha256(np.array(own.ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == sha256(reference.decode(own.ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark, reference):
    df = edge.docs(spark)
    out = m.token_digests(df)
    assert out.columns == [*df.columns, "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(edge.ROWS)
    assert {r["n_tokens"] for r in out.filter("text is null or text = ''").collect()} == {0}
    both = m.decode_ids(m.encode_texts(df)).collect()
    for r in both:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == reference.decode(ids, skip_special_tokens=False)
    assert m.token_digests(edge.empty(spark)).count() == 0
