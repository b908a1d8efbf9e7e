"""Ids and sequences of the packing operator against the tokenizer itself."""

import random

import pyarrow as pa
import pytest

from waneline.llm import packing

ODD = [*"İ.,aBßΣς1٣½Ⅷ한éﬁ😀-'ǆA!?;:Z", "́", "̇", "ͅ", " ", " ", "\x1c", "\x1f", "\x85", "​", "﻿", " ", "ᄀ", "ᅡ", "é"]
ODD += [" ", "\n", "\t", "\r", "\x0b", "\x0c", "'s", "'T", "<|endoftext|>", "<|ENDOFTEXT|>", "<|start", "|", "Grüße", "naïve", "don't"]


@pytest.fixture(scope="module")
def tokens():
    return packing.tokens(packing.vocabulary_path())


def check(tokens, texts):
    for text, got in zip(texts, tokens.encode(pa.array(texts, pa.string())), strict=True):
        assert got.tolist() == tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_ids_of_odd_texts(tokens):
    check(tokens, ["DENİZLİ.", "Merhaba İ, x", None, "", " ", "i̇.", "a.́b", "x,,y", "A1B2", "<|endoftext|>", "<|ENDOFTEXT|> X"])
    draw = random.Random(11)
    check(tokens, ["".join(draw.choice(ODD) for _ in range(draw.randrange(40))) for _ in range(8000)])


def test_ids_of_whole_documents_and_of_a_small_cache(tokens, texts, monkeypatch):
    check(tokens, list(texts.values()))
    monkeypatch.setattr(packing, "CACHE_WORDS", 500)
    own = packing.Tokens(packing.vocabulary_path())
    some = list(texts.values())[:300]
    for at in range(0, len(some), 7):
        check(own, some[at : at + 7])


def test_the_score_uses_documents_and_cost():
    import numpy as np

    length = np.array([900, 300, 300, 100])
    tokens_only = packing.best_fit(length, 1024, weights=(1.0, 0.0, 0.0))
    spread = packing.best_fit(length, 1024, max_docs=4, weights=(0.0, 1.0, 0.0))
    assert len(set(tokens_only)) == len(set(spread)) == 2 and tokens_only.tolist() != spread.tolist()
