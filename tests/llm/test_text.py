"""Vectorised word hashing against plain splitting."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests_words import words
from waneline.llm import text as T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1cé€", max_size=30)), max_size=6))
def test_words_are_those_of_a_plain_split(docs):
    data, off = T.buffer(pa.array(docs, pa.string()))
    w = T.words(data, off)
    got = [[bytes(data[s:e]).decode() for s, e in zip(w.start[a:z], w.end[a:z], strict=True)] for a, z in zip(w.first, w.first[1:], strict=False)]
    assert got == [words(d) for d in docs]
    by = {}
    for s, e, h in zip(w.start, w.end, w.hash, strict=True):
        assert by.setdefault(bytes(data[s:e]), h) == h
    assert len(set(by.values())) == len(by)


def test_windows_agree_wherever_they_stand():
    h = T.mix(np.arange(1, 50, dtype=np.uint64))
    twice = np.concatenate([h, h])
    assert (T.windows(twice, 7)[:43] == T.windows(twice, 7)[49:92]).all() and len(set(T.windows(h, 7).tolist())) == 43


def test_slices_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 100, "", "z"])], ["text"])
    assert [t for s in T.slices(b, most=12) for t in s.column("text").to_pylist()] == b.column("text").to_pylist()
