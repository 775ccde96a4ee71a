import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm.common import components
from linkloom.llm.words import rolled, slices, spans_hash, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\r\x0b \u00a0.", max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_the_pattern_s(texts):
    w = words_of(pa.array(texts, pa.string()))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]])] for d in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_and_windows_have_equal_hashes():
    w = words_of(pa.array(["the cat sat on the cat sat", None, "", "cat sat on"]))
    words = [bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends)]
    assert len({(a, b) for a, b in zip(words, w.hash.tolist())}) == len(set(words)) == len(set(w.hash.tolist()))
    r = rolled(w.hash, 3)
    assert r[1] == r[7] and r[0] != r[1]
    s = spans_hash(w.hash, np.array([1, 7, 0]), np.array([4, 10, 3]))
    assert s[0] == s[1] != s[2]


def test_slices_cover_long_and_short_rows():
    a = pa.array(["x" * 3_000_000, "y", None, "z" * 10])
    assert [r for i, j in slices(a) for r in range(i, j)] == [0, 1, 2, 3]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7), (4, 1)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 201 + i) for i in range(25)]
    got = dict(components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and 7 not in got
    assert {got[100 + i] for i in range(60)} == {100} and {got[200 + i] for i in range(26)} == {200}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
