"""Hashes of words and lines tell texts apart that a polynomial modulo 2^64 does not."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from verdigris.llm import byte_text, jaccard_join, quality_rules, shingles


def thue_morse(n, one="a", other="b"):
    return "".join((one, other)[i.bit_count() % 2] for i in range(n)), "".join((other, one)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192, 70_000])
def test_lines_and_words(n):
    a, b = thue_morse(n)
    texts = [f"{a}\n{b}\n", f"{a} x y {b} x y {a} x y", f"{a}", f"{b}", "\n".join([a, b, a])]
    m = byte_text.measures(pa.array(texts))
    assert [tuple(int(m[k][i]) for k in quality_rules.MEASURES) for i in range(len(texts))] == [brute.quality(t) for t in texts]
    h, sizes = shingles.shingle_sets(pa.array([a, b, a.upper()]), 4)
    assert sizes.tolist() == [1, 1, 1] and h[0] != h[1] and h[0] == h[2]


def test_steps_cut_runs(monkeypatch):
    """A word longer than a step has the hash that one step gives it."""
    texts = pa.array(["x" * 500 + " yz " + "w" * 33, None, "", " ", "é" * 9, *("ab" * i for i in range(30))])
    whole = shingles.word_hashes(texts)
    for step in (1, 7, 64):
        monkeypatch.setattr(shingles, "_STEP", step)
        cut = shingles.word_hashes(texts)
        assert all(np.array_equal(x, y) for x, y in zip(whole, cut, strict=True))


def test_short_runs_differ():
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abc ".strip() + "\0", repeat=n)]
    h, n = shingles.word_hashes(pa.array(words))
    assert n.tolist() == [1] * len(words) and len(set(h.tolist())) == len(words)


def test_no_false_link(spark):
    a, b = thue_morse(1024)
    rows = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(rows, 4, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
