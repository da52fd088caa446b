"""Predictions against a plain cross-parse of whole texts, whatever their length."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import language_id


def folded(text):
    out = []
    for c in text:
        low = c.lower()
        out.append((low if len(low) == 1 else c) if c.isalpha() else " ")
    return "".join(out)


def phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        if text[i] in sample:
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
        n, i = n + 1, j
    return n


def plain(text, samples):
    """(lang, score) of the least phrases * log2(sample) / length, ties by name."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    found = sorted((phrases(folded(text), s) * math.log2(max(2, len(s))) / len(text), lang) for lang, s in samples.items())
    return found[0][1], 1 - found[0][0] / max(found[1][0], 1e-12) if len(found) > 1 else 1.0


def sample_text(samples):
    return {lang: folded("\n".join(texts))[: language_id.SAMPLE_CHARS] for lang, texts in samples.items()}


@pytest.mark.parametrize("segment,rows", [(256, 4096), (8, 5), (3, 2), (64, 1)])
def test_predictions(monkeypatch, segment, rows):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    monkeypatch.setattr(language_id, "ROWS", rows)
    rng = random.Random(segment)
    samples = {"a": ["".join(rng.choice("abc d") for _ in range(400))], "b": ["bca" * 90, "É"], "c": ["ab" * 200], "d": ["日本語のテキスト" * 9]}
    model, known = language_id.Model(samples), sample_text(samples)
    texts = ["", " \n", "Zz", "x", "ab" * 700, "a" * 900, "bca" * 400, "bcA" * 30 + "x" + "ab" * 150, "日本" * 80 + "語の", "É é 5"]
    texts += ["".join(rng.choice("abcxyZ é日") for _ in range(rng.randint(1, 900))) for _ in range(40)]
    texts += [samples["a"][0][i : i + rng.randint(1, 300)] for i in range(0, 300, 10)]
    langs, score = model.predict(texts)
    for text, lang, s in zip(texts, langs, score, strict=True):
        want = plain(text, known)
        assert lang == want[0] and s == pytest.approx(want[1], abs=1e-9), text


def test_ties_go_by_name():
    model = language_id.Model({"y": ["abc"], "x": ["abc"]})
    assert model.predict(["abcabc"])[0] == ["x"] and model.predict(["abcabc"])[1][0] == 0.0


def test_wide_alphabets_stay_small():
    rng = np.random.default_rng(0)
    sample = "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 3000, language_id.SAMPLE_CHARS))
    model = language_id.Model({"zh": [sample], "en": ["some words and others " * 500]})
    assert all(sum(x.nbytes for x in (p.base, p.owner, p.to, p.first)) < 1 << 20 for p in model.parsers)
    assert model.predict([sample[100:400], "others and some"])[0] == ["zh", "en"]


def test_fit(spark):
    rows = [(i, "abc " * 10 + str(i), "x") for i in range(200)] + [(7, "repeated " * 3, "y")] * 5000 + [(9, None, "z"), (10, "", "z"), (11, "text", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["x", "y"]
    long = spark.createDataFrame([(1, "u" * 500_000, "l"), (2, "v" * 500, "l")], "doc_id long, text string, lang string")
    assert language_id.fit(long).predict(["uuuu", "vvvv"])[0] == ["l", "l"]
    # no text fills the sample alone
    both = language_id.fit(long.union(spark.createDataFrame([(3, "w" * 50, "m")], "doc_id long, text string, lang string")))
    assert both.bits[0] == math.log2(750 + 1 + 500)
    many = spark.range(300).select("id", F.lit("some").alias("text"), F.concat(F.lit("l"), "id").alias("lang")).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(many)
