"""Each stage of the pipeline, and all of them in a row, against plain versions."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute
from verdigris.llm import packing, secret_scan, tokens

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def kept_by_quality(text):
    n_words, _, n_symbols, _, n_repeat = brute.quality(text)
    return n_words >= 50 and 100 * n_repeat <= 50 * n_words and 100 * n_symbols <= 30 * n_words


def redacted(text):
    """Stretches of spans, each replaced by the kind of its first span."""
    spans = sorted(brute.secrets(text), key=lambda x: (x[1], -x[2]))
    out, end = "", 0
    for kind, s, e in spans:
        if s >= end:
            out += text[end:s] + f"[{kind}]"
        end = max(end, e)
    return out + text[end:]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def expected(rows):
    """Rows after quality, near_duplicates and secrets."""
    rows = [r for r in rows if kept_by_quality(r[1])]
    groups = brute.components([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
    best = {}
    for i, r in enumerate(rows):
        best[groups[i][1]] = min(best.get(groups[i][1], (True, 0, 0)), (r[0] is None, r[0] or 0, i))
    rows = [rows[i] for _, _, i in best.values()]
    return [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in rows]


def test_first_stages(spark, docs):
    mine = [s for s in rows_of(docs) if not any(x[0] not in secret_scan.BASE for x in secret_scan.Scanner()(s[1] or ""))]
    out = spark.createDataFrame(mine, NAMES).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert sorted(rows_of(out), key=str) == sorted(expected(mine), key=str)


def test_mix_stage(spark, docs):
    out = corpus_pipeline.mix(spark, docs, SF)
    words = {r[0]: brute.WORD.findall(r[1] or "") for r in rows_of(docs)}
    times = Counter()
    for r in rows_of(out):
        mine = brute.WORD.findall(r[1])
        assert r[4] == len(r[1]) and mine and not Counter(mine) - Counter(words[r[0]])
        times[r[0]] += len(mine)
    assert all(n <= 3 * len(words[i]) for i, n in times.items())


def test_pack_stage(spark, docs):
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    held = Counter()
    for r in rows:
        held[r["doc_id"]] += r["length"]
    assert held == {r[0]: len(tokens.ids(tokens.vocabulary(), r[1], added=True)) + 1 for r in rows_of(docs)}
    bins = Counter()
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= packing.lower_bound([r["length"] for r in rows], 2048) * 1.02 + 1


def test_run(spark):
    """All stages: what is packed is the text of the mix, whose words are those of the documents that stay."""
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    stays = {r[0] for r in expected(docs)}
    assert rows and {r["doc_id"] for r in rows} <= stays
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    # the mix has about as many words as what stays
    size = sum(len(re.findall(brute.WORD, r[1])) for r in expected(docs))
    total = sum(r["length"] for r in rows)
    assert size * 0.9 < total < size * 4


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, long and empty texts, repeated rows, and an empty table."""
    text = " ".join(f"w{i}" for i in range(80))
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, text, None, None, None), (1, text, None, None, None), (None, text + " more", "en", "a", 5), (2, " ".join(f"v{i}" for i in range(60_000)), "en", "a", 5), (3, "é" * 100_000, "en", "a", 5), (4, text.replace("w", "u") + " token=abcdefghijklmnop", "en", "b", 1)]
    for name, rows in (("odd", odd), ("none", [])):
        spark.createDataFrame(rows, NAMES).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} == ({1, 2, 4} if rows else set())
