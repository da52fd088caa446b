"""Very long texts: ids against the library, time of scans, and the queries over whole tables of them."""

import random
import time

import pytest
from tokenizers import Tokenizer

from verdigris.llm import pii, queries, tokens

PATH = tokens.vocabulary()


@pytest.mark.parametrize("blank", [" ", "\n", " ", "　", " \n"])
@pytest.mark.parametrize("n", [tokens.LONG - 1, tokens.LONG, 1_200_000])
def test_ids_of_blanks(blank, n):
    plain = Tokenizer.from_file(PATH)
    run = (blank * n)[:n]
    for text in (run, f"a{run}b", f"word {run}'s{run}.", f"{run}<|endoftext|>{run}x", f"1{run} é"):
        assert tokens.ids(PATH, text, added=True).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_five_million_blanks():
    text = " " * 5_000_000 + "end"
    assert tokens.ids(PATH, text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_spans_in_linear_time():
    text = "call 555-123-4567 or +49 30 1234567, " * 30_000
    began = time.time()
    found = pii.find(text)
    assert sum(k == "phone" for k, *_ in found) == 30_000 and sum(k == "local" for k, *_ in found) == 30_000
    assert time.time() - began < 10


def test_numbers_apart():
    rng = random.Random(1)
    for _ in range(300):
        def some(kind, n):
            return [(kind, s, s + rng.randint(1, 12)) for s in sorted(rng.sample(range(80), n))]

        spans, numbers = some("ip", rng.randint(0, 6)), some("local", 8)
        assert pii._apart(numbers, spans) == [n for n in numbers if not any(s < n[2] and n[1] < e for _, s, e in spans)]


NAMES = sorted(n for n in queries.QUERIES if not n.startswith(("op1_", "op12_")))


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, tmp_path_factory, name):
    d = tmp_path_factory.mktemp("long")
    texts = [" " * 1_500_000, "\n" * 1_500_000, "x" * 300_000, "7" * 300_000, "ein Wort und noch eines " * 20_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{d}/documents.parquet")
    got = queries.QUERIES[name](spark, str(d)).collect()
    assert got or name.startswith("op13_")
    if "doc_id" in (got[0].asDict() if got else {}):
        assert {r["doc_id"] for r in got} == set(range(5))
