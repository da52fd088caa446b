"""op3 takes ids as the library does by its defaults; op8, whose separator is an added token, as ordinary text."""

import pytest

from tests.llm import brute
from verdigris.llm import packing, token_counts, tokens

TEXTS = [
    "a <|endoftext|> b",
    "<|endoftext|>",
    "<|endoftext|><|endoftext|>x",
    " <|endoftext|>\n<|endoftext",
    "<|endoftext |> <|ENDOFTEXT|>",
    "é<|endoftext|>ü  <|endoftext|>  ",
    "it's<|endoftext|>'s 12<|endoftext|>34",
    "none here",
    "w " * 3000 + "<|endoftext|>" + " v" * 3000,
    "",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def test_packing_as_the_library(spark, library):
    want = []
    for i, text in enumerate(TEXTS):
        x = [*library.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for p, end in enumerate(range(len(x) % 2048 or 2048, len(x) + 1, 2048)):
            want.append((i, p, at, end - at, brute.crc(x[at:end])))
            at = end
    assert 50256 in library.encode(TEXTS[0], add_special_tokens=False).ids
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), 2048).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)


def test_counts_take_ordinary_text(spark):
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    plain = tokens.encoder(tokens.vocabulary())
    assert sorted(tuple(r) for r in got) == [(i, len(plain.encode_ordinary(t))) for i, t in enumerate(TEXTS)]
