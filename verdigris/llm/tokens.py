"""Token ids of whole texts by a public byte-level BPE vocabulary.

The ranks are read from the tokenizer file itself, and texts are encoded by tiktoken: with the same vocabulary, merges
and pattern its ids equal those of the `tokenizers` library (a test holds them against each other), at a third of the
time.  The file's added tokens, such as <|endoftext|>, are taken for their ids where they are asked for, as the library
does by its defaults; else their strings in a text are ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np


@cache
def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow
    from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str):
    """The encoder of a tokenizer file; one for each process."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space as the pattern means it, in runs of two and more; and how long a run is a piece of its own here.
_BLANKS = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
LONG = 100_000


def ids(path: str, text: str | None, added: bool = False) -> np.ndarray:
    """added: strings of added tokens are these tokens.  Very long words take time beyond proportion in merging, so
    nothing but the pattern and the added tokens cuts a text.  The pattern takes a run of white space as one piece, all
    of it at the end of what it reads (a text, or what stands before an added token), else all but its last character;
    its look-ahead overflows on very long runs, so those of LONG and more are cut out by this rule and merged alone."""
    e, text = encoder(path), text or ""

    def part(s: str) -> list[int]:
        return e.encode(s, allowed_special="all") if added else e.encode_ordinary(s)

    if len(text) < LONG:
        return np.array(part(text), np.uint32)
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        if m.end() - m.start() >= LONG:
            ends = m.end() == len(text) or (added and any(text.startswith(s, m.end()) for s in e.special_tokens_set))
            stop = m.end() if ends else m.end() - 1
            out += [part(text[at : m.start()]), e._encode_single_piece(text[m.start() : stop])]
            at = stop
    return np.array([i for ids_ in (*out, part(text[at:])) for i in ids_], np.uint32)
