"""Measures of whole texts, with numpy over Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from verdigris.llm.shingles import _SEP, hashes_of_runs, mix, string_buffer

_U = np.uint64
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sum of marks (one for each byte) in each text."""
    total = np.r_[0, np.cumsum(marks, dtype=np.int64)]
    return total[at[1:]] - total[at[:-1]]


def _earlier(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether an item's equal came before it in its text."""
    order = np.lexsort((h, doc))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
    out = np.zeros(len(h), bool)
    out[order] = same
    return out


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; a null is an empty text."""
    buf, at = string_buffer(texts)
    size = len(at) - 1
    sep = _SEP[buf]
    out = {"word_chars": _per_text(at, ~sep & ((buf & 0xC0) != 0x80)), "n_symbols": _per_text(at, _SYMBOL[buf])}
    words, starts, _ = hashes_of_runs(buf, at, sep)
    n = np.diff(np.searchsorted(starts, at, "left"))
    out["n_words"] = n
    # windows of three words
    doc = np.repeat(np.arange(size), n)
    repeat = np.zeros(len(words) + 3, bool)
    if len(words) > 2:
        p = np.flatnonzero(doc[2:] == doc[:-2])
        h = mix(mix(words[p] + _U(1)) * _U(3) + mix(words[p + 1] + _U(2)) * _U(5) + words[p + 2])
        order = np.lexsort((h, doc[p]))
        same = (h[order][1:] == h[order][:-1]) & (doc[p][order][1:] == doc[p][order][:-1])
        twice = np.zeros(len(p), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same] if len(p) else twice
        for j in range(3):
            repeat[p[twice] + j] = True
    out["n_repeat_words"] = np.bincount(doc, weights=repeat[: len(words)], minlength=size).astype(np.int64)
    # lines: their whole bytes, between line feeds and the ends of texts
    lines, starts, ends = hashes_of_runs(buf, at, buf == 10)
    has = np.r_[0, np.cumsum(~sep)]
    full = has[ends] > has[starts]
    doc = np.searchsorted(at, starts[full], "right") - 1
    out["n_dup_lines"] = np.bincount(doc, weights=_earlier(doc, lines[full]), minlength=size).astype(np.int64)
    return out
