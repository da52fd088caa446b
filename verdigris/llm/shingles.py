"""Word shingles of whole texts as 64-bit hashes, computed with numpy over Arrow string buffers.

A word is a run of bytes other than space and 0x09-0x0D (all ASCII, so no multi-byte character is cut); A-Z are
lower-cased.  A text's set holds its distinct k-word shingles; with fewer than k words, the whole sequence counts as
one; without words (or null) the set is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_P))


def _factors(place: np.ndarray) -> np.ndarray:
    """The factor of each place in a run: pseudorandom and odd, so that no pattern of bytes cancels another."""
    return mix((place.astype(_U) + _U(1)) * _U(_P)) | _U(1)


_FACTOR = _factors(np.arange(1 << 12))


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def hashes_of_runs(buf: np.ndarray, at: np.ndarray, sep: np.ndarray, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each run of bytes between separators and the ends of texts, in order.  A hash is the sum of
    its bytes' numbers, each times the factor of its place in the run, and the length, mixed.  Works in steps of about a
    megabyte, so that temporary arrays stay small whatever a text's length; a run may go on over many steps."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    inside = ~sep
    starts = np.flatnonzero(inside & (edge[:-1] | np.r_[True, sep[:-1]][: len(buf)]))
    ends = np.flatnonzero(inside & (edge[1:] | np.r_[sep[1:], True][: len(buf)])) + 1
    out = np.zeros(len(starts), _U)
    for lo in range(0, len(buf), _STEP):
        here = np.flatnonzero(inside[lo : lo + _STEP]) + lo
        if not len(here):
            continue
        a, b = np.searchsorted(ends, here[0], "right"), np.searchsorted(starts, here[-1], "right")
        s, e = starts[a:b], ends[a:b]
        size = np.minimum(e, lo + _STEP) - np.maximum(s, lo)
        place = here - np.repeat(s, size)
        factor = _FACTOR[place] if place.max() < len(_FACTOR) else _factors(place)
        total = np.r_[_U(0), np.add.accumulate(table[buf[here]] * factor)]
        cut = np.r_[0, np.cumsum(size)]
        out[a:b] += total[cut[1:]] - total[cut[:-1]]
    return mix(out + (ends - starts).astype(_U)), starts, ends


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, in order; number of words of each text)."""
    buf, at = string_buffer(texts)
    h, starts, _ = hashes_of_runs(buf, at, _SEP[buf], _BYTE[_LOWER])
    return h, np.diff(np.searchsorted(starts, at, "left"))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the texts' shingle sets, one text after another, ascending within a text; sizes of the sets)."""
    words, n = word_hashes(texts)
    if not len(words):
        return words, n
    at = np.r_[0, np.cumsum(n)[:-1]]
    have = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), have)
    pos = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(have)[:-1]], have) + np.repeat(at, have)
    length = np.minimum(n, k)[row]
    h = length.astype(_U)
    for j in range(k):
        inside = j < length
        nxt = mix(h * _U(_P) + words[np.minimum(pos + j, len(words) - 1)])
        h = nxt if inside.all() else np.where(inside, nxt, h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
    return h[new], np.bincount(row[new], minlength=len(n))
