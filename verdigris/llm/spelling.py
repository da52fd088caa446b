"""Spelling variants of a corpus's words, by full neighbourhood generation.

Words are counted over whole texts; then every word emits all distinct strings that one deletion, replacement or
insertion over the observed alphabet makes of it, as 64-bit keys, and these meet the vocabulary by an equi-join, before
which a map of the vocabulary's keys, of fixed size, leaves out most of those that meet nothing; of those
that meet, the string is made and must be the vocabulary's.  It is a near word by construction, so no distance is ever
computed.  The alphabet has at most 90 letters
(a to z and U+00C0 to U+00FF), so a word of L letters has at most L + 90 L + 91 (L + 1) candidates.

Null and empty texts have no words; a null id is written as nothing before the colon; repeated rows count again.  Of ties
the smallest word in code-point order is taken.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.plans.scratch import Scratch, bounded

#: Words so few that a vocabulary of them may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Words whose candidates one task makes.
TASK_WORDS = 2_000
#: Distinct words, or keys of candidates, that a task holds before it hands them on.
HELD = 200_000


def _letters() -> bytes:
    """Latin-1 bytes: letters stand for themselves, A to Z in lower case, all else is a blank."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


_LETTERS = _letters()


def runs(text: str) -> list[bytes]:
    """Lower-cased maximal runs of letters, as Latin-1: what Latin-1 lacks is no letter."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def noted(doc_id: object, run: bytes) -> bytes:
    """The word that a run of a document counts as: every 97th of these keys drops one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run.decode('latin-1')}".encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """docs: doc_id, text.  (word, n) of words with so many code points and occurrences.  Tasks add up what they read,
    and hand on at most HELD distinct words at a time and those of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for r, n in Counter(runs(text.as_py() or "")).items():
                    if len(r) >= least_chars and len(w := noted(doc_id, r)) >= least_chars:
                        held[w] += n
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


#: Keys of words are polynomials mod 2^64 in BASE, an odd number, over pseudorandom values of the letters.
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 2**64) for i in range(n)], np.uint64)


def _sums(letters: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """letters: words of one length as rows of Latin-1.  Keys of all beginnings, from the empty one to the whole word."""
    k, n = letters.shape
    out = np.zeros((k, n + 1), np.uint64)
    np.cumsum(_VALUES[letters] * powers[:n], axis=1, out=out[:, 1:])
    return out


def _rows(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words by length: their places, and their letters as rows."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        yield at, np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(-1, n)


def neighbour_keys(letters: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all deletions, then replacements, then insertions, the latter two by place and letter, of words of one
    length; and which of them to leave out, so that each string but the word comes once: of deletions and insertions
    that make the same string the first is kept."""
    k, n = letters.shape
    powers = _powers(n + 1)
    upto = _sums(letters, powers)
    after = upto[:, -1:] - upto
    put = _VALUES[alphabet][None, None, :] * powers[None, :, None]
    deleted = upto[:, :-1] + after[:, 1:] * _U(pow(_BASE, -1, 2**64))
    replaced = (upto[:, :-1] + after[:, 1:])[:, :, None] + put[:, :-1]
    inserted = (upto + after * _U(_BASE))[:, :, None] + put
    same = letters[:, :, None] == alphabet
    again = np.zeros((k, n), bool)
    again[:, 1:] = letters[:, 1:] == letters[:, :-1]
    # a letter put behind its like makes what it makes before it
    behind = np.concatenate([np.zeros((k, 1, len(alphabet)), bool), same], axis=1)
    keys = np.concatenate([deleted, replaced.reshape(k, -1), inserted.reshape(k, -1)], axis=1)
    return keys.view(np.int64), np.concatenate([again, same.reshape(k, -1), behind.reshape(k, -1)], axis=1)


def keyed(words: DataFrame) -> DataFrame:
    """words: word, n.  Adds key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for at, letters in _rows(batch.column(0).to_pylist()):
                out[at] = _sums(letters, _powers(letters.shape[1] + 1))[:, -1].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")


#: 64-bit parts of the map of the vocabulary's keys: 16 MB, however large the vocabulary is.
MAP_PARTS = 1 << 21


def key_map(words: DataFrame) -> np.ndarray:
    """words: key.  A bit for each value of a key's first 27 bits, set if a word's key begins so.  Spark folds the bits,
    and at most MAP_PARTS rows come to the driver."""
    part = F.shiftrightunsigned("key", 43)
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 37) & 63 as int))")
    folded = words.groupBy(part.alias("part")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(MAP_PARTS, np.uint64)
    out[folded.column("part").to_numpy()] = folded.column("bits").to_numpy().view(np.uint64)
    return out


def candidates(words: DataFrame, alphabet: str, seen: Broadcast) -> DataFrame:
    """words: word, n.  (word, n, change, key): which change makes a candidate, and its key.  Every candidate of every word
    is made once; those whose key begins as no word's does can meet none in the join, and are left out before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters_of, bits = np.frombuffer(alphabet.encode("latin-1"), np.uint8), seen.value
        for batch in batches:
            for places, letters in _rows(batch.column(0).to_pylist()):
                width = letters.shape[1] + (2 * letters.shape[1] + 1) * len(letters_of)
                step = max(1, HELD // width)
                for i in range(0, len(places), step):
                    keys, out = neighbour_keys(letters[i : i + step], letters_of)
                    first = keys.view(np.uint64) >> _U(37)
                    met = (bits[first >> _U(6)] >> (first & _U(63)) & _U(1)).astype(bool)
                    row, change = np.nonzero(met & ~out)
                    part = batch.take(pa.array(np.array(places[i : i + step])[row]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(change.astype(np.int32)), pa.array(keys[row, change])], ["word", "n", "change", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, change int, key bigint")


def changed(alphabet: str) -> Column:
    """The string that a change makes of a word."""
    n, size = F.length("word"), len(alphabet)
    kept = F.col("change") - n  # from 0: replacements, then insertions
    puts = F.when(kept < n * size, kept).otherwise(kept - n * size)
    at = F.when(kept < 0, F.col("change")).otherwise(F.floor(puts / size)).cast("int")
    letter = F.when(kept < 0, F.lit("")).otherwise(F.substring(F.lit(alphabet), F.pmod(puts, F.lit(size)) + 1, F.lit(1)))
    gone = F.when(kept < n * size, 1).otherwise(0)
    return F.concat(F.substring(F.col("word"), F.lit(1), at), letter, F.substring(F.col("word"), at + 1 + gone, n))


def _roots(links: DataFrame, scratch: Scratch, small: bool) -> DataFrame:
    """links: word, form.  (word, root): forms followed to their last, twice as far each round.  n at least doubles with
    each form, so a chain has fewer than 63 of them."""
    at = scratch.keep(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        grown = scratch.keep(at.join(F.broadcast(on) if small else on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        done = grown.where("moved").isEmpty()
        scratch.drop(at)
        at = grown.select("word", "root")
        at._scratch_path = grown._scratch_path
        if done:
            return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  word, n, n_near, form, form_n, root: form is the near word of largest n, if that n is at least
    twice the word's own; root is the last of its forms, or the word itself."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(vocabulary(docs), "counted")
    size = counted.count()
    # generation is dealt by number of words, whatever the files of the counts are
    words = scratch.keep(keyed(counted.repartition(max(1, ceil(size / TASK_WORDS)), "word")), "words")
    scratch.drop(counted)
    small = bounded(words, BROADCAST_ROWS)
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    # equal keys of different strings are told apart by the strings
    met = candidates(words, alphabet, docs.sparkSession.sparkContext.broadcast(key_map(words))).join(F.broadcast(known) if small else known, "key").where(changed(alphabet) == F.col("near"))
    # the largest n first, then the smallest word
    best = met.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    form = F.when(-F.col("b.m") >= 2 * F.col("n"), F.col("b.near"))
    near = scratch.keep(best.select("word", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("b.m")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null"), scratch, small)
    out = words.drop("key").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
