"""Language identification by cross-parsing entropy.

Of each language, a bounded sample of labelled text (the SAMPLE_TEXTS rows of least hash; of each a stretch of SHARE code
points from a hashed place on, in this order until SAMPLE_CHARS are there) becomes a suffix automaton.  A text is
cross-parsed against each: it is read as the fewest phrases in a row, each the longest match with the sample, whatever
its length.  A language's entropy estimate is phrases * log2(sample length) / text length; the least wins, ties by name.

Texts are parsed in segments of SEGMENT symbols, side by side, as if each began a phrase.  A parse that comes from the
segment before meets that one wherever both begin a phrase at the same symbol, and is the same from there on; so each
segment is parsed again from where the one before ended until they meet, and the counts are those of whole texts.

Symbols: letters are folded to lower case, one code point each, other characters to a space; letters that no sample has
match nothing.  Whole texts are read.  A null text, or one without a letter, is `und` with score 0.  Languages with no
labelled text are unknown; without any, every text is `und`.  Repeated rows are predicted like any row; other columns
and labels are no input.  The model has at most MAX_LANGS languages, half a megabyte each; more labels are an error.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_TEXTS, SHARE, SAMPLE_CHARS, MAX_LANGS = 64, 750, 12_000, 256
#: Symbols of a segment, and segments that are parsed side by side.
SEGMENT, ROWS = 256, 4096


def _fold_table() -> np.ndarray:
    """Of each code point: its lower case if it is a letter, else a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Moves of each state of the suffix automaton of a sequence of symbols; the root is the first state."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class Parser:
    """Greedy phrases of a sample of symbols 1..width-1; 0 pads a text.

    The automaton's moves are kept sparse: state s goes by symbol c to to[base[s] + c] where owner[base[s] + c] is s, and
    rows of different states are displaced so that they share one array.  Where a state has no move, a new phrase begins
    and first[c], the root's move, is taken; the root itself owns no place, so that a phrase begins there in any case."""

    def __init__(self, symbols: np.ndarray, width: int):
        moves = automaton(symbols.tolist())
        self.first = np.zeros(width, np.int32)
        for c, to in moves[0].items():
            self.first[c] = to
        self.base = np.zeros(len(moves), np.int32)
        several = sorted((s for s, m in enumerate(moves) if s and len(m) > 1), key=lambda s: -len(moves[s]))
        used = bytearray(2 * sum(len(m) for m in moves[1:]) + 2 * width)
        low = width
        for s in several:
            least, tried = min(moves[s]), 0
            at = low
            while True:
                at = used.find(0, at)
                if at < 0 or at + width >= len(used):
                    used.extend(bytes(len(used)))
                    at = low
                    continue
                if not any(used[at - least + c] for c in moves[s]):
                    break
                at += 1
                tried += 1
                if tried == 64:  # few places fit here: those that are left are for single moves
                    low, tried = at, 0
            self.base[s] = at - least
            for c in moves[s]:
                used[at - least + c] = 1
        single = [s for s, m in enumerate(moves) if s and len(m) == 1]
        used.extend(bytes(len(single)))
        room = np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0)[: len(single)] + width
        for s, at in zip(single, room.tolist(), strict=True):
            self.base[s] = at - next(iter(moves[s]))
        size = int(self.base.max()) + width
        self.owner, self.to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for s, m in enumerate(moves[1:], 1):
            for c, to in m.items():
                self.owner[self.base[s] + c], self.to[self.base[s] + c] = s, to

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether a phrase begins with the symbol)."""
        at = self.base.take(state) + symbol
        on = self.owner.take(at) == state
        return np.where(on, self.to.take(at), self.first.take(symbol)), ~on & (symbol > 0)

    def count(self, grid: np.ndarray, goes_on: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """grid: symbols, one segment in a column; goes_on tells that a segment follows the one before it in its text,
        the first one from the given state.  Phrases that begin in each segment, and the state at the end."""
        width = grid.shape[1]
        end = np.zeros(width, np.int32)
        marks = np.empty(grid.shape, bool)
        for t, row in enumerate(grid):
            end, marks[t] = self.step(end, row)
        alone = marks.sum(0, dtype=np.int64)
        count = alone.copy()
        came = np.where(goes_on, np.r_[np.int32(state), end[:-1]], 0)
        # again, from where the segment before ended, until both parses begin a phrase at the same symbol
        col = np.flatnonzero(came)
        now, seen, own = came[col], np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
        late = np.zeros(width, bool)
        for t in range(len(grid)):
            if not len(col):
                break
            now, begins = self.step(now, grid[t, col])
            both = begins & marks[t, col]
            if both.any():
                done = col[both]
                count[done] = seen[both] + alone[done] - own[both]
                rest = ~both
                col, now, seen, own, begins = col[rest], now[rest], seen[rest], own[rest], begins[rest]
            seen += begins
            own += marks[t, col]
        count[col] = seen
        late[col] = end[col] != now
        end[col] = now
        # segments after one whose end has changed by this, one after another
        for j in np.flatnonzero(late).tolist():
            k = j + 1
            while k < width and goes_on[k] and end[k - 1] != came[k]:
                came[k] = end[k - 1]
                count[k], end[k] = self._one(grid[:, k].tolist(), int(came[k]))
                k += 1
        return count, int(end[-1])

    def _one(self, symbols: list[int], state: int) -> tuple[int, int]:
        base, owner, to, first = self._lists()
        n = 0
        for c in symbols:
            at = base[state] + c
            if owner[at] == state:
                state = to[at]
            else:
                n += c > 0
                state = first[c]
        return n, state

    def _lists(self) -> tuple[list[int], ...]:
        if not hasattr(self, "_plain"):
            self._plain = tuple(x.tolist() for x in (self.base, self.owner, self.to, self.first))
        return self._plain


class Model:
    """Automata of the languages' samples, over the symbols that they share."""

    def __init__(self, samples: dict[str, list[str]]):
        fold = _fold_table()
        texts = {}
        for lang in sorted(samples):
            x = fold[np.frombuffer("\n".join(samples[lang]).encode("utf-32-le", "replace"), np.uint32)][:SAMPLE_CHARS]
            if len(x):
                texts[lang] = x
        self.langs = list(texts)
        known = np.unique(np.concatenate([*texts.values(), np.array([32], np.uint32)]))
        self.width = len(known) + 2  # 0 pads, the last one is unknown
        self.symbol = np.full(sys.maxunicode + 1, self.width - 1, np.uint8 if self.width < 256 else np.uint16)
        place = np.searchsorted(known, fold).clip(max=len(known) - 1)
        hit = known[place] == fold
        self.symbol[hit] = (place[hit] + 1).astype(self.symbol.dtype)
        self.letter = np.packbits(fold != 32)
        self.parsers = [Parser(self.symbol[x], self.width) for x in texts.values()]
        self.bits = np.array([math.log2(max(2, len(x))) for x in texts.values()])

    def phrases(self, symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
        """symbols: of all texts, one after another; n: how many of them each text has.  Phrases of each text for each
        language."""
        parts = -(-n // SEGMENT)
        doc = np.repeat(np.arange(len(n)), parts)
        begin = (np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(parts)[:-1]], parts)) * SEGMENT
        first = np.repeat(np.r_[0, np.cumsum(n)[:-1]], parts) + begin
        size = np.minimum(n[doc] - begin, SEGMENT)
        total = np.zeros((len(self.langs), len(n)), np.int64)
        step = np.arange(SEGMENT)
        padded = np.r_[symbols, np.zeros(SEGMENT, symbols.dtype)]
        state = [0] * len(self.langs)
        for lo in range(0, len(doc), ROWS):
            f, s = first[lo : lo + ROWS], size[lo : lo + ROWS]
            grid = np.where(step[:, None] < s[None, :], padded[step[:, None] + f[None, :]], 0).astype(np.int32)
            goes_on = begin[lo : lo + ROWS] > 0
            for k, parser in enumerate(self.parsers):
                c, state[k] = parser.count(grid, goes_on, state[k])
                np.add.at(total[k], doc[lo : lo + ROWS], c)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        n = np.array([len(c) for c in codes])
        flat = np.concatenate([*codes, np.empty(0, np.uint32)]).astype(np.uint32)
        letters = np.unpackbits(self.letter, count=sys.maxunicode + 1).view(bool)[flat] if len(flat) else np.empty(0, bool)
        has = np.zeros(len(texts), bool)
        np.logical_or.at(has, np.repeat(np.arange(len(texts)), n), letters)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total = self.phrases(self.symbol[flat], n)
        entropy = total * self.bits[:, None] / np.maximum(n, 1)
        best = entropy.argmin(0)
        if len(self.langs) > 1:
            two = np.partition(entropy, 1, axis=0)[:2]
            score = 1 - two[0] / np.maximum(two[1], 1e-12)
        else:
            score = np.ones(len(texts))
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, np.clip(score, 0, 1), 0.0)


def fit(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, lang.  Learns from a bounded sample: of each non-null lang, SAMPLE_TEXTS rows with text,
    those of least hash of doc_id.  A partial top-k of hashes for each lang, then the stretches of these rows; where ids
    repeat, no more of them than SAMPLE_TEXTS."""
    rows = labelled.where("lang is not null and length(text) > 0").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    ranked = rows.select("lang", "h").withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_TEXTS)
    wanted = [r["h"] for r in ranked.select("h").distinct().limit(MAX_LANGS * SAMPLE_TEXTS + 1).collect()]
    if len(wanted) > MAX_LANGS * SAMPLE_TEXTS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    begin = F.pmod("h", F.greatest(F.length("text") - SHARE + 1, F.lit(1))).cast("int") + 1
    found = rows.where(F.col("h").isin(wanted)).select("lang", "h", F.substring("text", begin, F.lit(SHARE)).alias("text"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= SAMPLE_TEXTS)
    samples: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["r"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    if len(samples) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    return Model(samples)


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, lang_pred and score (share of the second best entropy that the best saves)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGS automata of SAMPLE_CHARS symbols
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verdigris.llm.jaccard_join import steps

        for batch in batches:
            for lo, hi in steps(batch["text"]):
                langs, score = shared.value.predict([t or "" for t in batch["text"][lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
