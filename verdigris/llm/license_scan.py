"""License scans by template markup: optional and replaceable regions compiled into automata over words.

A template is wording with marks: `<<optional>> ... <<end>>` may be left out (and may be nested), `<<any:N>>` stands for up
to N words of any kind, `<<one:a b|c>>` for one of the wordings between the bars.  All else is mandatory and must stand
there exactly, word by word.  Words are runs of a-z, 0-9 and what is not ASCII, after A-Z are lower-cased.

All templates become one nondeterministic automaton that may start at any word; its sets of states are made
deterministic as texts ask for them, so that a text costs one look-up a word.  Where a template ends, the same automaton
runs backwards from there and finds its nearest start.  A cache of sets that has grown to CACHE is emptied, which changes
no result.

A null or empty text has no words, no labels and score 0.  The score is the greatest weight of the labels found: a whole
license text 1, a notice that names a version 0.9, a bare phrase 0.5.  Repeated rows are read like any row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 20_000
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<(optional|end|any:[0-9]+|one:[^>]+)>>")


class Template(NamedTuple):
    label: str
    weight: float
    wording: str


#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE = tuple(Template(label, 0.5, phrase) for phrase, label in PHRASES.items())

_NO_WARRANTY_BSD = """this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to
 the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
 conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of
 conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above
 copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
 the distribution """
#: The public wording of licenses and of their notices.
TEMPLATES = (
    Template("apache-2.0", 0.9, "licensed under <<optional>> the <<end>> apache license <<optional>> version <<end>> <<one:2 0|2>>"),
    Template("cc-by-4.0", 0.9, "licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<one:cc by|creative commons attribution>> <<one:4 0|4>>"),
    Template("cc-by-nc-4.0", 0.9, "licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<one:cc by nc|creative commons attribution noncommercial>> <<one:4 0|4>>"),
    Template("cc-by-sa-4.0", 0.9, "licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<one:cc by sa|creative commons attribution sharealike>> <<one:4 0|4>>"),
    Template("gpl-2.0", 0.9, "gnu general public license <<optional>> as published by the free software foundation <<optional>> either <<end>> <<end>> <<one:version 2|v2>>"),
    Template("gpl-3.0", 0.9, "gnu general public license <<optional>> as published by the free software foundation <<optional>> either <<end>> <<end>> <<one:version 3|v3>>"),
    Template("mit-notice", 0.9, "<<one:released|licensed|distributed|available>> under <<optional>> the terms of <<end>> the mit license"),
    Template(
        "mit-text",
        1.0,
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
 files <<optional>> the software <<end>> to deal in the software without restriction including without limitation the rights to use copy
 modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
 furnished to do so subject to the following conditions the above copyright notice and this permission notice
 <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software
 the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
 merchantability fitness for a particular purpose and noninfringement in no event shall <<any:12>> be liable for any claim damages or
 other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use
 or other dealings in the software""",
    ),
    Template(
        "isc-text",
        1.0,
        """permission to use copy modify and <<one:or|distribute|and>> <<optional>> distribute <<end>> this software for any purpose with or without fee
 is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as
 is and <<any:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness""",
    ),
    Template("bsd-2-clause-text", 1.0, _BSD + _NO_WARRANTY_BSD),
    Template(
        "bsd-3-clause-text",
        1.0,
        _BSD
        + """<<optional>> 3 <<end>> neither the name of <<any:12>> nor the names of its contributors may be used to endorse or promote
 products derived from this software without specific prior written permission """
        + _NO_WARRANTY_BSD,
    ),
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class _Net:
    """States with steps on a word (None: any word) and free steps; one start and end for each template."""

    def __init__(self) -> None:
        self.on: list[dict[bytes | None, set[int]]] = []
        self.free: list[set[int]] = []

    def state(self) -> int:
        self.on.append({})
        self.free.append(set())
        return len(self.on) - 1

    def step(self, a: int, word: bytes | None) -> int:
        b = self.state()
        self.on[a].setdefault(word, set()).add(b)
        return b

    def wording(self, at: int, text: str) -> int:
        for w in words_of(text):
            at = self.step(at, w)
        return at

    def template(self, begin: int, text: str) -> int:
        """Adds a template's states behind begin; its last one."""
        at, before, open_ = begin, 0, []
        for m in _MARK.finditer(text):
            at = self.wording(at, text[before : m.start()])
            before, mark = m.end(), m[1]
            if mark == "optional":
                open_.append(at)
            elif mark == "end":
                if not open_:
                    raise ValueError(f"<<end>> without <<optional>>: {text[:40]}")
                at = self._after({open_.pop(), at})
            elif mark.startswith("any:"):
                ends = [at]
                for _ in range(int(mark[4:])):
                    ends.append(self.step(ends[-1], None))
                at = self._after(set(ends))
            else:
                at = self._after({self.wording(at, choice) for choice in mark[4:].split("|")})
        if open_:
            raise ValueError(f"<<optional>> without <<end>>: {text[:40]}")
        return self.wording(at, text[before:])

    def _after(self, ends: set[int]) -> int:
        b = self.state()
        for a in ends:
            self.free[a].add(b)
        return b

    def turned(self) -> _Net:
        out = _Net()
        for _ in self.on:
            out.state()
        for a, steps in enumerate(self.on):
            for w, to in steps.items():
                for b in to:
                    out.on[b].setdefault(w, set()).add(a)
        for a, to in enumerate(self.free):
            for b in to:
                out.free[b].add(a)
        return out


class Automaton:
    """Finds (template, start, end) of all places where a template's wording ends, with the nearest start of each."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.net = _Net()
        self.begins = [self.net.state() for _ in templates]
        self.ends = [self.net.template(b, t.wording) for b, t in zip(self.begins, templates, strict=True)]
        self.back = self.net.turned()
        start = self._closed(set(self.begins), self.net)
        if start & set(self.ends):
            raise ValueError("a template may match no word at all")
        self.start = frozenset(start)
        self.ending = {e: t for t, e in enumerate(self.ends)}
        self._clear()

    @staticmethod
    def _closed(states: set[int], net: _Net) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for b in net.free[todo.pop()]:
                if b not in out:
                    out.add(b)
                    todo.append(b)
        return out

    @staticmethod
    def _moved(states: frozenset[int] | set[int], word: bytes, net: _Net) -> set[int]:
        out: set[int] = set()
        for s in states:
            out |= net.on[s].get(word, set()) | net.on[s].get(None, set())
        return out

    def _clear(self) -> None:
        # a set of states: steps on the words that it names, the set on any other word, the templates that end in it
        self.sets: dict[frozenset[int], list] = {}
        self.origin = self._entry(self.start)

    def _entry(self, states: frozenset[int]) -> list:
        found = self.sets.get(states)
        if found is None:
            named = {w for s in states for w in self.net.on[s] if w is not None}
            found = self.sets[states] = [{}, None, sorted(self.ending[s] for s in states if s in self.ending), states, named]
        return found

    def _next(self, entry: list, word: bytes) -> list:
        if word in entry[4]:
            to = self._entry(frozenset(self._closed(self._moved(entry[3], word, self.net), self.net) | self.start))
            entry[0][word] = to
        else:
            to = self._entry(frozenset(self._closed(self._moved(entry[3], b" ", self.net), self.net) | self.start))
            entry[1] = to
        return to

    def _begin(self, words: list[bytes], end: int, t: int) -> int:
        at = self._closed({self.ends[t]}, self.back)
        for i in range(end - 1, -1, -1):
            at = self._closed(self._moved(at, words[i], self.back), self.back)
            if self.begins[t] in at:
                return i
        raise AssertionError("an end without a start")

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        out = []
        at = self.origin
        for i, w in enumerate(words):
            to = at[0].get(w)
            if to is None:
                to = at[1] if at[1] is not None and w not in at[4] else self._next(at, w)
            at = to
            if at[2]:
                out += [(t, self._begin(words, i + 1, t), i + 1) for t in at[2]]
            if len(self.sets) > CACHE:
                states = at[3]
                self._clear()
                at = self._entry(states)
        return out


_PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("weight", T.DoubleType())]))


def scan_licenses(docs: DataFrame, base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs: doc_id, text.  doc_id, n_words, places: an array of label, base, start and end in words (end exclusive), weight,
    in order of end."""
    templates = (*base, *more)
    doc_id = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))
        for batch in batches:
            n, places = [], []
            for t in batch.column(1):
                words = words_of(t.as_py() or "")
                n.append(len(words))
                places.append([{"label": templates[k].label, "base": k < len(base), "start": s, "end": e, "weight": templates[k].weight} for k, s, e in automaton.find(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, kind)], ["doc_id", "n_words", "places"])

    schema = T.StructType([doc_id, T.StructField("n_words", T.LongType()), T.StructField("places", _PLACES)])
    return docs.select("doc_id", F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
