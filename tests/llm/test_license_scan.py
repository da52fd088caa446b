"""License scans against regular expressions over the words."""

import random
import re

import pytest

from verdigris.llm import license_scan, queries
from verdigris.llm.license_scan import BASE, PHRASES, TEMPLATES, Automaton, Template, words_of

SF = "/root/testdata/sf0.001"


def _pattern(wording):
    """Words are written with a blank behind each."""
    out = ""
    for part in re.split(r"(<<[^>]+>>)", wording):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<any:"):
            out += "(?:[^ ]+ ){0,%s}" % part[6:-2]
        elif part.startswith("<<one:"):
            out += "(?:" + "|".join("".join(re.escape(w) + " " for w in c.split()) for c in part[6:-2].split("|")) + ")"
        else:
            out += "".join(re.escape(w) + " " for w in part.split())
    return re.compile(r"(?:(?<=^)|(?<= ))" + out)


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _plain(text):
    words = _words(text)
    said = "".join(w + " " for w in words)
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    more = {t for t in TEMPLATES if _pattern(t.wording).search(said)}
    weight = 0.5 if base else 0.0
    weight = max([weight, *(t.weight for t in more)])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {t.label for t in more})), weight)


def _filled(wording, rng):
    """A text that the template accepts."""
    while "<<optional>>" in wording:
        wording = re.sub(r"<<optional>>((?:(?!<<optional>>|<<end>>).)*)<<end>>", lambda m: m[1] if rng.random() < 0.5 else " ", wording, flags=re.S)
    wording = re.sub(r"<<any:([0-9]+)>>", lambda m: " ".join(["Some"] * rng.randint(0, int(m[1]))), wording)
    return re.sub(r"<<one:([^>]+)>>", lambda m: rng.choice(m[1].split("|")), wording)


def _texts():
    rng = random.Random(5)
    out = [None, "", "gnu", "GNU General\nPublic-License, the MIT License MIT license", "é mit licenseé", "cc by cc by-nc 4.0 Licensed under CC BY-NC 4.0.", "a " * 200_000 + "Apache License", "mit " * 50_000, "😀 mit license"]
    for t in TEMPLATES:
        for _ in range(4):
            text = _filled(t.wording, rng).split()
            out.append("Some words. " + ", ".join(text).upper() + " end")
            text[rng.randrange(len(text))] = "other"
            out.append(" ".join(text))
    return out


def test_places(spark):
    texts = _texts()
    automaton = Automaton((*BASE, *TEMPLATES))
    accepted = set()
    for text in texts:
        words = words_of(text or "")
        assert [w.decode() for w in words] == _words(text)
        found = automaton.find(words)
        accepted |= {automaton.templates[t].label for t, _, _ in found}
        for t, s, e in found:
            assert _pattern(automaton.templates[t].wording).fullmatch("".join(w.decode() + " " for w in words[s:e]))
    assert accepted == {t.label for t in (*BASE, *TEMPLATES)}


@pytest.mark.parametrize("small", [True, False])
def test_query(spark, tmp_path, small):
    d = SF
    if small:
        d = str(tmp_path)
        rows = [(i, t, "x", 1.0) for i, t in enumerate(_texts())] + [(None, "mit license", "x", 1.0), (1, "twice mit license", None, None), (1, "twice mit license", None, None)]
        spark.createDataFrame(rows, "doc_id long, text string, places string, score double").write.parquet(f"{d}/documents.parquet")
    got = [tuple(r) for r in queries.op11_license_scan(spark, d).collect()]
    want = [(r["doc_id"], *_plain(r["text"])) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_cache_and_marks(monkeypatch):
    words = words_of("a b c a x b c a b y y c " * 50)
    t = (Template("t", 1.0, "a <<any:2>> b <<optional>> y <<optional>> y <<end>> <<end>> c"),)
    want = Automaton(t).find(words)
    monkeypatch.setattr(license_scan, "CACHE", 2)
    assert Automaton(t).find(words) == want and len(want) == 150
    for wrong in ("a <<end>>", "<<optional>> a", "<<optional>> a <<end>>"):
        with pytest.raises(ValueError):
            Automaton((Template("t", 1.0, wrong),))
