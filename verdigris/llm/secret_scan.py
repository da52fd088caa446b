"""Secret scans: an Aho-Corasick prefilter over keywords, patterns anchored at its hits, checksums inside the secrets.

Kinds: assign (a keyword, = or :, and a value of 12 characters or more), access (AKIA key ids of 18 or more), hex (16 or
more of 0-9a-f, found as runs of bytes), github (tokens whose last six letters are the CRC-32 of the rest in base 62)
and key (the header of a private key).  Each kind is searched leftmost first and without overlaps.

Whole texts are read; a null or empty text has no spans.  Offsets are code points.  Repeated rows are searched like any
row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "key")
#: Keywords in lower case, and the kind whose pattern is tried at a hit.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "-----begin ": "key",
}
ANCHORED = {
    "assign": re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "key": re.compile(rb"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----"),
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def crc62(data: bytes) -> str:
    n, out = zlib.crc32(data), ""
    while len(out) < 6:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def confirmed(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind == "github":
        return crc62(m[0][4:-6]).encode() == m[0][-6:]
    return True


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.words.add_word(word, (len(word), kind))
        self.words.make_automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int, float]]:
        raw = text.encode("utf-8", "surrogatepass")
        hits = sorted((end + 1 - n, kind) for end, (n, kind) in self.words.iter(raw.lower().decode("latin-1")))
        last = dict.fromkeys(KINDS, 0)
        spans = []
        for at, kind in hits:
            if at >= last[kind] and (m := ANCHORED[kind].match(raw, at)):
                last[kind] = m.end()
                if confirmed(kind, m):
                    spans.append((kind, m.start(), m.end()))
        run = _HEX[np.frombuffer(raw, np.uint8)]
        edge = np.flatnonzero(np.diff(np.r_[False, run, False]))
        long = edge[1::2] - edge[::2] >= 16
        spans += [("hex", int(s), int(e)) for s, e in zip(edge[::2][long], edge[1::2][long], strict=True)]
        if spans and len(raw) != len(text):
            points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            spans = [(k, int(points[s]) - 1, int(points[e - 1])) for k, s, e in spans]
        return [(k, s, e, 1.0) for k, s, e in spans]


def finder():
    return Scanner()


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with every stretch of spans replaced by [kind], the first span's."""
    if not spans:
        return text
    out, end = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind}]"]
        end = max(end, e)
    return "".join(out) + text[end:]
