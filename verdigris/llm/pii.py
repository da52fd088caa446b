"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds: email, ip (four parts up to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits), and, added to these, iban
(mod 97) and local (telephone numbers without a country's prefix).  Each kind is searched on its own, leftmost first and
without overlaps; a proposal that fails its check is dropped.  A span starts with its kind's score, gains CONTEXT for a
word that speaks for its kind within WINDOW code points on either side, and loses it for one that speaks against it.
Spans of the added kinds with less than LEAST are dropped: a local number, whose form proves little, needs a word
nearby; so are local numbers that touch a span of another kind.  Spans of the first four kinds stay, whatever their score.

Whole texts are read; a null or empty text has no spans.  Every search is linear in the text: a search begins at the
ends of runs, never again within one.  Repeated rows are searched like any row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local")
WINDOW, CONTEXT, LEAST = 40, 0.2, 0.5
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "local": 0.3}
_TELEPHONE = ("phone", "telephone", "call", "tel", "mobile", "cell", "text", "dial", "fax", "hotline", "telefon", "handy", "anrufen", "rufnummer", "téléphone", "portable", "appeler", "teléfono", "móvil", "llamar")
#: Words whose presence nearby speaks for a kind, in English, German, French and Spanish.
WORDS = {
    "email": ("mail", "e-mail", "email", "contact", "write", "reply", "address", "schreiben", "kontakt", "adresse", "courriel", "écrire", "contacter", "correo", "escribir", "contacto"),
    "ip": ("ip", "host", "server", "address", "login", "network", "firewall", "subnet", "port", "adresse", "netzwerk", "serveur", "réseau", "servidor", "red", "dirección"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "expiry", "cvv", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "crédito", "pago"),
    "phone": _TELEPHONE,
    "iban": ("iban", "bank", "account", "transfer", "bic", "swift", "konto", "überweisung", "compte", "virement", "banque", "cuenta", "banco", "transferencia"),
    "local": _TELEPHONE,
}
#: Words whose presence nearby speaks against a kind.
AGAINST = {
    "email": ("example", "placeholder", "dummy"),
    "ip": ("version", "release", "build", "section", "chapter", "paragraph", "kapitel", "chapitre", "capítulo"),
    "card": ("order", "invoice", "isbn", "tracking", "serial", "rechnung", "facture", "factura"),
    "phone": ("order", "invoice", "isbn", "serial", "coordinates"),
    "iban": ("example", "placeholder", "dummy"),
    "local": ("order", "invoice", "isbn", "serial", "model", "part"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")


def _any(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)


_NEAR = {kind: (_any(WORDS[kind]), _any(AGAINST[kind])) for kind in KINDS}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part has no '@': the run of its characters before each '@' is the only one to try."""
    last = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield begin, last
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))


def _apart(numbers: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Numbers that overlap no span.  Of the spans that start before a number's end, the greatest end decides."""
    by_start = sorted((s, e) for _, s, e in spans)
    starts, ends = [s for s, _ in by_start], list(accumulate((e for _, e in by_start), max))
    return [n for n in numbers if not (k := bisect_left(starts, n[2])) or ends[k - 1] <= n[1]]


def find(text: str) -> list[tuple[str, int, int, float]]:
    spans = [("email", s, e) for s, e in emails(text)]
    # a long run of digits is no address part
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    spans += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
    numbers = [("local", m.start(), m.end()) for m in _NUMBER.finditer(text)]
    if numbers:
        spans += _apart(numbers, spans)
    out = []
    for kind, s, e in spans:
        score = SCORES[kind]
        for words, gain in zip(_NEAR[kind], (CONTEXT, -CONTEXT), strict=True):
            if words.search(text, max(0, s - WINDOW), s) or words.search(text, e, e + WINDOW):
                score += gain
        score = round(score, 2)
        if kind in BASE or score >= LEAST:
            out.append((kind, s, e, score))
    return out


def finder():
    return find
