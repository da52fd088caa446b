"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass") if isinstance(s, str) else s).hexdigest()


def quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return (sum(x[::2]) + sum(sum(divmod(2 * y, 10)) for y in x[1::2])) % 10 == 0


def digits(s):
    return re.sub(r"[^0-9]", "", s)


def personal(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def secrets(text):
    text = text or ""
    out = [("assign", m) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ["assign", "access", "hex"]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda x: (x[1], kinds.index(x[0])))


def said(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def shingles(text, k):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def components(docs, k, percent):
    """{doc_id: (size, component)} of (doc_id, text) rows with distinct ids, by all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs}
    posting = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            posting[x].append(i)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in posting[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def _crc_mpeg(data):
    c = 0xFFFFFFFF
    for b in data:
        for i in range(7, -1, -1):
            top = c >> 31 ^ b >> i & 1
            c = c << 1 & 0xFFFFFFFF ^ (0x04C11DB7 if top else 0)
    return c.to_bytes(4, "big")


def transport_stream(payload):
    """(the stream of a payload, sizes of its units), packet by packet."""
    pat = bytes.fromhex("00b00d0001c100000001f000")
    pmt = bytes.fromhex("02b0120001c10000e100f00006e100f000")
    out = [bytes.fromhex("4740001000") + pat + _crc_mpeg(pat), bytes.fromhex("4750001000") + pmt + _crc_mpeg(pmt)]
    out = [p.ljust(188, b"\xff") for p in out]
    count, sizes = 0, []
    for u, lo in enumerate(range(0, len(payload), 32768)):
        unit = payload[lo : lo + 32768]
        sizes.append(len(unit))
        t = 3600 * (u + 1)
        stamp = bytes([0x21 | t >> 30 << 1, t >> 22 & 255, t >> 15 << 1 & 255 | 1, t >> 7 & 255, t << 1 & 255 | 1])
        rest = b"\0\0\1\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\5" + stamp + unit
        first = True
        while rest:
            field = b""
            if first:
                field = bytes([0x50 if u % 8 == 0 else 0x10]) + (3600 * u << 15 | 0x7E00).to_bytes(6, "big")
            room = 184 - (len(field) + 1 if field else 0)
            if len(rest) < room:
                gap = room - len(rest)
                if not field:
                    gap -= 1
                    field = b"\0" if gap else b""
                    gap = max(0, gap - 1)
                    head = bytes([len(field) + gap]) + field + b"\xff" * gap
                else:
                    head = bytes([len(field) + gap]) + field + b"\xff" * gap
            else:
                head = bytes([len(field)]) + field if field else b""
            part, rest = rest[: 184 - len(head)], rest[184 - len(head) :]
            out.append(bytes([0x47, 0x41 if first else 0x01, 0, (0x30 if head else 0x10) | count & 15]) + head + part)
            count, first = count + 1, False
    return b"".join(out), sizes
