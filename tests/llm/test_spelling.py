"""Spelling variants against comparisons of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from verdigris.llm import queries, spelling


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        near = [v for v in n if _near(v, w)]
        count[w] = len(near)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], None if form[w] is None else n[form[w]]))
    return out


def _docs():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcé×ÿ") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    words = list(stems)
    for w in stems * 4:
        at = rng.randrange(len(w))
        words.append(w[:at] + rng.choice(["", "b", "É", w[at] * 2]) + w[at + 1 :])
    out = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=80)) + "-Don't łodzı") for i in range(300)]
    # a chain of forms, each twice as frequent as the one before
    chain = ["zzzzz" + "y" * k for k in range(9)]
    out += [(1000 + k, " ".join([w] * (3 * 2**k))) for k, w in enumerate(chain)]
    return out + [(None, "nulls words words words"), (7, None), (8, ""), (9, "x" * 300_000), (9, "repeated repeated"), (9, "repeated repeated")]


def test_query(spark, tmp_path):
    docs = _docs()
    rows = [(i, t, 1, "near") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, n int, near string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, str(tmp_path)).collect()
    want = _plain(docs)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["n_near"] > 3 for r in got) and any(r["root"] == "zzzzz" + "y" * 8 and r["word"] == "zzzzz" for r in got)


def test_many_words_join_by_shuffle(spark, tmp_path, monkeypatch):
    docs = _docs()
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(spelling, "HELD", 5)
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == _plain(docs)


def test_every_deletion_is_told(spark):
    """Runs whose key 97 divides lose the letter that the key names."""
    found = [(i, r) for i in range(2000) if zlib.crc32(f"{i}:{(r := 'letters')}".encode()) % 97 == 0]
    assert found
    for i, r in found:
        h = zlib.crc32(f"{i}:{r}".encode())
        assert spelling.noted(i, r.encode()).decode() == r[: h % 7] + r[h % 7 + 1 :]
    assert spelling.noted(0, b"\xe9t\xe9s") in (b"\xe9t\xe9s", b"t\xe9s", b"\xe9\xe9s", b"\xe9ts", b"\xe9t\xe9")
