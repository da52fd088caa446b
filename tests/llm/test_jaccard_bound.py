"""No pair at the threshold is lost by the bound on agreeing column blocks, whatever blocks are empty."""

import numpy as np
import pytest

from tests.llm import brute
from verdigris.llm import jaccard_join


def _pairs(rng, percent, n):
    """Sets a and b at or just above the threshold: n pairs of 3 to 60 items."""
    a, b = [], []
    while len(a) < n:
        x = int(rng.integers(3, 61))
        y = int(rng.integers(-(-percent * x // 100), x + 1))
        both = -(-percent * (x + y) // (100 + percent))
        if both <= y:
            items = np.unique(rng.integers(0, 1 << 62, x + y - both, dtype=np.uint64))
            rng.shuffle(items)
            a.append(np.sort(items[:x]))
            b.append(np.sort(items[x - both :]))
    return a, b


def _dealt(sets, percent):
    """Of each set: by class, its sigs and need."""
    n = np.array([len(s) for s in sets])
    out = [{} for _ in sets]
    for up in (0, 1):
        p = jaccard_join.column_blocks(np.concatenate(sets), n, percent, up)
        at = np.r_[0, np.cumsum(p["count"])]
        for i, row in enumerate(p["row"]):
            out[row][int(p["class"][i])] = (set(p["sigs"][at[i] : at[i + 1]].tolist()), int(p["need"][i]))
    return out


def lost(percent, n, seed=7):
    """How many of n qualifying pairs, each alone in its table, are never multiplied."""
    a, b = _pairs(np.random.default_rng(seed), percent, n)
    count = 0
    for x, y in zip(_dealt(a, percent), _dealt(b, percent), strict=True):
        count += not any(len(x[c][0] & y[c][0]) >= max(x[c][1], y[c][1]) for c in x.keys() & y.keys())
    return count


@pytest.mark.parametrize("percent", [67, 75, 80, 85, 90, 95, 100])
def test_no_pair_at_the_threshold_is_lost(percent):
    assert lost(percent, 4000) == 0


def test_small_texts_at_the_threshold_are_linked(spark):
    """Texts of 10 to 24 words and the same with a word more or less, so that their sets stand at the threshold."""
    rng, rows = np.random.default_rng(5), []
    for i in range(800):
        words = [f"w{i}x{j}" for j in rng.integers(0, 10**6, int(rng.integers(10, 25)))]
        cut = int(rng.integers(1, 3))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-cut]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.components(rows, 4, 85)


def test_hot_sets_and_signatures(spark, monkeypatch):
    """The same components where copies, signatures and hubs are joined as hot keys."""
    from verdigris.plans import components, hot

    monkeypatch.setattr(hot, "HOT_KEYS", 20)
    monkeypatch.setattr(hot, "SMALL", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "FEW", 0)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 200):
        words = list(base)
        for j in rng.integers(0, 80, int(rng.integers(0, 4))):
            words[j] = f"x{int(rng.integers(0, 10**6))}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"v{int(x)}" for x in rng.integers(0, 10**6, 30))) for i in range(40)] + [(240, None), (241, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()}
    assert got == brute.components(rows, 4, 85)
