"""How many words and slots a source gets."""

from pyspark.sql import functions as F

from verdigris.llm import mixing
from verdigris.plans.scratch import Scratch

SIZES = {"a": 5, "b": 21, "c": 50, "d": 129, "e": 150, "f": 400, "g": 640, "h": 20_000, "i": 3_001}


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(f"{s}{j}" for j in range(lo, min(lo + 37, n))), s) for s, n in SIZES.items() for i, lo in enumerate(range(0, n, 37))]
    mix, plan = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = {r["s"]: r["n"] for r in mix.groupBy("s").agg(F.sum("words").alias("n")).collect()}
    goals = {r["source"]: (r["source_size"], r["target"]) for r in plan.select("source", "source_size", "target").distinct().collect()}
    assert {s: n for s, (n, _) in goals.items()} == SIZES
    capped = {s for s, (n, target) in goals.items() if target == 3 * n}
    assert capped >= set("abcdefg")
    for s, (n, target) in goals.items():
        got = taken.get("=" + s, 0)
        assert got == 3 * n if s in capped else abs(got - target) <= 192
    often = mix.groupBy("s", "begin", "first").count().agg(F.max("count")).first()[0]
    assert often == 3


def test_shards_draw_their_counts(spark):
    """Counts of a source spread over the shards as a draw without return does, and neighbours in a shard are not in step."""
    n, wide = 200 * 64, 64
    sources = spark.createDataFrame([("=a", 0, n // 2 * 8, n // 2, n / 2 * 8.0), ("=b", 1, n // 4 * 8, n // 4, n / 4 * 8.0), ("=c", 2, n // 4 * 8, n // 4, n / 4 * 8.0)], "s string, rank int, source_size long, n_blocks long, target double")
    rows = mixing.slots(sources, Scratch(spark), wide, 3.0, 17).collect()
    assert sorted(r["slot"] for r in rows) == list(range(n)) and all(r["shard"] == r["slot"] // wide for r in rows)
    assert len({(r["s"], r["block_no"]) for r in rows}) == n
    for s, p in (("=a", 0.5), ("=b", 0.25), ("=c", 0.25)):
        count = [0] * (n // wide)
        for r in rows:
            count[r["shard"]] += r["s"] == s
        expected = wide * p * (1 - p) * (n - wide) / (n - 1)
        # 200 shards: the sample variance is within 40 % at four deviations
        assert 0.6 < sum((x - wide * p) ** 2 for x in count) / len(count) / expected < 1.4
    other = mixing.slots(sources, Scratch(spark), wide, 3.0, 18).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows))


def test_permutations(spark):
    """Each key gives a permutation of any number of blocks, and no two keys the same one."""
    rows = [(key, n, i) for n in (1, 2, 3, 7, 64, 97, 1000) for key in (5, -6) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, n long, i long")
    got = {}
    for r in df.select("key", "n", "i", mixing._permuted(F.col("i"), F.col("n"), F.col("key")).alias("to")).collect():
        got.setdefault((r["n"], r["key"]), {})[r["i"]] = r["to"]
    assert all(sorted(m.values()) == list(range(n)) for (n, _), m in got.items())
    assert got[1000, 5] != got[1000, -6]
    steps = [(got[1000, 5][i + 1] - got[1000, 5][i]) % 1000 for i in range(999)]
    assert len(set(steps)) > 400  # no progression


def test_columns_of_the_same_names(spark):
    """A table's own columns come through, whatever the plan calls its own."""
    names = ["key", "s", "id", "copy", "pieces", "begin", "times", "doc", "new", "size", "slot", "order.by"]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300)), "a" if i % 2 else None, 7, *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    found = out.collect()
    assert found and all(tuple(r)[4:] == tuple(f"{n}{r['doc_id']}" for n in names) and r["n_chars"] == len(r["text"]) for r in found)
    assert mixing.mixed_documents(docs.drop("n_chars")).columns == docs.drop("n_chars").columns


def test_many_sources(spark):
    """Targets of more sources than one range holds, against a plain loop."""
    sizes = {f"s{i:04}": (i * i) % 97 + 1 for i in range(700)} | {None: 50_000}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark)).collect()
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while over := [s for s in free if left / sum(weight[x] for x in free) * weight[s] > 3 * sizes[s]]:
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
        left -= sum(3.0 * sizes[s] for s in over)
    target |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
    assert {r["source"]: r["rank"] for r in found} == {s: i for i, s in enumerate(names)}
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in found)
