"""Queries whose tables grow: what is broadcast, what is joined, and the same results by plainer rules."""

import math
import random
import re

from pyspark.sql import functions as F

from verdigris import model_queries, reports
from verdigris.operators import instances, references, relate, rooms, tree

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _joined(df):
    """Rows that the joins of the last plan made."""
    df.collect()

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in p.nodeName():
            return walk(p.plan())
        below = sum(walk(p.children().apply(i)) for i in range(p.children().size()))
        return below + (p.metrics().apply("numOutputRows").value() if "Join" in p.nodeName() else 0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_mesh_members_broadcast_nothing(spark):
    assert "Broadcast" not in _plan(model_queries.QUERIES["mesh_rooms"](spark, SF))


def test_classification_broadcasts_no_stretches(spark, monkeypatch):
    monkeypatch.setattr(reports, "MOST_PARTS", 0, raising=False)
    names = ["abcdef", "xabc", None, "", "zz", "éab"]
    rows = spark.createDataFrame([(i, names[i % 6]) for i in range(600)], "id int, name string")
    rules = spark.createDataFrame([("p", "abc"), ("o", "abc"), ("q", "bcde"), ("r", "b"), ("s", ""), ("t", None), ("u", "é")], "code string, part string")
    df = reports.classify_by_name(rows, "id", "name", rules, "else", 0)
    assert "Broadcast" not in _plan(df)
    assert {r["id"]: r["code"] for r in df.collect()} == {i: ["q", "o", "else", "else", "else", "r"][i % 6] for i in range(600)}


def test_two_ranges_of_common_questions(spark):
    rng = random.Random(3)
    null = lambda x: None if rng.random() < 0.05 else x
    rows = [(i, null(rng.randrange(3)), null(rng.randrange(9)), null(float(rng.randrange(9)))) for i in range(300)]
    selections = [(rng.randrange(3), rng.randrange(6), lo := rng.randrange(9), lo + rng.randrange(5)) for _ in range(20)]
    answers = [(rng.randrange(5), rng.randrange(40), lo := rng.randrange(9), lo + rng.randrange(4), null(float(rng.randrange(99)))) for _ in range(40)]
    want = {}
    for i, spec, first, second in rows:
        hit = [(e, q, a is not None, a) for s, e, lo, hi in selections for e2, q, lo2, hi2, a in answers if e == e2 and None not in (spec, first, second) and spec == s and lo <= first <= hi and lo2 <= second <= hi2]
        want[i] = min(hit)[-1] if hit else None
    tables = [spark.createDataFrame(*x) for x in ((rows, "id int, spec int, first int, second double"), (selections, "spec int, sele int, lo int, hi int"), (answers, "sele int, seq int, lo int, hi int, answer double"))]
    for most in (100_000, 0):
        assert {r["id"]: r["answer"] for r in relate.two_ranges(*tables, "id", "first", "second", most).collect()} == want
    same = spark.range(2000).select("id", F.lit(1).alias("spec"), F.lit(1).alias("first"), F.lit(1).alias("second"))
    many = spark.range(500).select(F.lit(1).alias("sele"), F.col("id").alias("seq"), F.lit(0).alias("lo"), F.lit(5).alias("hi"), F.col("id").alias("answer"))
    df = relate.two_ranges(same, same.limit(1).select("spec", F.lit(1).alias("sele"), F.lit(0).alias("lo"), F.lit(5).alias("hi")), many, "id", "first", "second")
    assert _joined(df) <= 10_000 and {r["answer"] for r in df.collect()} == {0}


def _box(i, at, h):
    return (i, *(c - h for c in at), *(c + h for c in at))


def test_crowded_cells_in_blocks(spark, monkeypatch):
    """Cells of more rows than a block: every pair once, and tasks that no cell fills."""
    monkeypatch.setattr(relate, "BLOCK", 7, raising=False)
    rng = random.Random(4)
    box = "id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    left, right = ([_box(i, [rng.uniform(-0.5, 0.5) for _ in range(3)], h) for i in range(n)] for n, h in ((150, 0.05), (130, 0.2)))
    got = relate.box_overlap(spark.createDataFrame(left, box), spark.createDataFrame(right, box), 0.4)
    want = sorted((a[0], b[0]) for a in left for b in right if all(max(a[i], b[i]) <= min(a[i + 3], b[i + 3]) for i in (1, 2, 3)))
    assert sorted(map(tuple, got.collect())) == want and "__lb" in _plan(got)
    points = [(i, *(rng.uniform(-0.5, 0.5) for _ in range(3))) for i in range(120)]
    p = spark.createDataFrame(points, "id long, x double, y double, z double")
    near = relate.within_radius(p, p, 0.2)
    assert sorted((r["id"], r["centre"]) for r in near.collect()) == sorted((a[0], b[0]) for a in points for b in points if sum((a[i] - b[i]) ** 2 for i in (1, 2, 3)) ** 0.5 <= 0.2) and "__lb" in _plan(near)


def _shuffled(df):
    """Rows that the exchanges of the last plan wrote."""
    df.collect()

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in p.nodeName():
            return walk(p.plan())
        below = sum(walk(p.children().apply(i)) for i in range(p.children().size()))
        return below + (p.metrics().apply("shuffleRecordsWritten").value() if p.nodeName() == "Exchange" else 0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_copies_grow_as_the_rows_do(spark, monkeypatch):
    """Four times the rows of one cell, each copied to no more blocks; and blocks that hold no more than MOST rows."""
    monkeypatch.setattr(relate, "BLOCK", 2)
    monkeypatch.setattr(relate, "BLOCKS", 16, raising=False)
    rng = random.Random(9)
    points = [(i, *(rng.uniform(0.001, 0.019) for _ in range(3))) for i in range(400)]

    def pairs(n):
        p = spark.createDataFrame(points[:n], "id long, x double, y double, z double")
        box = p.select("id", *((F.col(a) + s * 0.001).alias(f"{e}_{a}") for e, s in (("min", -1), ("max", 1)) for a in "xyz"))
        return relate.within_radius(p, p, 0.02), relate.box_overlap(box, box, 0.4)

    for few, many in zip(pairs(100), pairs(400), strict=True):
        assert 0 < _shuffled(many) <= 4 * _shuffled(few)
    monkeypatch.setattr(relate, "MOST", 4, raising=False)
    near, boxes = pairs(100)
    d = lambda a, b: [abs(a[i] - b[i]) for i in (1, 2, 3)]
    assert sorted((r["id"], r["centre"]) for r in near.collect()) == sorted((a[0], b[0]) for a in points[:100] for b in points[:100] if sum(x * x for x in d(a, b)) ** 0.5 <= 0.02)
    assert sorted(map(tuple, boxes.collect())) == sorted((a[0], b[0]) for a in points[:100] for b in points[:100] if all(max(a[i] - 0.001, b[i] - 0.001) <= min(a[i] + 0.001, b[i] + 0.001) for i in (1, 2, 3)))


def _near(points, radius):
    ok = [p for p in points if None not in p[1:]]
    d = lambda a, b, i: (a[i] - b[i]) * (a[i] - b[i])
    apart = lambda a, b: math.sqrt(d(a, b, 1) + d(a, b, 2) + d(a, b, 3))
    return sorted((a[0], b[0], far) for a in ok for b in ok if (far := apart(a, b)) <= radius)


def test_near_pairs_come_in_order(spark, monkeypatch):
    """A task's pairs ascend in distance, and so many pairs as are compared are dealt to so many tasks."""
    monkeypatch.setattr(relate, "BLOCK", 16)
    monkeypatch.setattr(relate, "LOOKS", 500, raising=False)
    rng = random.Random(12)
    points = [(f"p{i}", *(rng.uniform(-0.3, 0.3) for _ in range(3))) for i in range(200)]
    points += [("n", None, 0.0, 0.0), ("nan", float("nan"), 0.0, 0.0), ("far", 5.0, 5.0, 5.0), ("far2", 5.0, 5.0, 5.2), (None, 7.0, 7.0, 7.0)]
    p = spark.createDataFrame(points, "id string, x double, y double, z double")
    near = relate.within_radius(p, p, 0.2)
    got = [tuple(r) for r in near.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(_near(points[:-1], 0.2) + [(None, None, 0.0)], key=key)
    tasks = near.withColumn("task", F.spark_partition_id()).select("task", "dist").collect()
    by_task = {}
    for r in tasks:
        by_task.setdefault(r["task"], []).append(r["dist"])
    assert all(d == sorted(d) for d in by_task.values()) and max(map(len, by_task.values())) > 20
    dealt = lambda df: max(map(int, re.findall(r"(\d+)\), REPARTITION_BY_NUM", _plan(df))))
    few = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(relate, "LOOKS", 1 << 24, raising=False)
    assert dealt(near) > few == dealt(relate.within_radius(p, p, 0.2))


def test_near_pairs_of_cut_batches(monkeypatch):
    """Groups that go on over batches, tiles of a few pairs, and stretches of no more than a few rows."""
    import pyarrow as pa

    from verdigris.operators import near_pairs

    monkeypatch.setattr(near_pairs, "TILE", 5)
    monkeypatch.setattr(near_pairs, "STRETCH", 20)
    rng = random.Random(13)
    rows = [(g, h, side, i, rng.uniform(0, 0.3)) for g, h in ((0, 0), (0, 1), (1, 0), (1, 2), (3, 0)) for side in (0, 1) for i in range(rng.randrange(12) if (g, side) != (3, 1) else 0)]
    t = pa.table(dict(zip(("g", "h", "side", "id", "x"), zip(*rows, strict=True), strict=True)))
    t = t.append_column("centre", t["id"])
    schema = pa.schema([("id", pa.int64()), ("centre", pa.int64()), ("dist", pa.float64())])
    want = sorted((a[3], b[3], abs(a[4] - b[4])) for a in rows for b in rows if a[:2] == b[:2] and a[2] < b[2] and abs(a[4] - b[4]) <= 0.1)
    for size in (1, 3, 7, 1000):
        groups = list(near_pairs.whole_groups([pa.RecordBatch.from_pylist([], t.schema), *t.to_batches(max_chunksize=size)], ["g", "h"]))
        assert sum(x.num_rows for x in groups) == len(rows) and len({(g, h) for g, h, *_ in rows}) == sum(len(set(zip(x["g"].to_pylist(), x["h"].to_pylist(), strict=True))) for x in groups)
        pairs = list(near_pairs.near(groups, ["g", "h"], ("x",), 0.1, schema))
        got = pa.Table.from_batches(near_pairs.in_stretches(pairs, "dist"), schema)
        assert [(r["id"], r["centre"], round(r["dist"], 12)) for r in sorted(got.to_pylist(), key=lambda r: tuple(r.values()))] == [(a, b, round(d, 12)) for a, b, d in want]
        d = got["dist"].to_pylist()
        assert len(d) > 40 and sum(a > b for a, b in zip(d, d[1:], strict=False)) <= len(d) // 20
    assert list(near_pairs.whole_groups([], ["g"])) == [] and list(near_pairs.in_stretches([], "dist")) == []


def test_pairs_of_rooms_are_not_shuffled(spark):
    """All parts in all rooms: the join of boxes is the last one, and what it makes goes straight to the result."""
    box = ", ".join(f"{c} double" for c in instances.BOX)
    parts = spark.createDataFrame([_box(i, (0.0, 0.0, 0.0), 0.05) for i in range(60)], f"element long, {box}")
    panels = spark.createDataFrame([(r[0], f"R{r[0]}", *r[1:]) for r in (_box(i, (0.01 * (i - 100), 0.0, 0.0), 0.2) for i in range(100, 130))], f"panel long, room_num string, {box}")
    points = spark.createDataFrame([(i, 0.04, 0.0, 0.0) for i in range(0, 60, 2)] + [(1, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0)], "element long, x double, y double, z double")
    found = rooms.room_members(parts, panels, points, 0.4)
    want = {(p, e) for p in range(100, 130) for e in range(60) if 0.01 * (p - 100) - 0.2 <= -0.05 or (e % 2 == 0 and 0.01 * (p - 100) - 0.2 <= 0.04)}
    assert {(r["panel"], r["element"]) for r in found.collect()} == want
    assert _plan(found).index("Join") < _plan(found).index("Exchange")
    best = relate.strongest(found.withColumnRenamed("panel", "room"))
    assert {(r["element"], r["room"]) for r in best.collect()} == {(e, 100) for e in range(60)}


def test_closure_broadcasts_no_table(spark, monkeypatch):
    elements = spark.range(3000).selectExpr("id as refno", "if(id % 9 = 0, null, id div 3) as owner", "if(id % 4 = 0, 'GMSE', 'SPEC') as noun", "1 as dbnum")
    edges, seeds = spark.range(0, 3000, 5).selectExpr("id as referrer", "id * 2 + 1 as referenced"), spark.range(0, 125, 5).withColumnRenamed("id", "refno")
    asked, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: asked.append(df.count()) or real(df))
    few = {r["refno"] for r in references.reference_closure(elements, edges, seeds).collect()}
    assert asked and max(asked) <= 200
    monkeypatch.setattr(references, "FRONT", -1)
    assert {r["refno"] for r in references.reference_closure(elements, edges, seeds).collect()} == few and len(few) > 100


def test_children_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(tree, "CHILDREN", 100, raising=False)
    rng = random.Random(8)
    rows = [(i, None if i % 97 == 0 else rng.randrange(40), None if i % 13 == 0 else rng.randrange(5), "AB"[i % 2]) for i in range(2000)]
    e = spark.createDataFrame(rows, "refno long, owner long, seq long, noun string")
    got = tree.siblings(e)
    assert got.rdd.getNumPartitions() >= 20
    want = {}
    for o in range(40):
        mine = sorted((r for r in rows if r[1] == o), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        kept = [r[0] if r[0] % 3 else None for r in mine]
        for i, r in enumerate(mine):
            want[r[0]] = (i + 1, next((k for k in kept[:i][::-1] if k), None), next((k for k in kept[i + 1 :] if k), None))
    assert {r["refno"]: r["ordinal"] for r in got.collect()} == {k: v[0] for k, v in want.items()}
    near = tree.neighbours_skipping(e, F.col("refno") % 3 == 0)
    assert {r["refno"]: (r["prev_kept"], r["next_kept"]) for r in near.collect()} == {k: v[1:] for k, v in want.items()}
    assert "1 following" not in _plan(near) and "currentrow$(), 1, unboundedfollowing" not in _plan(near).lower()


def test_box_pairs_take_few_bytes(spark, tmp_path):
    """A file of all pairs holds the same stretches of ids again and again."""
    rng = random.Random(31)
    box = "id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    left, right = (spark.createDataFrame([_box(i, [rng.uniform(0.02, 0.38) for _ in range(3)], h) for i in range(k, 6000, 2)], box) for k, h in ((0, 0.05), (1, 0.2)))
    relate.box_overlap(left, right, 0.4).write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 5_000_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * n


def test_box_groups_of_any_boxes(spark, monkeypatch):
    """Groups of a few boxes of any size and place, many of them in one place: every pair once."""
    monkeypatch.setattr(relate, "BLOCK", 9)
    monkeypatch.setattr(relate, "GROUP", 4, raising=False)
    rng = random.Random(32)
    box = "id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"

    def some(first, n):
        spread = lambda: [rng.choice([rng.gauss(0, 0.1), rng.gauss(0, 0.1), rng.uniform(-3, 3), 0.0]) for _ in range(3)]
        return [_box(first + i, spread(), rng.choice([0.0, 0.01, 0.05, 0.2, 0.2, 0.7, 3.0])) for i in range(n)] + [_box(first + n + i, (0.1, 0.1, 0.1), 0.05) for i in range(40)]

    left, right = some(0, 150), some(1000, 170) + [(None, *[0.0] * 3, *[0.3] * 3)]
    got = [tuple(r) for r in relate.box_overlap(spark.createDataFrame(left, box), spark.createDataFrame(right, box), 0.4).collect()]
    want = [(a[0], b[0]) for a in left for b in right if all(max(a[i], b[i]) <= min(a[i + 3], b[i + 3]) for i in (1, 2, 3))]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 5000
