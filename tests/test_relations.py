"""Joins, closures and folds on small tables: long chains, cycles, hot keys, nulls, large boxes, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris import reports, tools
from verdigris.operators import branches, changes, impact, instances, references, relate, rooms, tree
from verdigris.plans.scratch import Scratch

BOX = ", ".join(f"{c} double" for c in instances.BOX)


def test_fold_of_spans_equals_a_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(changes, "_SPAN", 3)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(40), i, rng.choice(["A", "M", "D", "D", None])) for i in range(900)]
    want = {}
    for r, s, q, op in sorted(rows, key=lambda x: (x[1], x[2])):
        if op:
            net, n, last = want.get(r, ("", 0, 0))
            want[r] = (changes.FOLD[net, op], n + 1, max(last, s))
    got = {r["refno"]: tuple(r)[1:] for r in changes.fold_net(spark.createDataFrame(rows, "refno int, sesno long, seq long, op string")).collect()}
    assert got == want


def test_long_chain(spark):
    edges = Scratch(spark).keep(spark.createDataFrame([(i + 1, i) for i in range(40)] + [(0, 40), (7, 20)], "referrer long, referenced long").coalesce(1))
    seeds = spark.createDataFrame([(0,), (None,)], "refno long")
    hops = {i: i for i in range(41)} | {7: 7}
    got = relate.reverse_closure(edges, seeds).collect()
    assert {r["refno"]: r["hops"] for r in got} == hops and not any(r["truncated"] for r in got) and len(got) == 41
    cut = relate.reverse_closure(edges, seeds, max_hops=5).collect()
    assert {(r["refno"], r["hops"], r["truncated"]) for r in cut} == {(i, i, i == 5) for i in range(6)}
    few = relate.reverse_closure(edges, seeds, most=3).collect()
    assert {(r["refno"], r["truncated"]) for r in few} == {(0, False), (1, False), (2, False), (3, True)}
    assert relate.reverse_closure(edges.limit(0), seeds).count() == 1 and relate.reverse_closure(edges, seeds.limit(0)).count() == 0


def test_long_reference_closure(spark):
    elements = spark.createDataFrame([(i, None, "SPEC", 1) for i in range(20)], "refno long, owner long, noun string, dbnum int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "referrer long, referenced long")
    seeds = spark.createDataFrame([(0,)], "refno long")
    got = references.reference_closure(elements, edges, seeds).collect()
    assert {(r["refno"], r["dbnum"], r["round"], r["truncated"]) for r in got} == {(i, 1 if i < 20 else None, i, False) for i in range(21)}
    cut = references.reference_closure(elements, edges, seeds, max_rounds=3).collect()
    assert {(r["refno"], r["truncated"]) for r in cut} == {(0, False), (1, False), (2, True)}


def test_long_cascade(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)], "referrer long, referenced long")
    roots = spark.createDataFrame([(i, i, "unit" if i == 18 else "normal") for i in range(1, 21)], "refno long, root long, kind string")
    seeds = spark.createDataFrame([(0,)], "refno long")
    got = {(r["root"], r["kind"], r["hops"], r["truncated"]) for r in references.cascade_roots(edges, seeds, roots).collect()}
    assert got == {(i, "unit" if i == 18 else "normal", i, False) for i in range(1, 19)}
    cut = {(r["root"], r["truncated"]) for r in references.cascade_roots(edges, seeds, roots, max_hops=4).collect()}
    assert cut == {(1, False), (2, False), (3, False), (4, True)}
    assert references.cascade_roots(edges, seeds.limit(0), roots).count() == 0


def test_long_way_to_a_site(spark):
    hops = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(30, 31), (31, 30), (40, 40), (50, None)], "refno long, target long")
    starts = spark.createDataFrame([(100, 1), (101, 30), (102, 40), (103, 50), (104, 99), (105, 12), (106, None)], "refno long, target long")
    sites = spark.createDataFrame([(12, 120, "/1-PIPE"), (5, 50, "/2-INST")], "refno long, branch long, site_name string")
    rows = lambda **o: {tuple(r) for r in branches.first_branch_by_site(starts, hops, sites, **o).collect()}
    assert rows() == {(100, 120, 12, False), (105, 120, 1, False)}
    assert rows(max_hops=1) == {(105, 120, 1, False), (100, None, 1, True), (101, None, 1, True)}
    assert rows(max_hops=12) == rows()


def test_as_of_over_ranges(spark):
    """A key with most of the rows, keys that end and begin at a range, ties, nulls, keys without history."""
    rng = random.Random(5)
    keys = [1] * 20 + [2, 3, 4, None]
    history = [(rng.choice(keys), rng.choice([None, *range(300)]), i) for i in range(3000)]
    probes = [(rng.choice([*keys, 9]), rng.choice([None, *range(-5, 305)]), i) for i in range(3000)]
    h = spark.createDataFrame(history, "k int, t int, v int").repartition(5)
    p = spark.createDataFrame(probes, "k int, at int, id int").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: (r["k"], r["at"], r["v"]) for r in relate.as_of(p, h, "k", "at", "t", ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = {}
    for k, at, i in probes:
        found = [(t, v) for kk, t, v in history if k is not None and kk == k and t is not None and at is not None and t <= at]
        want[i] = (k, at, max(found)[1] if found else None)
    assert got == want
    assert relate.as_of(p, h.limit(0), "k", "at", "t", ["v"]).where("v is not null").count() == 0 and relate.as_of(p.limit(0), h, "k", "at", "t", ["v"]).count() == 0


def test_boxes_of_any_size(spark):
    rng = random.Random(6)

    def box(i):
        size = 10.0 ** rng.choice([-3, -1, 0, 2, 6, 12, 280])
        low = [rng.uniform(-3, 3) * rng.choice([1, 1, size]) for _ in range(3)]
        return (i, *low, *(x + rng.random() * size for x in low))

    left, right = [box(i) for i in range(150)], [box(i) for i in range(1000, 1100)] + [(1, 2.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, float("-inf"), 0.0, 0.0, 1.0, 1.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = sorted(map(tuple, relate.box_overlap(*(spark.createDataFrame(x, f"id long, {BOX}") for x in (left, right)), 0.4).collect()))
    good = [r for r in right if r[0] not in (1, 2)]
    assert got == sorted((a[0], b[0]) for a in left for b in good if all(max(a[i], b[i]) <= min(a[i + 3], b[i + 3]) for i in (1, 2, 3)))


def test_rooms(spark):
    """Two rooms side by side, a part across them that its points decide, a panel among the parts, a sloped room."""
    panels = [(1, "K100", 0.0, 0.0, 0.0, 1000.0, 1000.0, 1000.0), (2, "K200", 900.0, 0.0, 0.0, 1900.0, 1000.0, 1000.0)]
    part = lambda i, x, h=40.0: (i, x - h, 460.0, 460.0, x + h, 540.0, 540.0)
    parts = [part(10, 200.0), part(11, 500.0), part(12, 1500.0), part(13, 950.0, 100.0), part(14, 5000.0), part(1, 500.0), (15, *[float("nan")] * 6)]
    points = [(13, 880.0, 500.0, 500.0), (14, 500.0, 500.0, 500.0), (99, 1.0, 1.0, 1.0)]
    tables = [spark.createDataFrame(r, s) for r, s in ((parts, f"element long, {BOX}"), (panels, f"panel long, room_num string, {BOX}"), (points, "element long, x double, y double, z double"))]
    got = {(r["panel"], r["element"]): r["inside_count"] for r in rooms.room_members(*tables, 100.0, least=0.8).collect()}
    assert got == {(1, 10): 8, (1, 11): 8, (2, 12): 8, (1, 13): 4}
    with pytest.raises(RuntimeError, match="CHAIN_INCOMPLETE"):
        rooms.room_members(*tables, 100.0, least=0.95)
    sloped = tables[1].withColumn("planes", F.array(F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c"), F.lit(900.0).alias("d"))))
    assert {(r["panel"], r["element"]) for r in rooms.room_members(tables[0], sloped, tables[2], 100.0, least=0.8).collect()} == {(1, 10)}


@pytest.mark.parametrize("most", [1000, 0])
def test_classification_by_any_number_of_rules(spark, most):
    rows = spark.createDataFrame([(1, "abcdef"), (2, "xabc"), (3, None), (4, ""), (5, "zz"), (6, "éab")], "id int, name string")
    rules = spark.createDataFrame([("p", "abc"), ("o", "abc"), ("q", "bcde"), ("r", "b"), ("s", ""), ("t", None), ("u", "é")], "code string, part string")
    got = {r["id"]: r["code"] for r in reports.classify_by_name(rows, "id", "name", rules, "else", most).collect()}
    assert got == {1: "q", 2: "o", 3: "else", 4: "else", 5: "else", 6: "r"}
    assert {r["code"] for r in reports.classify_by_name(rows, "id", "name", rules.limit(0), "else", most).collect()} == {"else"}


ROWS = [(1, None, "SITE"), (2, 1, "ZONE"), (3, 2, "EQUI"), (5, 99, "BOX"), (6, 5, "BOX"), (7, 8, "A"), (8, 7, "B"), (9, 8, "C"), (10, 10, "D")]


def test_paths(spark):
    e = spark.createDataFrame(ROWS, "refno long, owner long, noun string")
    got = {r["refno"]: [(x["anc"], x["noun"]) for x in r["path"]] for r in tree.paths(e, ["noun"]).collect()}
    nouns = {r[0]: r[2] for r in ROWS}
    walk = {1: [1], 2: [2, 1], 3: [3, 2, 1], 5: [5], 6: [6, 5], 7: [7, 8], 8: [8, 7], 9: [9, 8, 7], 10: [10]}
    assert got == {k: [(a, nouns[a]) for a in v] for k, v in walk.items()}
    found = tree.nearest_in_path(tree.paths(e, ["noun"]), lambda x: x["noun"].isin("ZONE", "B"))
    assert {tuple(r) for r in found.collect()} == {(2, 2, 0), (3, 2, 1), (7, 8, 1), (8, 8, 0), (9, 8, 1)}
    assert tree.paths(e.limit(0)).count() == 0


def test_tools_without_a_closure(spark):
    e = spark.createDataFrame([(r, o, r, n, f"/{r}") for r, o, n in ROWS], "refno long, owner long, seq long, noun string, name string")
    box = spark.createDataFrame([(3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, -1.0, 0.0, 0.0, 1.0, 2.0, 1.0), (6, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0)], f"refno long, {BOX}")
    ident = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    shift = spark.createDataFrame([(1, ident), (2, ident[:3] + [4.0] + ident[4:]), (3, ident[:3] + [3.0] + ident[4:]), (6, [1.0])], "refno long, matrix array<double>")
    values = spark.createDataFrame([(3, "XLEN", "5")], "refno long, key string, value string")
    tables = dict(elements=e, boxes=box, transforms=shift, attributes=values)
    for m in (tools.Model(**tables), tools.Model(**tables, closed=tree.closure(e))):
        run = lambda name, m=m, **a: tools.run(name, m, **a).collect()
        assert {(r["depth"], r["refno"], r["complete"]) for r in run("element.owner_chain", refno=3)} == {(0, 3, True), (1, 2, True), (2, 1, True)}
        assert {(r["refno"], r["truncated"]) for r in run("element.owner_chain", refno=3, max_hops=1)} == {(3, True), (2, True)}
        assert [r["root"] for r in run("model.generation_root", refno=3)] == [3]
        assert [(r["min_x"], r["max_y"]) for r in run("spatial.bounds", refno=1)] == [(-1.0, 2.0)]
        assert [r["matrix"][3] for r in run("element.transform", refno=3)] == [7.0]
        with pytest.raises(tools.ToolError, match="CHAIN_INCOMPLETE"):
            run("element.owner_chain", refno=6, strict=True)
        with pytest.raises(tools.ToolError, match="PARSE_ERROR"):
            run("element.transform", refno=6)
        with pytest.raises(tools.ToolError, match="ATTR_NOT_APPLICABLE"):
            run("element.attributes", refno=3, keys=["XLEN", "YLEN"])
        assert len(run("element.owner_chain", refno=9)) == 3


def test_impact_of_nulls(spark):
    rows = [("M", None, None, None), ("M", [], None, "BOX"), ("M", ["POS"], None, None), ("M", ["POS", None], None, "BOX"), (None, ["NAME"], False, "BOX"), ("M", ["NAME"], None, "BOX"), ("M", ["POS"], None, "LOOP")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, op string, a array<string>, c boolean, n string")
    got = [r["x"] for r in df.orderBy("i").select(impact.operation_impact(F.col("op"), F.col("a"), F.col("c"), F.col("n")).alias("x")).collect()]
    assert got == ["regen", "regen", "transform", "regen", "regen", "skip", "regen"]


def test_products_of_spans(spark):
    rng = random.Random(4)
    rows = [(i % 2, i, [float(rng.randint(-1, 1)) for _ in range(16)]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, at int, m array<double>")
    whole = {r["k"]: r["m"] for r in instances.products(df, "k", "at", "m", span=1000).collect()}
    parts = {r["k"]: r["m"] for r in instances.products(df, "k", "at", "m", span=3).collect()}
    assert whole == parts and len(whole) == 2


def test_short_nouns(spark):
    df = spark.createDataFrame([("Flange",), ("SUPPORT",), ("tube",), ("BOX",), (None,)], "n string")
    assert [r["s"] for r in df.select(tree.short_noun(F.col("n")).alias("s")).collect()] == ["FLAN", "SUPPO", "TUBI", "BOX", None]
