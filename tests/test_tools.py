"""Tools and model operators on small tables: errors, nulls, cycles, empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from verdigris import reports, tools
from verdigris.operators import impact, instances, pending, tree

ELEMENTS = "refno bigint, owner bigint, seq bigint, noun string, name string, deleted boolean"


def _tree(spark, rows):
    return spark.createDataFrame([(r, o, r, n, f"/{r}", d) for r, o, n, d in rows], ELEMENTS)


def test_refno_forms():
    assert tools.parse_refno("17/3") == tools.parse_refno("17_3") == (17 << 32) + 3
    for bad in ("", "1", "a_b", "1_2_3", "-1_2", f"1_{1 << 32}"):
        with pytest.raises(tools.ToolError, match="INVALID_ARGUMENT"):
            tools.parse_refno(bad)


def test_tool_errors(spark):
    with pytest.raises(tools.ToolError, match="NOT_FOUND"):
        tools.run("no.such.tool", tools.Model())
    with pytest.raises(tools.ToolError, match="DB_UNAVAILABLE"):
        tools.run("room.lookup", tools.Model(), refno=1)
    with pytest.raises(tools.ToolError, match="INVALID_ARGUMENT"):
        tools.run("element.members", tools.Model(elements=_tree(spark, [(1, None, "SITE", False)])), refno=1, limit=0)
    with pytest.raises(ValueError):
        impact.unit_types(append=("zone",))
    with pytest.raises(RuntimeError):
        instances.require_coverage(89, 100)
    instances.require_coverage(90, 100)


def test_generation_roots(spark):
    rows = [(1, None, "SITE", False), (2, 1, "ZONE", False), (3, 2, "EQUI", False), (4, 3, "BOX", False), (5, 2, "STRU", False), (6, 5, "LOOP", False), (7, 6, "VERT", False), (8, 2, "LOOP", False), (9, 8, "PANE", None), (10, 99, "PANE", False), (11, 5, "FTUB", False), (12, 11, "BOX", False), (13, 2, "BOX", True)]
    e = _tree(spark, rows)
    c = tree.closure(e)
    got = {r["refno"]: (r["root"], r["kind"]) for r in impact.generation_roots(e, c).collect()}
    assert got == {3: (3, "unit"), 4: (3, "unit"), 5: (5, "normal"), 6: (5, "normal"), 7: (5, "normal"), 9: (9, "normal"), 10: (10, "normal"), 11: (5, "normal"), 12: (5, "normal"), 13: (13, "normal")}
    cover = {(r["root"], r["kind"], r["subtree"]) for r in impact.root_cover(e, c).collect()}
    assert cover == {(3, "mdu", 2), (5, "residue", 5), (10, "residue", 1)}
    assert impact.generation_roots(e.limit(0), c.limit(0)).count() == 0


def test_owner_chain_tells_its_end(spark):
    e = _tree(spark, [(1, None, "SITE", False), (2, 1, "ZONE", False), (3, 2, "EQUI", False)])
    m = tools.Model(elements=e, closed=tree.closure(e))
    assert {(r["refno"], r["complete"], r["truncated"]) for r in tools.owner_chain(m, 3).collect()} == {(3, True, False), (2, True, False), (1, True, False)}
    assert {(r["refno"], r["complete"], r["truncated"]) for r in tools.owner_chain(m, 3, max_hops=1).collect()} == {(3, False, True), (2, False, True)}


def test_queue_outcomes(spark):
    rows = [(1, 1, 5, 5), (1, 2, 5, 8), (1, 3, 5, 9), (1, 4, 5, 9), (1, 5, 5, None), (1, 6, 5, 9), (1, 7, 5, 11), (1, 8, 5, 12)]
    df = spark.createDataFrame(rows, "dbnum int, seq int, applied int, latest int")
    got = [r["outcome"] for r in pending.enqueued(df).orderBy("seq").collect()]
    assert got == ["covered", "new", "merged", "covered", "covered", "behind_running", "merged"]


def test_boxes_and_matrices(spark):
    rows = [("a", 0.0, 1.0), ("a", -2.0, 0.5), ("a", math.nan, 9.0), ("b", math.inf, 1.0)]
    df = spark.createDataFrame(rows, "k string, lo double, hi double").select("k", *(F.col("lo" if s.startswith("min") else "hi").alias(s) for s in instances.BOX))
    assert [(r["k"], r["min_x"], r["max_z"]) for r in instances.union_boxes(df, "k").collect()] == [("a", -2.0, 1.0)]
    empty = spark.range(1).select(instances.compose(F.array().cast("array<array<double>>")).alias("m")).first()["m"]
    assert [empty[i] for i in (0, 5, 10, 15)] == [1.0] * 4 and sum(empty) == 4.0


def test_names(spark):
    df = spark.createDataFrame([("BRAN 2 of /P-1",), ("/P-1",), (None,)], "name string")
    assert [tuple(r["p"]) for r in df.select(reports.parse_default_name(F.col("name")).alias("p")).collect()] == [("BRAN", 2, "/P-1"), (None, None, None), (None, None, None)]
