import json

from pyspark.sql import functions as F

from verdigris.operators import changes, relate, tree
from verdigris.sources import component_text, readers
from verdigris.streaming import updates


def test_attribute_dump(spark, tmp_path):
    (tmp_path / "a.att").write_text("HEADER\nNEW /A\nTYPE:= SITE\nNEW /B\n:UDA:= x y\nDESC:= unset\nEND\nNAME:= top\nEND\n")
    got = [tuple(r) for r in readers.attribute_dump(spark, str(tmp_path)).orderBy("ord").select("section", "key", "value", "user").collect()]
    assert got == [("/A", "TYPE", "SITE", False), ("/B", ":UDA", "x y", True), ("/B", "DESC", None, False), ("/A", "NAME", "top", False)]


def test_holes_and_report(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"_key": "1", "Position": "1, 2,3.5"}, {"_key": "1", "Position": "x,2,3"}]))
    rows = readers.holes(spark, str(tmp_path / "h.json"))
    assert [tuple(r["position"]) for r in rows.collect()] == [(1.0, 2.0, 3.5), (None, 2.0, 3.0)]
    readers.write_report(rows.select("_key").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_bytes() == b"_key\r\n1\r\n1\r\n"


def test_stream_equals_batch(spark, tmp_path):
    """Batches fold together as one; a session delivered again, and what is broken, are set aside."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1 + i % 2, i % 7, i // 5, i, "AMD"[i * i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, updates.SCHEMA)
    published = []
    for part in (df.where("sesno < 6"), df.where("sesno >= 6"), df.where("sesno between 4 and 7").union(spark.createDataFrame([(1, None, 99, 1, "A"), (1, 5, 99, 1, "X")], updates.SCHEMA))):
        part.coalesce(1).write.mode("append").parquet(src)
        updates.start(spark, src, out, publish=lambda done, batch: published.append((batch, sorted(map(tuple, done.collect()))))).awaitTermination()
    assert {r["dbnum"]: r["applied_sesno"] for r in updates.control(spark, out).collect()} == {1: 11, 2: 11}
    assert published == [(0, [(1, 5), (2, 5)]), (1, [(1, 11), (2, 11)]), (2, [])]
    whole = changes.fold_net(df.withColumn("refno", F.struct("dbnum", "refno"))).select("refno.dbnum", "refno.refno", "net", "n_ops", "last_sesno")
    assert sorted(map(tuple, updates.net(spark, out).collect())) == sorted(map(tuple, whole.collect()))
    aside = updates.rejected(spark, out).collect()
    assert sorted(r["reason"] for r in aside) == ["broken"] * 2 + ["late"] * 20


def test_replay_of_a_batch_writes_the_same(spark, tmp_path):
    import shutil

    src, out = str(tmp_path / "in"), tmp_path / "out"
    df = spark.createDataFrame([(1, 2, 3, 4, "A"), (1, 2, 4, 5, "M")], updates.SCHEMA)
    df.coalesce(1).write.parquet(src)
    updates.start(spark, src, str(out)).awaitTermination()
    before = updates.net(spark, str(out)).collect()
    # the driver is lost after the writes, before the checkpoint's commit
    shutil.rmtree(out / "checkpoint" / "commits")
    updates.start(spark, src, str(out)).awaitTermination()
    assert updates.net(spark, str(out)).collect() == before and updates.rejected(spark, str(out)).count() == 0


def test_gate(spark):
    rows = spark.createDataFrame([(1, 1, 5, 1, "A"), (1, 1, 6, 1, "A"), (2, 1, 1, 1, "M"), (3, 1, 1, 1, "D"), (4, 1, 9, 1, "D"), (None, 1, 9, 1, "D"), (1, 1, 9, 1, None)], updates.SCHEMA)
    applied = spark.createDataFrame([(1, 5), (4, 1)], "dbnum int, applied_sesno bigint")
    kinds = spark.createDataFrame([(1, "DESI"), (2, "SYST"), (3, "DESI")], "dbnum int, db_type string")
    blocked = spark.createDataFrame([(4,)], "dbnum int")
    got = {(r["dbnum"], r["sesno"]): r["reason"] for r in updates.gate(rows, applied, kinds, blocked).collect()}
    assert got == {(1, 5): "late", (1, 6): None, (2, 1): None, (3, 1): "cold", (4, 9): "blocked", (None, 9): "broken", (1, 9): "broken"}


def test_anomalies(spark):
    rows = [(1, "D", "/a", 3, "p"), (2, "X", "/a", 9, "p"), (3, "D", "/b", 9, "p"), (4, "D", "/a", 1, "p"), (5, "D", "/a", 9, "p"), (6, "D", "/a", 9, "p"), (6, "D", "/c", 9, "p"), (7, "D", "/a", 9, "q"), (9, "D", "/a", 9, None)]
    files = spark.createDataFrame(rows, "dbnum int, db_type string, path string, latest int, project string")
    applied = spark.createDataFrame([(1, "X", "/z", 5), (2, "D", "/a", 5), (3, "D", "/a", 5), (5, "D", "/a", 5), (6, "D", "/a", 5), (7, "D", "/a", 5), (8, "D", "/a", 5)], "dbnum int, db_type string, path string, applied_sesno int")
    want = {1: ("rollback", True), 2: ("type_changed", True), 3: ("migrated", False), 4: ("new", False), 5: ("ok", False), 6: ("duplicate", True), 8: ("missing", True)}
    got = {r["dbnum"]: (r["verdict"], r["blocked"]) for r in updates.anomalies(files, applied, "p").collect()}
    assert got == want | {7: ("foreign", True), 9: ("foreign", True)}
    got = {r["dbnum"]: (r["verdict"], r["blocked"]) for r in updates.anomalies(files.drop("project"), applied).collect()}
    assert got == want | {7: ("ok", False), 9: ("new", False)}


def test_fold_table(spark):
    rows = [(b + op, b + op) for b in ("", "A", "M", "D") for op in "AMD"] + [("ADA", "ADA"), ("ADM", "ADM"), ("ADD", "ADD")]
    want = {"A": "A", "M": "M", "D": "D", "AA": "A", "AM": "A", "AD": "C", "MA": "M", "MM": "M", "MD": "D", "DA": "A", "DM": "M", "DD": "D", "ADA": "A", "ADM": "M", "ADD": "C"}
    got = spark.createDataFrame(rows, "k string, s string").select("k", changes.fold_column(F.split("s", "")).alias("net")).collect()
    assert {r["k"]: r["net"] for r in got} == want


def test_cycles_and_bad_boxes(spark):
    e = spark.createDataFrame([(1, 2, 0, "A"), (2, 1, 0, "A"), (3, 1, 0, "A")], "refno long, owner long, seq long, noun string")
    assert sorted(tuple(r) for r in tree.closure(e).where("refno = 3").collect()) == [(3, 1, 1), (3, 2, 2), (3, 3, 0)]
    names = "id long, " + ", ".join(f"{x}_{a} double" for a in "xyz" for x in ("min", "max"))
    nan, inf = float("nan"), float("inf")
    b = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), (2, nan, 1.0, 0.0, 1.0, 0.0, 1.0), (3, 0.0, inf, 0.0, 1.0, 0.0, 1.0), (4, 1.0, 2.0, 1.0, 2.0, 1.0, 2.0)], names)
    assert sorted(tuple(r) for r in relate.box_overlap(b, b, 0.3).collect()) == [(1, 1), (1, 4), (4, 1), (4, 4)]


def test_range_join_of_many_rules(spark):
    rules = spark.createDataFrame([(i, i + 3) for i in range(0, 50, 2)], "lo int, hi int")
    rows = spark.range(60).withColumnRenamed("id", "v")
    a, b = (sorted(tuple(r) for r in relate.range_join(rows, rules, "v", most).select("v", "lo").collect()) for most in (1000, 3))
    assert a == b and a


def test_component_files(spark, tmp_path):
    """A file per branch, lines in order; missing values leave their line out, other nouns their block."""
    rows = [(1, "/L1", 2, "ELBO", [0.0, 1.5, 2.0], None, 50.0, 90.0, 7), (1, "/L1", 1, "VALV", None, None, 50.0, None, None), (1, "/L1", 3, "PIPE", None, None, 1.0, None, 9), (1, "/L1", 4, "CAP", None, None, 1.0, None, None), (1, "/L1", 5, "ELBO", None, None, 1.0, None, 9), (2, None, 1, "PIPE", None, None, 1.0, None, None)]
    parts = spark.createDataFrame(rows, "branch int, branch_name string, seq int, noun string, arrive array<double>, leave array<double>, bore double, angle double, item_code int")
    parts = parts.selectExpr("*", "array(1e7, -0.25, 0) as centre", "null as skey", "null as weld_spec", "seq + 10 as refno", "null as radius")
    out = tmp_path / "out"
    component_text.write_component_files(component_text.component_text(parts, spark.createDataFrame([(7, "elbow")], "item_code int, description string")), str(out))
    got = {p.parent.name: p.read_bytes().decode() for p in out.glob("*/*.txt")}
    centre = "        CENTRE-POINT    10000000  -0.25  0"
    first = ["PIPELINE-REFERENCE      /L1", "VALV", centre, "        ID-REF-NO    11", "ELBO", "        END-POINT    0  1.5  2 50", centre, "        ANGLE        90", "        ITEM-CODE    7", "        ID-REF-NO    12", "CAP", centre, "        ID-REF-NO    14", "MATERIALS", "ITEM-CODE    7", "        DESCRIPTION    elbow", ""]
    assert got == {"branch=1": "\r\n".join(first), "branch=2": "PIPELINE-REFERENCE      \r\nMATERIALS\r\n"}
    empty = component_text.component_text(parts.limit(0), spark.createDataFrame([], "item_code int, description string"))
    assert empty.count() == 0
