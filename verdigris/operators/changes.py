"""Change streams: net operations of session windows, last-writer-wins attributes, runs, impact and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Net state by previous state and incoming operation (A added, M modified, D deleted, C cancelled).
FOLD = {
    ("", "A"): "A", ("", "M"): "M", ("", "D"): "D",
    ("A", "A"): "A", ("A", "M"): "A", ("A", "D"): "C",
    ("M", "A"): "M", ("M", "M"): "M", ("M", "D"): "D",
    ("D", "A"): "A", ("D", "M"): "M", ("D", "D"): "D",
    ("C", "A"): "A", ("C", "M"): "M", ("C", "D"): "C",
}


_STATES = ("", "A", "M", "D", "C")
#: Sessions whose folds make one fold of the next level.
_SPAN = 4096


def fold_column(ops: Column) -> Column:
    """Net state of an ordered array of operations."""
    table = F.create_map(*(F.lit(x) for (before, op), to in FOLD.items() for x in (before + op, to)))
    return F.aggregate(ops, F.lit(""), lambda s, op: F.element_at(table, F.concat(s, op)))


def _composed(maps: Column) -> Column:
    """An ordered array of maps of states (array of the state that follows each of _STATES) as one map."""
    place = F.array(*map(F.lit, _STATES))
    return F.aggregate(maps, place, lambda so_far, then: F.transform(so_far, lambda s: F.element_at(then, F.array_position(place, s).cast("int"))))


def fold_maps(changes: DataFrame) -> DataFrame:
    """changes: refno, sesno, seq, op.  One row for each refno: map (the state after for each of _STATES before, so that
    windows can be folded together later), number of operations, last session.  An operation is a map of the states before it to those after; maps are composed within an element's session, then over
    spans of sessions, then over all of them, so that no array holds all operations of an element.  A null op, sesno or
    seq comes first and is no operation."""
    one = F.create_map(*(x for op in "AMD" for x in (F.lit(op), F.array(*(F.lit(FOLD.get((s, op), op)) for s in _STATES)))))
    known = changes.where(F.col("op").isin("A", "M", "D"))
    level = known.select("refno", "sesno", "seq", F.element_at(one, F.col("op")).alias("map"), F.lit(1).cast("bigint").alias("n"), F.col("sesno").alias("last"))

    def composed(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(*order, "map")))
        out = rows.groupBy(*keys).agg(ordered.alias("maps"), F.sum("n").alias("n"), F.max("last").alias("last"))
        return out.withColumn("map", _composed(F.transform("maps", lambda m: m["map"]))).drop("maps")

    level = composed(level, [F.col("refno"), F.col("sesno")], ["seq"])
    level = composed(level.withColumn("span", F.floor(F.col("sesno") / _SPAN)), [F.col("refno"), F.col("span")], ["sesno"])
    level = composed(level, [F.col("refno")], ["span"])
    return level.select("refno", "map", F.col("n").alias("n_ops"), F.col("last").alias("last_sesno"))


def fold_net(changes: DataFrame) -> DataFrame:
    """changes: refno, sesno, seq, op.  One row for each refno: net operation, number of operations, last session."""
    return fold_maps(changes).select("refno", F.get("map", F.lit(0)).alias("net"), "n_ops", "last_sesno")


def join_windows(windows: DataFrame) -> DataFrame:
    """windows: refno, window, map, n_ops, last_sesno, as of fold_maps.  fold_net of all windows in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("window", "map")))
    out = windows.groupBy("refno").agg(ordered.alias("maps"), F.sum("n_ops").alias("n_ops"), F.max("last_sesno").alias("last_sesno"))
    return out.select("refno", F.get(_composed(F.transform("maps", lambda m: m["map"])), F.lit(0)).alias("net"), "n_ops", "last_sesno")


def net_details(changes: DataFrame) -> DataFrame:
    """changes: refno, sesno, seq, op, impact.  fold_net, and model_affecting: the element is not cancelled and any of
    its operations has an impact other than skip (a null one has)."""
    some = changes.where(F.col("op").isin("A", "M", "D")).groupBy("refno").agg(F.bool_or(~F.col("impact").eqNullSafe("skip")).alias("some"))
    return fold_net(changes).join(some, "refno").select("refno", "net", "n_ops", "last_sesno", (F.col("some") & (F.col("net") != "C")).alias("model_affecting"))


def fold_attributes(changes: DataFrame, writes: DataFrame) -> DataFrame:
    """changes: refno, sesno, seq, op.  writes: refno, sesno, seq, namespace, name, kind (added, modified or deleted), old,
    new.  What a run of consecutive modifications of an element writes, as if it were one: refno, run, sesno and seq of
    its last one, namespace, name, and the last write's kind, old and new.  Of writes of one operation to one name, deleted
    comes after modified, and that after added.  Writes of other operations are left out."""
    by = Window.partitionBy("refno").orderBy("sesno", "seq")
    starts = F.when((F.col("op") == "M") & (F.coalesce(F.lag("op").over(by), F.lit("")) != "M"), 1).otherwise(0)
    marked = changes.select("refno", "sesno", "seq", "op", starts.alias("start")).withColumn("run", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("op = 'M'")
    ends = marked.groupBy("refno", "run").agg(F.max(F.struct("sesno", "seq")).alias("end"))
    order = F.struct("sesno", "seq", F.array_position(F.array(*map(F.lit, ("added", "modified", "deleted"))), F.col("kind")).alias("place"))
    rows = writes.join(marked.select("refno", "sesno", "seq", "run"), ["refno", "sesno", "seq"])
    last = rows.groupBy("refno", "run", "namespace", "name").agg(F.max_by(F.struct("kind", "old", "new"), order).alias("w"))
    return last.join(ends, ["refno", "run"]).select("refno", "run", "end.sesno", "end.seq", "namespace", "name", "w.kind", "w.old", "w.new")


def last_writer(attributes: DataFrame) -> DataFrame:
    """attributes: refno, name, value, sesno, seq.  The latest value of each attribute: a partial max, no sort."""
    return attributes.groupBy("refno", "name").agg(F.max_by("value", F.struct("sesno", "seq")).alias("value"), F.max("sesno").alias("sesno"))


def runs(changes: DataFrame, op: str = "M") -> DataFrame:
    """Gaps and islands: runs of consecutive operations of one kind, with their first and last session and size."""
    by = Window.partitionBy("refno").orderBy("sesno", "seq")
    starts = F.when((F.col("op") == op) & (F.coalesce(F.lag("op").over(by), F.lit("")) != op), 1).otherwise(0)
    marked = changes.withColumn("start", starts).withColumn("run", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col("op") == op).groupBy("refno", "run").agg(F.min("sesno").alias("first_sesno"), F.max("sesno").alias("last_sesno"), F.count("*").alias("n_ops"))


def rollup(net: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """net: refno, net.  before, after: refno, root.  Counts by root: added in its new root, deleted in its old one,
    modified in both; a change of root is moved_in in the new one and moved_out in the old one."""
    j = net.where("net <> 'C'").join(before.select("refno", F.col("root").alias("old")), "refno", "left").join(after.select("refno", F.col("root").alias("new")), "refno", "left")
    moved = F.coalesce(F.col("old") != F.col("new"), F.lit(False)) & (F.col("net") == "M")
    sides = F.array(
        F.struct(F.col("new").alias("root"), (F.col("net") == "A").alias("a"), F.lit(False).alias("d"), (F.col("net") == "M").alias("m"), moved.alias("i"), F.lit(False).alias("o")),
        F.struct(F.col("old").alias("root"), F.lit(False).alias("a"), (F.col("net") == "D").alias("d"), ((F.col("net") == "M") & moved).alias("m"), F.lit(False).alias("i"), moved.alias("o")),
    )
    flat = j.select(F.explode(sides).alias("x")).select("x.*").where("a or d or m or i or o")
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return flat.groupBy("root").agg(n("a").alias("added"), n("d").alias("deleted"), n("m").alias("modified"), n("i").alias("moved_in"), n("o").alias("moved_out"))


def labelled(counts: DataFrame, names: DataFrame, noun: str) -> DataFrame:
    """counts: root and its counts, as of rollup.  names: refno, name.  Adds id and name; what belongs to no root of the
    noun stands in one row with an empty id, named as unknown."""
    j = counts.join(names.select(F.col("refno").alias("root"), "name"), "root", "left")
    known = F.col("root").isNotNull()
    return j.select(F.when(known, F.col("root").cast("string")).otherwise("").alias("id"), F.when(known, F.coalesce("name", F.lit(""))).otherwise(f"{noun} unknown").alias("name"), *(c for c in counts.columns if c != "root"))


def buckets(operations: DataFrame) -> DataFrame:
    """operations: seq, refno, op (A, M, D), owner (of an added element), old_owner, new_owner (of a moved one), attributes
    array<string>, children_old, children_new arrays.  The events a user sees as seq, bucket, refno, each once for an
    operation: an owner's members change with what is added or moved; a move and a modification may come together."""
    event = lambda when, bucket, refno: F.when(when & refno.isNotNull(), F.struct(F.lit(bucket).alias("bucket"), refno.alias("refno")))
    c = {x: F.col(x) for x in ("refno", "owner", "old_owner", "new_owner")}
    added, gone, changed = (F.col("op") == x for x in "ADM")
    moved = changed & (c["old_owner"].isNotNull() | c["new_owner"].isNotNull())
    ordinary = F.exists("attributes", lambda a: a != "OWNER")
    members = ~F.col("children_old").eqNullSafe(F.col("children_new"))
    events = F.array(
        event(added, "Created", c["refno"]), event(added, "MemberChanged", c["owner"]), event(gone, "Deleted", c["refno"]), event(moved, "Moved", c["refno"]),
        event(moved, "MemberChanged", c["old_owner"]), event(moved, "MemberChanged", c["new_owner"]), event(changed & ordinary, "Modified", c["refno"]), event(changed & members, "MemberChanged", c["refno"]),
    )
    return operations.select("seq", F.inline(F.array_distinct(F.array_compact(events))))
