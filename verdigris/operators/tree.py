"""Owner trees: closure, ancestors, descendants, siblings, generation roots.

A tree is a table of elements: refno, owner (null at the top), seq, noun.  `closure` materialises every element's
ancestors once, as (refno, anc, depth) rows and as an array ordered from the element up; every hierarchy query is an
equi-join on it.  Trees that hold a cycle end where a path would meet itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans.scratch import Scratch


def _down(nodes: DataFrame, scratch: Scratch, carry: Sequence[str] = ()) -> DataFrame | None:
    """nodes: refno, owner and the columns to carry.  (refno, path) of all that hangs below elements without an owner, one
    level a round: each element meets its owner's path once, and small levels are broadcast by Spark's own size check."""
    own = F.struct(F.col("refno").alias("anc"), *carry)
    below = nodes.where("owner is not null").select(F.col("refno").alias("child"), "owner", F.struct(F.col("refno").alias("anc"), *carry).alias("item"))
    level = scratch.keep(nodes.where("owner is null").select("refno", F.array(own).alias("path")), "level")
    reached = None
    while not level.isEmpty():
        reached = level if reached is None else reached.union(level)
        grown = below.join(level, below["owner"] == level["refno"]).where(~F.exists("path", lambda x: x["anc"] == F.col("child")))
        level = scratch.keep(grown.select(F.col("child").alias("refno"), F.concat(F.array("item"), "path").alias("path")), "level")
    return reached


def paths(elements: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(refno, path): the element and its owners upward, as an array of structs of anc and the carried columns, so that
    what asks for a nearest owner needs no join.  Paths end at a missing owner, or where they would meet themselves."""
    scratch = Scratch(elements.sparkSession)
    nodes = scratch.keep(elements.select("refno", "owner", *carry), "nodes")
    reached = _down(nodes, scratch, carry)
    rest = nodes if reached is None else scratch.keep(nodes.join(reached.select("refno"), "refno", "left_anti"), "rest")
    if reached is not None and rest.isEmpty():
        return reached
    up = _upward(rest, nodes, None, scratch).join(nodes.select(F.col("refno").alias("anc"), *carry), "anc")
    up = up.groupBy("refno").agg(F.array_sort(F.collect_list(F.struct("depth", "anc", *carry))).alias("path"))
    up = up.select("refno", F.transform("path", lambda x: F.struct(x["anc"].alias("anc"), *(x[c].alias(c) for c in carry))).alias("path"))
    return up if reached is None else reached.union(up)


def nearest_in_path(found: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """found: refno, path.  (refno, root, depth) of the nearest self-or-owner whose struct passes the test."""
    placed = F.transform("path", lambda x, i: F.struct(x.alias("x"), i.alias("depth")))
    first = F.get(F.filter(placed, lambda p: test(p["x"])), F.lit(0))
    return found.select("refno", first.alias("n")).where("n is not null").select("refno", F.col("n.x.anc").alias("root"), F.col("n.depth").alias("depth"))


def climb(elements: DataFrame, refno: int, max_hops: int = 64) -> DataFrame:
    """(refno, anc, depth) of one element, by a point read of each owner in turn; none where the element is missing."""
    spark, chain, at = elements.sparkSession, [], refno
    while at is not None and len(chain) <= max_hops + 1 and at not in chain:
        found = elements.where(F.col("refno") == at).select("owner").first()
        if found is None:
            break
        chain.append(at)
        at = found["owner"]
    return spark.createDataFrame([(refno, a, i) for i, a in enumerate(chain)], "refno bigint, anc bigint, depth int")


def below(elements: DataFrame, refno: int) -> DataFrame:
    """(refno, anc, depth) of one element and all below it: one join a level, of that level only."""
    scratch = Scratch(elements.sparkSession)
    level = scratch.keep(elements.where(F.col("refno") == refno).select("refno").distinct(), "level")
    out, depth = level.select("refno", F.lit(refno).cast("bigint").alias("anc"), F.lit(0).alias("depth")), 0
    while not level.isEmpty():
        depth += 1
        grown = elements.select("refno", "owner").join(level.select(F.col("refno").alias("owner")), "owner", "left_semi").select("refno")
        level = scratch.keep(grown.join(out.select("refno"), "refno", "left_anti"), "level")
        out = out.union(level.select("refno", F.lit(refno).cast("bigint"), F.lit(depth)))
    return out


def closure(elements: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(refno, anc, depth), the element itself at depth 0.  Goes down from the elements without an owner; what that does
    not reach (owners that are not in the table, cycles) goes up from each element instead.  An id that comes twice has
    the paths of each of its rows."""
    scratch = Scratch(elements.sparkSession)
    nodes = scratch.keep(elements.select("refno", "owner"), "nodes")
    reached = _down(nodes, scratch)
    rest = nodes if reached is None else scratch.keep(nodes.join(reached.select("refno"), "refno", "left_anti"), "rest")
    parts = [] if reached is None else [reached.select("refno", F.posexplode("path").alias("depth", "x")).select("refno", "x.anc", "depth")]
    if not parts or not rest.isEmpty():
        parts.append(_upward(rest, nodes, max_hops, scratch))
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return out if max_hops is None else out.where(F.col("depth") <= max_hops)


def _upward(starts: DataFrame, nodes: DataFrame, max_hops: int | None, scratch: Scratch) -> DataFrame:
    """Joins one level a round until no path grows, each on the rows that the last round added."""
    parents = nodes.select(F.col("refno").alias("of"), F.col("owner").alias("up")).where("up is not null")
    step = scratch.keep(starts.select("refno", F.col("refno").alias("anc"), F.lit(0).alias("depth"), F.array("refno").alias("path")), "up")
    levels, depth = step, 0
    while max_hops is None or depth < max_hops:
        grown = step.join(parents, step["anc"] == parents["of"]).where(~F.array_contains("path", F.col("up")))
        step = scratch.keep(grown.select("refno", F.col("up").alias("anc"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("up")).alias("path")), "up")
        depth += 1
        if step.isEmpty():
            break
        levels = levels.union(step)
    return levels.select("refno", "anc", "depth")


def with_ancestors(elements: DataFrame, closed: DataFrame) -> DataFrame:
    """Adds anc, the array of ancestors from the element up."""
    up = closed.groupBy("refno").agg(F.array_sort(F.collect_list(F.struct("depth", "anc"))).alias("a"))
    return elements.join(up.select("refno", F.transform("a", lambda x: x["anc"]).alias("anc")), "refno")


def descendants(closed: DataFrame, roots: DataFrame) -> DataFrame:
    """Elements below or at the given roots (refno): an equi-join on the ancestor column."""
    return closed.join(roots.select(F.col("refno").alias("anc")), "anc").select(F.col("anc").alias("root"), "refno", "depth")


def nearest_ancestor(elements: DataFrame, closed: DataFrame, nouns: Column) -> DataFrame:
    """(refno, root, depth): the nearest self-or-ancestor whose noun satisfies the condition."""
    kinds = elements.select(F.col("refno").alias("anc"), "noun").where(nouns)
    return closed.join(kinds, "anc").groupBy("refno").agg(F.min(F.struct("depth", "anc")).alias("n")).select("refno", F.col("n.anc").alias("root"), F.col("n.depth").alias("depth"))


#: Children that a task puts in order, but for an owner that has more.
CHILDREN = 250_000


def _by_owner(elements: DataFrame) -> DataFrame:
    """Elements that have an owner, dealt by it to as many partitions as their number needs, so that what a task sorts does
    not grow with the table."""
    kept = Scratch(elements.sparkSession).keep(elements.where("owner is not null"), "children")
    n = max(int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // CHILDREN))
    return kept.repartition(n, "owner")


def siblings(elements: DataFrame) -> DataFrame:
    """Adds ordinal, same_noun_ordinal, prev and next, first and last among the owner's children by (seq, refno)."""
    w = Window.partitionBy("owner").orderBy("seq", "refno")
    noun = Window.partitionBy("owner", "noun").orderBy("seq", "refno")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _by_owner(elements).select(
        "*",
        F.row_number().over(w).alias("ordinal"),
        F.row_number().over(noun).alias("same_noun_ordinal"),
        F.lag("refno").over(w).alias("prev"),
        F.lead("refno").over(w).alias("next"),
        F.first("refno").over(whole).alias("first_child"),
        F.last("refno").over(whole).alias("last_child"),
    )


def neighbours_skipping(elements: DataFrame, skipped: Column) -> DataFrame:
    """Adds prev_kept and next_kept: the nearest siblings before and after that the condition does not skip.  Both carry
    the last one on, up and down the order: a frame that ends at the last sibling is read anew for each row."""
    kept = F.when(~skipped, F.col("refno"))
    up = Window.partitionBy("owner").orderBy("seq", "refno").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("owner").orderBy(F.desc("seq"), F.desc("refno")).rowsBetween(Window.unboundedPreceding, -1)
    return _by_owner(elements).select("*", F.last(kept, ignorenulls=True).over(up).alias("prev_kept"), F.last(kept, ignorenulls=True).over(down).alias("next_kept"))


def pack_refno(ref0: Column, ref1: Column) -> Column:
    return F.shiftleft(ref0.cast("bigint"), 32).bitwiseOR(ref1.cast("bigint"))


#: Short nouns that are not the first four letters of the long one.  Fixed values.
SHORT_NOUNS = {"TUBE": "TUBI", "TUBING": "TUBI", "SUPPORT": "SUPPO"}


def short_noun(noun: Column) -> Column:
    """Of a noun written in full: its first four letters, but for a few."""
    names = F.create_map(*(F.lit(x) for pair in SHORT_NOUNS.items() for x in pair))
    upper = F.upper(noun)
    return F.coalesce(F.try_element_at(names, upper), F.substring(upper, 1, 4))


def refno_text(refno: Column) -> Column:
    return F.concat_ws("_", F.shiftright(refno, 32), refno.bitwiseAND(F.lit((1 << 32) - 1)))
