"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans import hot
from verdigris.plans.scratch import Scratch, bounded


#: Pairs so few that one task may hold all of them.
FEW = 1_000_000


def _star(pairs: DataFrame, small: bool, scratch: Scratch, few: bool, held: list[DataFrame]) -> DataFrame:
    """pairs: (u, v), the neighbours v of u.  Links them, or those above u, to the least of them and u.  A u may have a
    large share of all pairs: beyond FEW pairs in all, such hubs are joined by broadcast."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    if few:
        linked = pairs.join(least.drop("n"), "u")
    else:
        least = scratch.keep(least, "least")
        held.append(least)
        linked = hot.join_unique(pairs, least, ["u"], "n", small=hot.SMALL)
    if small:
        return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m"))).where("a > b")
    return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges: (a, b) of integer ids, in either order, repeats and loops allowed, nulls ignored.  Returns (id,
    component), the least id that it reaches, for every id with an edge to another; ids without one have no row.
    Every round is two aggregations and two joins; labels and edges stay in tables, and each round's table replaces
    the last one's."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, "edges")
    before, few = None, bounded(e, FEW)
    for _ in range(rounds):
        held: list[DataFrame] = []
        both = e.selectExpr("a as u", "b as v").union(e.selectExpr("b as u", "a as v"))
        large = _star(both, False, scratch, few, held).distinct()
        after = scratch.keep(_star(large.selectExpr("a as u", "b as v"), True, scratch, few, held).distinct(), "stars")
        scratch.drop(e, *held)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = now
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
