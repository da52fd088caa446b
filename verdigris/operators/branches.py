"""Piping along branches: neighbours, lengths, valves, bends and reference hops between branches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans.scratch import Scratch

#: Places in a valve's catalogue parameters (from 0) by the letter in its name.  Fixed values.
VALVE_PLACES = {"weight": (14, 10), "x": (11, 7), "y": (12, 8), "z": (13, 9)}
#: Materials by the number in the fourth part of a branch's name.  Fixed values.
VALVE_MATERIALS = ("SS", "GS", "CS", "ACS", "ASS", "AS", "FP")


def neighbours(parts: DataFrame, columns: Sequence[str] = ("noun",), owner: str = "branch", seq: str = "seq") -> DataFrame:
    """Adds prev_<c> and next_<c>: the value in the row before and after under the same owner, null at the ends."""
    w = Window.partitionBy(owner).orderBy(seq)
    return parts.select("*", *(f(c).over(w).alias(f"{side}_{c}") for c in columns for side, f in (("prev", F.lag), ("next", F.lead))))


def distance(a: Column, b: Column) -> Column:
    """Between two points; 0 if either is null or they differ in length."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.when(F.size(a) == F.size(b), F.sqrt(square)), F.lit(0.0))


def component_length(noun: Column, rins: Column, angle: Column, scale: Column, legs: Column, arrive: Column, leave: Column) -> Column:
    """Elbows and bends: their arc; tees: the sum of their legs; all else: from the arrive to the leave point."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    arc = (zero(rins) + 1) / 2 * F.radians(zero(angle)) * zero(scale)
    return F.when(noun.isin("ELBO", "BEND"), arc).when(noun == "TEE", zero(F.aggregate(legs, F.lit(0.0), lambda s, x: s + zero(x)))).otherwise(distance(arrive, leave))


def branch_lengths(components: DataFrame, tubes: DataFrame) -> DataFrame:
    """components: branch, length.  tubes: branch, length.  One row per branch in either, with both sums and their total;
    a single shuffle, summed before it."""
    both = components.select("branch", F.lit(0.0).alias("t"), F.col("length").alias("c")).union(tubes.select("branch", "length", F.lit(0.0)))
    sums = both.groupBy("branch").agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("tube_length"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("component_length"))
    return sums.withColumn("length", F.col("tube_length") + F.col("component_length"))


def bend_length(angle: Column, radius: Column) -> Column:
    """Arc of a bend in a bulk report, with the report's own pi."""
    return F.round(F.coalesce(angle, F.lit(0.0)) / 360 * 2 * 3.1415 * F.coalesce(radius, F.lit(0.0)), 2)


def spec_code(name: Column) -> Column:
    """CODE of a specification name /x/CODE:...; empty if it has none."""
    return F.coalesce(F.get(F.split(F.get(F.split(name, "/"), F.lit(2)), ":"), F.lit(0)), F.lit(""))


def valve_parameter(name: Column, para: Column, what: str) -> Column:
    """weight, x, y or z of a valve from its catalogue name and parameters; a name with R as its fifth letter has them
    in other places."""
    special, usual = (F.coalesce(F.get(para, F.lit(i)), F.lit(0.0)) for i in VALVE_PLACES[what])
    return F.round(F.when(F.coalesce(F.substring(name, 5, 1), F.lit("")) == "R", special).otherwise(usual), 2)


def valve_report(parts: DataFrame, near: float = 0.01) -> DataFrame:
    """parts: branch, seq, refno, noun, branch_name, pos array<double>, catalogue string, para array<double>.  A row per
    valve; it is supported where the part before it is an attachment at the same place."""
    n = neighbours(parts, ("noun", "pos")).where("noun = 'VALV'")
    supported = (F.col("prev_noun") == "ATTA") & F.col("prev_pos").isNotNull() & F.col("pos").isNotNull() & (distance(F.col("prev_pos"), F.col("pos")) < near)
    belongs = F.get(F.split(F.substr(F.col("branch_name"), F.lit(2)), "-"), F.lit(0))
    return n.select("refno", F.coalesce(belongs, F.lit("")).alias("belongs"), (F.coalesce(F.get("para", F.lit(1)), F.lit(0.0)) * 2).alias("length"),
                    *(valve_parameter(F.col("catalogue"), F.col("para"), w).alias(w) for w in VALVE_PLACES), F.coalesce(supported, F.lit(False)).alias("supported"))


def valve_material(branch_name: Column) -> Column:
    """By the number in the fourth part of the branch's name; null beyond the list."""
    at = F.get(F.split(branch_name, "-"), F.lit(3)).try_cast("int")
    return F.get(F.array(*map(F.lit, VALVE_MATERIALS)), at - 1)


def first_branch_by_site(starts: DataFrame, hops: DataFrame, sites: DataFrame, word: str = "PIPE", max_hops: int | None = None) -> DataFrame:
    """starts: refno, target.  hops: refno, target (each element's onward reference, one at most).  sites: refno, branch,
    site_name.  Follows references until the element reached lies under a site whose name holds `word`; refno, branch and
    hops of the first, truncated false.  A path that ends, or meets itself, has no row; one that is still under way after
    max_hops has a row without branch, truncated true.  Each hop is one join, kept, from those not yet settled."""
    scratch = Scratch(starts.sparkSession)
    good = sites.where(F.contains("site_name", F.lit(word))).select(F.col("refno").alias("at"), "branch")
    onward = hops.select(F.col("refno").alias("at"), F.col("target").alias("to"))
    here = starts.select(F.col("refno").alias("start"), F.col("target").alias("at"), F.array().cast(f"array<{starts.schema['target'].dataType.simpleString()}>").alias("path")).where("at is not null")
    out, n = None, 0
    while True:
        n += 1
        reached = scratch.keep(here.join(good, "at", "left"), "reached")
        found = reached.where("branch is not null").select(F.col("start").alias("refno"), "branch", F.lit(n).alias("hops"), F.lit(False).alias("truncated"))
        out = found if out is None else out.union(found)
        moves = reached.where("branch is null").join(onward, "at").where(F.col("to").isNotNull() & (F.col("to") != F.col("at")) & ~F.array_contains("path", F.col("to")))
        here = scratch.keep(moves.select("start", F.col("to").alias("at"), F.concat("path", F.array("at")).alias("path")), "here")
        if here.isEmpty():
            return out
        if n == max_hops:
            return out.union(here.select("start", F.lit(None).cast(out.schema["branch"].dataType), F.lit(n), F.lit(True)))
