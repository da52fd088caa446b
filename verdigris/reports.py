"""Discipline reports: surface of branches, name rules, searches and classification by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.texts import like_star
from verdigris.plans.scratch import Scratch, bounded

#: Parts and names that may be broadcast.
MOST_PARTS = 200_000


def branch_surface(components: DataFrame, bores: DataFrame) -> DataFrame:
    """components: branch, seq, noun, length, own_bore.  bores: branch, place, bore.  Sum of bore x pi x length along each
    branch.  The bore in force is the branch's one at the place that counts the reducers so far, a reducer included;
    beyond the list, or at a reducer that ends the branch, it is the component's own."""
    w = Window.partitionBy("branch").orderBy("seq")
    place = F.count_if(F.col("noun") == "REDU").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("seq").over(w).isNull() & (F.col("noun") == "REDU")
    j = components.select("*", place.alias("place"), last.alias("__last")).join(bores, ["branch", "place"], "left")
    bore = F.when(F.col("__last"), F.col("own_bore")).otherwise(F.coalesce("bore", "own_bore"))
    return j.groupBy("branch").agg(F.sum("length").alias("length"), F.sum(bore * F.lit(3.141592653589793) * F.col("length")).alias("surface"))


def default_name(noun: Column, ordinal: Column, owner_name: Column) -> Column:
    return F.concat_ws(" ", noun, ordinal.cast("string"), F.lit("of"), owner_name)


def parse_default_name(name: Column) -> Column:
    """Struct noun, ordinal, owner of a name NOUN n of OWNER; nulls where it is none."""
    pattern = r"^(\S+) (\d+) of (.+)$"
    part = lambda i: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i))
    return F.struct(part(1).alias("noun"), part(2).cast("int").alias("ordinal"), part(3).alias("owner"))


def vague_search(rows: DataFrame, name: str, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """Names that hold all of `every`, one of `some` if there are any, and none of `none`; * stands for any run."""
    hit = lambda p: like_star(F.col(name), f"*{p}*")
    keep = F.lit(True)
    for p in every:
        keep = keep & hit(p)
    for p in none:
        keep = keep & ~hit(p)
    if some:
        one = F.lit(False)
        for p in some:
            one = one | hit(p)
        keep = keep & one
    return rows.where(keep)


def classify_by_name(rows: DataFrame, key: str, name: str, rules: DataFrame, otherwise: str, most_rules: int = 1000) -> DataFrame:
    """rules: code, part.  Adds code: that of the longest part that the name holds (ties: the least), else `otherwise`.
    key tells the rows apart.  Up to most_rules rules are one array that every row is held against; beyond that, the
    stretches of each different name that are as long as some part are joined to the parts.  Parts and names are broadcast
    up to MOST_PARTS, by count; Spark's own guess takes the stretches for as small as the names and would broadcast them."""
    used = rules.select("code", "part").where("length(part) > 0")
    if bounded(rules, most_rules):
        listed = used.agg(F.array_sort(F.collect_set(F.struct((-F.length("part")).alias("l"), "code", "part"))).alias("__rules"))
        first = F.get(F.filter("__rules", lambda r: F.contains(F.col(name), r["part"])), F.lit(0))["code"]
        return rows.join(F.broadcast(listed)).withColumn("code", F.coalesce(first, F.lit(otherwise))).drop("__rules")
    scratch = Scratch(rows.sparkSession)

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if bounded(df, MOST_PARTS) else df.hint("merge")

    best = scratch.keep(used.groupBy("part").agg(F.min("code").alias("code")), "parts")
    # as many lengths as the longest part has characters, at most
    lengths = F.array(*(F.lit(r[0]) for r in best.select(F.length("part")).distinct().collect())).cast("array<int>")
    long = rows.select(F.col(name).alias("__name")).where("__name is not null").distinct().withColumn("__n", F.explode(F.filter(lengths, lambda n: n <= F.length("__name"))))
    stretches = F.transform(F.sequence(F.lit(1), F.length("__name") - F.col("__n") + 1), lambda i: F.substring(F.col("__name"), i, F.col("__n")))
    held = long.select("__name", F.explode(F.array_distinct(stretches)).alias("part"))
    found = scratch.keep(held.join(small(best), "part").groupBy("__name").agg(F.min_by("code", F.struct(-F.length("part"), "code")).alias("__code")), "found")
    return rows.join(small(found), F.col(name) == F.col("__name"), "left").select(*rows.columns, F.coalesce("__code", F.lit(otherwise)).alias("code"))


def step_value(value: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """A step function: the result of the first upper bound that the value does not exceed."""
    out = F.when(value <= steps[0][0], steps[0][1])
    for top, result in steps[1:]:
        out = out.when(value <= top, result)
    return out.otherwise(beyond)


def first_range_rule(rows: DataFrame, key: str, rules: DataFrame, size: Column, pattern: Column, material: Column, most_rules: int = 10_000) -> DataFrame:
    """rules: rule, pattern, lo, hi, excluded (array), and results.  Adds the results of the rule with the least number
    whose pattern is the row's, whose range [lo, hi) holds the size and that doesn't exclude the material; nulls where
    there is none.  The join is on the pattern; rule tables that people write are broadcast up to most_rules, by count."""
    results = [c for c in rules.columns if c not in ("rule", "pattern", "lo", "hi", "excluded")]
    small = F.broadcast(rules) if bounded(rules, most_rules) else rules
    marked = rows.select("*", size.alias("__size"), pattern.alias("__pattern"), material.alias("__material"))
    fits = (F.col("__pattern") == F.col("pattern")) & (F.col("__size") >= F.col("lo")) & (F.col("__size") < F.col("hi")) & ~F.coalesce(F.array_contains("excluded", F.col("__material")), F.lit(False))
    hit = marked.join(small, fits).groupBy(key).agg(F.min_by(F.struct(*results), "rule").alias("__r"))
    return rows.join(hit.select(key, "__r.*"), key, "left")


def stiffeners(ducts: DataFrame, rules: DataFrame, weights: DataFrame) -> DataFrame:
    """ducts: refno, width, height, length, shape, material.  rules give section and expr, weights (one rule a shape) scale.
    Section, length in metres and weight of a duct's stiffeners: none for exp0, one frame for exp1, one frame each whole
    800 of length for exp2; without a rule the section is '-' and the length 0."""
    largest = F.greatest("width", "height")
    j = first_range_rule(ducts, "refno", rules, largest, F.col("shape"), F.col("material"))
    j = first_range_rule(j, "refno", weights, largest, F.col("shape"), F.col("material"))
    around = F.col("width") + F.col("height")
    frames = F.round(F.col("length") / 800 - 0.5)
    metres = F.when(F.col("expr") == "exp1", (around + 83) * 2 / 1000).when(F.col("expr") == "exp2", (around + 103) * frames * 2 / 1000).otherwise(0.0)
    return j.select("refno", F.coalesce("section", F.lit("-")).alias("section"), metres.alias("metres"), (F.coalesce("scale", F.lit(0.0)) * metres).alias("weight"))
