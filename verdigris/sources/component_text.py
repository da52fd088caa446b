"""Pipe component text: one file per branch with a keyword block per component and a list of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Component nouns that a file holds.  Fixed values.
NOUNS = ("ATTA", "ELBO", "FLAN", "GASK", "INST", "OLET", "REDU", "TEE", "VALV", "BEND", "CAP", "COUP")
#: Keyword lines of a component after its points, in their order, and the column each takes.
LINES = [("SKEY  ", "skey"), ("ANGLE        ", "angle"), ("ITEM-CODE    ", "item_code"), ("WELD-SPEC  ", "weld_spec"), ("ID-REF-NO    ", "refno"), ("BEND-RADIUS  ", "radius")]
_IN = " " * 8


def plain(number: Column) -> Column:
    """A number without exponent or trailing zeros, to six decimals."""
    return F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def _point(keyword: str, point: Column, *more: Column) -> Column:
    """Null where the point is."""
    at = F.concat(F.lit(f"{_IN}{keyword}    "), F.array_join(F.transform(point, plain), "  "))
    return F.concat(at, F.lit(" "), *more) if more else at


def component_text(parts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """parts: branch, branch_name, seq, noun, arrive, leave, centre (arrays of three), bore, and the columns of LINES.
    descriptions: item_code, description; once each.  Lines of each branch's file as branch, place, seq, text: the reference
    (place 0), a block per component by seq (1), the heading of the materials (2), and a block per item code in order
    (3).  A line whose value is null is left out; other nouns have no block.  A branch's file ends at
    its first cap: components after it are left out, from the materials too."""
    number = {"angle", "radius"}
    own = [F.concat(F.lit(_IN + key), plain(F.col(c)) if c in number else F.col(c).cast("string")) for key, c in LINES]
    ends = [_point("END-POINT", F.col(c), plain(F.col("bore"))) for c in ("arrive", "leave")]
    block = F.concat_ws("\r\n", "noun", *ends, _point("CENTRE-POINT", F.col("centre")), *own)
    before = Window.partitionBy("branch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = parts.where(F.col("noun").isin(*NOUNS)).withColumn("__capped", F.bool_or(F.col("noun") == "CAP").over(before)).where("not coalesce(__capped, false)")
    blocks = kept.select("branch", F.lit(1).alias("place"), F.col("seq").cast("bigint").alias("seq"), block.alias("text"))
    names = parts.groupBy("branch").agg(F.min("branch_name").alias("n"))
    heads = names.select("branch", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit("PIPELINE-REFERENCE      "), F.coalesce("n", F.lit(""))).alias("text")),
                                                    F.struct(F.lit(2).alias("place"), F.lit(0).cast("bigint").alias("seq"), F.lit("MATERIALS").alias("text")))))
    codes = kept.where("item_code is not null").groupBy("branch", "item_code").agg(F.min("seq").cast("bigint").alias("seq")).join(descriptions, "item_code", "left")
    item = F.concat_ws("\r\n", F.concat(F.lit("ITEM-CODE    "), F.col("item_code").cast("string")), F.concat(F.lit(f"{_IN}DESCRIPTION    "), F.col("description")))
    return heads.union(blocks).union(codes.select("branch", F.lit(3), "seq", item))


def write_component_files(lines: DataFrame, path: str) -> None:
    """A folder per branch with its lines in order; a branch's rows stream through one task into its file."""
    ordered = lines.repartition("branch").sortWithinPartitions("branch", "place", "seq")
    ordered.select("branch", "text").write.option("lineSep", "\r\n").partitionBy("branch").text(path)
