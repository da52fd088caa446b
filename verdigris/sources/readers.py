"""Readers and writers of the engine's file forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def attribute_dump(spark: SparkSession, path: str) -> DataFrame:
    """Attribute dumps: blocks NEW name ... END, nested, with KEY:= value lines; `unset` is null, keys with a leading
    colon are user attributes.  A file's lines are numbered where they lie, so a file is one task: (file, ord, section,
    key, value, user)."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    t = F.trim("line")
    opens, closes = F.upper(t).rlike("^NEW( |$)"), F.upper(t) == "END"
    w = Window.partitionBy("file").orderBy("ord")
    marked = lines.select("file", "ord", t.alias("t"), F.when(opens, F.trim(F.substring(t, 4, 10_000))).alias("opened"), (F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w)).alias("depth"))
    inside = Window.partitionBy("file", "depth").orderBy("ord")
    parts = F.split("t", ":=", 2)
    section = F.last("opened", ignorenulls=True).over(inside)
    out = marked.withColumn("section", section).where(F.col("t").contains(":="))
    key, value = F.trim(parts[0]), F.trim(parts[1])
    return out.select("file", "ord", "section", key.alias("key"), F.when(F.lower(value) != "unset", value).alias("value"), key.startswith(":").alias("user"))


def holes(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of hole records, the position split into three numbers; records that share a key all stay."""
    rows = spark.read.option("multiLine", True).json(path)
    xyz = F.split("Position", ",")
    return rows.withColumn("position", F.struct(*(F.trim(xyz[i]).try_cast("double").alias(a) for i, a in enumerate("xyz"))))


def write_report(df: DataFrame, path: str) -> None:
    """Plain CSV with CRLF and no quoting."""
    df.write.option("header", True).option("quote", "").option("lineSep", "\r\n").csv(path)
