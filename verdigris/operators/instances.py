"""Placed instances: boxes, transforms, shared geometry by content, stale rows, guarded rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = tuple(f"{e}_{a}" for e in ("min", "max") for a in "xyz")


def usable(prefix: str = "") -> Column:
    """All six sides of the box are finite numbers."""
    out = F.lit(True)
    for side in BOX:
        c = F.col(prefix + side)
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def union_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """The box around all usable boxes of a key."""
    return boxes.where(usable()).groupBy(key).agg(*((F.min if s.startswith("min") else F.max)(s).alias(s) for s in BOX))


def deduplicate(rows: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the digest of their content, distinct contents by digest)."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    marked = rows.withColumn("digest", digest)
    return marked.drop(*content), marked.select("digest", *content).dropDuplicates(["digest"])


def flatten(edges: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row a key with the array of its parts in order; a key's parts are few (one instance's geometry)."""
    return edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("parts"))


def unreferenced(nodes: DataFrame, edges: DataFrame, removed: DataFrame, node: str) -> DataFrame:
    """Nodes that no edge refers to once the removed edges (edge_id) are gone."""
    return nodes.join(edges.join(removed, "edge_id", "left_anti"), node, "left_anti")


def prune_stale(stored: DataFrame, produced: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored rows (root, refno) but those of the regenerated roots that the run did not produce again."""
    stale = stored.join(roots, "root", "left_semi").join(produced, ["root", "refno"], "left_anti").select("root", "refno")
    return stored.join(stale, ["root", "refno"], "left_anti")


def compose(matrices: Column) -> Column:
    """Product of an array of 4 x 4 matrices, given row by row as arrays of 16 doubles; the identity for none."""
    one = F.array(*(F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)))

    def times(a: Column, b: Column) -> Column:
        return F.array(*(sum((a[4 * (i // 4) + k] * b[4 * k + i % 4] for k in range(1, 4)), a[4 * (i // 4)] * b[i % 4]) for i in range(16)))

    return F.aggregate(matrices, one, times)


def products(rows: DataFrame, key: str, order: str, matrix: str, span: int = 256) -> DataFrame:
    """(key, matrix): the product of each key's matrices in the order of a whole number, each number once a key.  Products
    are made over spans of the numbers first, then over these, so that no array holds all matrices of a key that has many."""
    spans = rows.select(key, F.floor(F.col(order) / span).alias("span"), F.struct(F.col(order).alias("at"), F.col(matrix).alias("m")).alias("one"))
    product = lambda c: compose(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["m"]))
    part = spans.groupBy(key, "span").agg(product("one").alias("m"))
    return part.groupBy(key).agg(product(F.struct(F.col("span").alias("at"), "m")).alias(matrix))


def bearing(x: Column, y: Column) -> Column:
    """Whole degrees from the x axis, 0 to 359."""
    return F.pmod(F.round(F.degrees(F.atan2(y, x))).cast("int"), F.lit(360))


def require_coverage(indexed: int, total: int, least: float = 0.9) -> None:
    """A rebuild that cannot see enough boxes must not write an empty answer."""
    if total and indexed < least * total:
        raise RuntimeError(f"CHAIN_INCOMPLETE: {indexed} of {total} boxes are indexed")
