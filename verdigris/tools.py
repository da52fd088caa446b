"""Named query tools: tools.run(name, model, **arguments) -> DataFrame.

A Model names the tables that the tools read; a tool that needs a table that is not given raises DB_UNAVAILABLE.  Each
tool filters by the ids it is asked for, so that the filter reaches the scan.  Without a closure, the tools that follow
owners climb from the one element, and go down from it level by level.  Errors carry a code: INVALID_ARGUMENT,
NOT_FOUND, DB_UNAVAILABLE, CHAIN_INCOMPLETE (an owner is missing), PARSE_ERROR (a value is not what its kind asks for) or
ATTR_NOT_APPLICABLE (the element has no such attribute).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import impact, instances, tree


class ToolError(ValueError):
    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Model:
    """elements: refno, owner, seq, noun, name.  closed: refno, anc, depth.  attributes: refno, key, value.  references:
    referrer, attr, referenced.  rooms: element, room, room_num, inside_count, center_dist.  boxes: refno, min_x..max_z.
    transforms: refno, matrix.  changes: refno, op, attributes, children_changed.  pending: action, target, attempts."""

    elements: DataFrame | None = None
    closed: DataFrame | None = None
    attributes: DataFrame | None = None
    references: DataFrame | None = None
    rooms: DataFrame | None = None
    boxes: DataFrame | None = None
    transforms: DataFrame | None = None
    changes: DataFrame | None = None
    pending: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise ToolError("DB_UNAVAILABLE", name)
        return found


def parse_refno(text: str) -> int:
    """An id from a_b or a/b, both parts decimal and below 2^31 and 2^32."""
    parts = text.strip().replace("/", "_").split("_")
    if len(parts) != 2 or not all(p.isascii() and p.isdigit() for p in parts) or int(parts[0]) >= 1 << 31 or int(parts[1]) >= 1 << 32:
        raise ToolError("INVALID_ARGUMENT", text)
    return int(parts[0]) << 32 | int(parts[1])


def _one(table: DataFrame, refno: int, column: str = "refno") -> DataFrame:
    return table.where(F.col(column) == refno)


def _up(m: Model, refno: int, max_hops: int = 64) -> DataFrame:
    return _one(m.closed, refno) if m.closed is not None else tree.climb(m.table("elements"), refno, max_hops)


def _down(m: Model, refno: int) -> DataFrame:
    return _one(m.closed, refno, "anc") if m.closed is not None else tree.below(m.table("elements"), refno)


def identity(m: Model, refno: int) -> DataFrame:
    return _one(m.table("elements"), refno).select("refno", "noun", "name")


def owner_chain(m: Model, refno: int, max_hops: int = 64, strict: bool = False) -> DataFrame:
    """The element and its owners upward; complete tells that the last one has no owner, truncated that hops ran out.
    strict: an owner that is missing is an error."""
    up = _up(m, refno, max_hops)
    chain = up.where(F.col("depth") <= max_hops).join(m.table("elements").select(F.col("refno").alias("anc"), "owner", "noun", "name"), "anc")
    ends = chain.agg(F.max_by(F.col("owner").isNull(), "depth").alias("complete"))
    cut = up.agg((F.coalesce(F.max("depth"), F.lit(0)) > max_hops).alias("truncated"))
    if strict and not ends.first()["complete"] and not cut.first()["truncated"]:
        raise ToolError("CHAIN_INCOMPLETE", str(refno))
    return chain.select("depth", F.col("anc").alias("refno"), "noun", "name").join(F.broadcast(ends)).join(F.broadcast(cut))


def attributes(m: Model, refno: int, keys: list[str] | None = None) -> DataFrame:
    rows = _one(m.table("attributes"), refno)
    if not keys:
        return rows.select("key", "value")
    found = rows.where(F.col("key").isin(*keys)).select("key", "value")
    known = {r["key"] for r in found.select("key").distinct().collect()}
    if missing := [k for k in keys if k not in known]:
        raise ToolError("ATTR_NOT_APPLICABLE", ", ".join(missing))
    return found


def members(m: Model, refno: int, limit: int = 100, start: int = 0) -> DataFrame:
    if not 0 < limit <= 1000 or start < 0:
        raise ToolError("INVALID_ARGUMENT", "limit")
    return _one(m.table("elements"), refno, "owner").select("refno", "noun", "name", "seq").orderBy("seq", "refno").offset(start).limit(limit)


def transform(m: Model, refno: int) -> DataFrame:
    """World matrix: the product of the owners' matrices from the top down to the element.  A matrix that has not sixteen
    numbers is an error."""
    bad = _up(m, refno).join(m.table("transforms").where("size(matrix) <> 16 or exists(matrix, x -> x is null)").select(F.col("refno").alias("anc")), "anc", "left_semi")
    if found := bad.select("anc").first():
        raise ToolError("PARSE_ERROR", f"matrix of {found['anc']}")
    up = _up(m, refno).join(m.table("transforms").select(F.col("refno").alias("anc"), "matrix"), "anc")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("level"), "matrix"))), lambda s: s["matrix"])
    return up.groupBy("refno").agg(instances.compose(ordered).alias("matrix"))


def geometry_parameters(m: Model, refno: int) -> DataFrame:
    return _one(m.table("attributes"), refno).where(impact.attribute_effect(F.col("key")) == "geometry").select("key", "value")


def catalog_references(m: Model, refno: int) -> DataFrame:
    return _one(m.table("references"), refno, "referrer").where("attr <> 'OWNER'").select("attr", "referenced")


def room_lookup(m: Model, refno: int) -> DataFrame:
    """Rooms that hold the element, the strongest first."""
    return _one(m.table("rooms"), refno, "element").select("room", "room_num", "inside_count", "center_dist").orderBy(F.desc("inside_count"), "center_dist", "room_num")


def generation_root(m: Model, refno: int) -> DataFrame:
    return impact.generation_roots(m.table("elements"), _up(m, refno))


def change_impact(m: Model, refno: int) -> DataFrame:
    rows = _one(m.table("changes"), refno).join(m.table("elements").select("refno", "noun"), "refno", "left")
    return rows.select("refno", "op", impact.operation_impact(F.col("op"), F.col("attributes"), F.col("children_changed"), F.coalesce("noun", F.lit(""))).alias("impact"))


def pending_units(m: Model, action: str | None = None, limit: int = 100) -> DataFrame:
    rows = m.table("pending")
    return (rows.where(F.col("action") == action) if action else rows).orderBy("action", "target").limit(limit)


def spatial_bounds(m: Model, refno: int) -> DataFrame:
    """The box around the usable boxes of the element's subtree."""
    below = _down(m, refno).select("refno", F.col("anc").alias("root"))
    return instances.union_boxes(m.table("boxes").join(below, "refno"), "root")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "element.identity": identity,
    "element.owner_chain": owner_chain,
    "element.attributes": attributes,
    "element.members": members,
    "element.transform": transform,
    "geometry.parameters": geometry_parameters,
    "catalog.references": catalog_references,
    "room.lookup": room_lookup,
    "model.generation_root": generation_root,
    "model.change_impact": change_impact,
    "model.pending_units": pending_units,
    "spatial.bounds": spatial_bounds,
}


def run(name: str, model: Model, **arguments: object) -> DataFrame:
    if name not in TOOLS:
        raise ToolError("NOT_FOUND", name)
    return TOOLS[name](model, **arguments)
