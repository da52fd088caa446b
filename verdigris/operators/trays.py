"""Electrical and equipment reports: cable trays, grounding cables, supports, boxes in groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.branches import distance
from verdigris.operators.relate import strongest

#: Words in a tray's specification and the kind they name, the first that it holds.  Fixed values.
TRAY_KINDS = [("LADDER", "梯架"), ("TROUGH", "实底托盘"), ("VENTILATED", "带孔托盘"), ("RISER", "竖梯"), ("DIVIDER", "分隔板")]
UNKNOWN_KIND = "未知类型"
MAIN, SECONDARY = "主托盘", "次托盘"
UPRIGHT, LEVEL = "竖向", "水平"


def tray_kind(spec: Column) -> Column:
    """Kind by the words in the specification's name, in any case."""
    upper = F.upper(spec)
    out = F.when(F.contains(upper, F.lit(TRAY_KINDS[0][0])), TRAY_KINDS[0][1])
    for word, kind in TRAY_KINDS[1:]:
        out = out.when(F.contains(upper, F.lit(word)), kind)
    return out.otherwise(UNKNOWN_KIND)


def tray_orientation(spec: Column) -> Column:
    upper = F.upper(spec)
    return F.when(F.contains(upper, F.lit("RISER")) | F.contains(upper, F.lit("DIVIDER")), UPRIGHT).otherwise(LEVEL)


def unit_number(site_name: Column) -> Column:
    """Second character of a site's name."""
    return F.substring(F.coalesce(site_name, F.lit("")), 2, 1)


def project_number(site_name: Column) -> Column:
    """What follows the second character in the first part of a site's name."""
    return F.substr(F.get(F.split(F.coalesce(site_name, F.lit("")), "-"), F.lit(0)), F.lit(3))


def tray_rank(site_name: Column, zone_name: Column) -> Column:
    return F.when(F.contains(site_name, F.lit("MCT")) | F.contains(zone_name, F.lit("MSUP")), MAIN).otherwise(SECONDARY)


def first_children(children: DataFrame, columns: list[str], skip: str = "ATTA") -> DataFrame:
    """children: owner, seq, noun and the named columns.  Of each owner, the first child that is no attachment; the least
    row at a tie.  Found by a partial minimum, without sorting an owner's children."""
    first = F.min_by(F.struct(*columns), F.struct("seq", *columns)).alias("f")
    return children.where(F.coalesce(F.col("noun") != skip, F.lit(True))).groupBy("owner").agg(first).select("owner", "f.*")


def tray_report(trays: DataFrame, children: DataFrame) -> DataFrame:
    """trays: refno, site_name, zone_name.  children: owner, seq, noun, spec, cover.  A row per tray; one without children
    has an empty specification and no cover."""
    first = first_children(children, ["spec", "cover"])
    spec = F.coalesce("spec", F.lit(""))
    return trays.join(first, F.col("refno") == F.col("owner"), "left").select(
        "refno", unit_number(F.col("site_name")).alias("unit"), project_number(F.col("site_name")).alias("project"), tray_rank(F.col("site_name"), F.col("zone_name")).alias("rank"),
        tray_kind(spec).alias("kind"), tray_orientation(spec).alias("orientation"), F.coalesce(F.col("cover") == 1, F.lit(False)).alias("cover"))


def cable_lengths(points: DataFrame) -> DataFrame:
    """points: cable, pos.  A cable with exactly two points has their distance, any other 0."""
    ends = points.groupBy("cable").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    return ends.select("cable", F.when(F.col("n") == 2, F.round(distance(F.col("a"), F.col("b")), 3)).otherwise(0.0).alias("length"))


def box_groups(children: DataFrame, sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    """children: equipment, group_seq, owner, noun, scale, z.  Of each equipment, the first group of only boxes and of a
    given size: its largest scale and height."""
    g = children.groupBy("equipment", "owner").agg(F.min("group_seq").alias("group_seq"), F.count("*").alias("n"), F.count_if(F.coalesce(F.col("noun") != "BOX", F.lit(True))).alias("others"), F.max("scale").alias("scale"), F.max("z").alias("z"))
    g = g.where((F.col("others") == 0) & F.col("n").isin(*sizes))
    return g.groupBy("equipment").agg(F.min_by(F.struct("scale", "z"), F.struct("group_seq", "owner")).alias("f")).select("equipment", "f.*")


def grandchildren(children: DataFrame, noun: str = "SUBE") -> DataFrame:
    """children: refno, owner, noun.  Pairs of an element and the children of its children of that noun."""
    mid = children.where(F.col("noun") == noun).select(F.col("owner").alias("root"), F.col("refno").alias("mid"))
    return mid.join(children.select(F.col("owner").alias("mid"), "refno"), "mid").select("root", "refno")


def equipment_report(equipment: DataFrame, room_edges: DataFrame, positions: DataFrame, floors: DataFrame, skip_zones: str | None = None) -> DataFrame:
    """equipment: refno, name, zone_name.  room_edges: element, room, room_num, inside_count, center_dist.  positions: refno, z.
    floors: refno, dist.  refno, name, room_num of the strongest edge, z and floor_height; empty or 0 where unknown.
    Equipment of zones whose name holds skip_zones is left out."""
    rows = equipment if skip_zones is None else equipment.where(~F.contains(F.coalesce("zone_name", F.lit("")), F.lit(skip_zones)))
    room = strongest(room_edges).select(F.col("element").alias("refno"), "room_num")
    out = rows.join(room, "refno", "left").join(positions, "refno", "left").join(floors, "refno", "left")
    return out.select("refno", "name", F.coalesce("room_num", F.lit("")).alias("room_num"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("dist", F.lit(0.0)).alias("floor_height"))
