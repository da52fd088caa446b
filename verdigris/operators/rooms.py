"""Rooms: which panels bound them by name, what lies in them, and their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import instances
from verdigris.operators.relate import AXES, box_pairs, in_blocks, real_box, strongest
from verdigris.plans.scratch import Scratch


def room_panels(elements: DataFrame, closed: DataFrame, keywords: list[str], number: str = "^[A-Z][0-9]{3}$") -> DataFrame:
    """(room, room_num, panel).  Rooms are frameworks (FRMW, panels one or two levels below) and subframes (SBFR, panels one
    level below) whose name holds a keyword; the room number is what follows the last hyphen, and has to have the form
    of one.  elements: refno, noun, name."""
    named = F.lit(False)
    for k in keywords:
        named = named | F.contains("name", F.lit(k))
    num = F.element_at(F.split("name", "-"), -1)
    rooms = elements.where(F.col("noun").isin("FRMW", "SBFR") & named & num.rlike(number)).select(F.col("refno").alias("room"), num.alias("room_num"), F.when(F.col("noun") == "FRMW", 2).otherwise(1).alias("reach"))
    below = closed.where("depth between 1 and 2").join(rooms, F.col("anc") == F.col("room")).where("depth <= reach")
    return below.join(elements.where("noun = 'PANE'").select("refno"), "refno", "left_semi").select("room", "room_num", F.col("refno").alias("panel"))


def _inside(point: list[Column], panel: str, planes: bool) -> Column:
    """Whether a point lies in the panel with this prefix: in its box, and on the inner side of its planes, if it has any
    (array of structs a, b, c, d with a x + b y + c z <= d inside)."""
    out = F.lit(True)
    for a, at in zip(AXES, point, strict=True):
        out = out & (at >= F.col(f"{panel}min_{a}")) & (at <= F.col(f"{panel}max_{a}"))
    if planes:
        out = out & F.forall(F.coalesce(F.col(f"{panel}planes"), F.array().cast(PLANES)), lambda p: p["a"] * point[0] + p["b"] * point[1] + p["c"] * point[2] <= p["d"])
    return out


#: Type of a panel's planes.
PLANES = "array<struct<a:double,b:double,c:double,d:double>>"


def _no_panels(parts: DataFrame, panels: DataFrame, least: float) -> DataFrame:
    """The parts that are no panels; refused where fewer than `least` of all parts' boxes are usable."""
    seen = parts.agg(F.count("*").alias("n"), F.count_if(instances.usable()).alias("usable")).first()
    instances.require_coverage(seen["usable"], seen["n"], least)
    return parts.where("element is not null").join(panels.select(F.col("panel").alias("element")).hint("merge"), "element", "left_anti")


def _corners(planes: bool) -> Column:
    """How many of the eight corners of a pair's left box lie in its right one."""
    corners = [[F.col(f"left_{e}_{a}") for e in ("min", "max")] for a in AXES]
    if planes:
        return sum((_inside([x, y, z], "right_", True).cast("int") for x in corners[0] for y in corners[1] for z in corners[2]), F.lit(0))
    within = [sum(((at >= F.col(f"right_min_{a}")) & (at <= F.col(f"right_max_{a}"))).cast("int") for at in ends) for a, ends in zip(AXES, corners, strict=True)]
    return within[0] * within[1] * within[2]


def _apart() -> Column:
    """How far the centres of a pair's boxes are apart."""
    return F.sqrt(sum((((F.col(f"left_min_{a}") + F.col(f"left_max_{a}")) - (F.col(f"right_min_{a}") + F.col(f"right_max_{a}"))) / 2) ** 2 for a in AXES))


def room_members(parts: DataFrame, panels: DataFrame, points: DataFrame, cell: float, least: float = 0.9) -> DataFrame:
    """parts: element and a box.  panels: panel, room_num, a box and, if they are no boxes themselves, planes.  points:
    element, x, y, z, its geometry in the world.  (panel, element, inside_count, center_dist, room_num).  Of a part's eight
    corners, all inside make it a member, none leave it out, and with one to seven inside it is a member if any of its
    points is.  Panels are no members.  Boxes that are not finite are in no room; a build that sees fewer than `least` of
    the parts' boxes is refused, as it could not tell an empty room from an unknown one.  An element's points are one array."""
    planes = "planes" in panels.columns
    real = _no_panels(parts, panels, least)
    whole = points.where(" and ".join(f"{a} is not null and not isnan({a})" for a in AXES)).groupBy("element")
    whole = whole.agg(*(f(a).alias(f"at_{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES), F.collect_list(F.struct(*AXES)).alias("at"))
    real = real.select(F.col("element").alias("id"), "element", *instances.BOX).join(whole.hint("merge"), "element", "left").drop("element")
    own = panels.select(F.col("panel").alias("id"), "room_num", *instances.BOX, *(["planes"] if planes else []))
    # pairs carry all that is asked of them: there may be many more pairs than parts, and none of them is shuffled
    j = box_pairs(real, own, cell)
    met, held = F.lit(True), F.lit(not planes)
    for a in AXES:
        low, high = (F.col(f"left_at_{e}_{a}") for e in ("min", "max"))
        met = met & (low <= F.col(f"right_max_{a}")) & (high >= F.col(f"right_min_{a}"))
        held = held & (low >= F.col(f"right_min_{a}")) & (high <= F.col(f"right_max_{a}"))
    # the points' own box tells of most pairs whether one of them is inside
    proved = met & (held | F.exists("left_at", lambda at: _inside([at[a] for a in AXES], "right_", planes)))
    j = j.select(F.col("right_id").alias("panel"), F.col("left_id").alias("element"), _corners(planes).alias("inside_count"), _apart().alias("center_dist"), F.col("right_room_num").alias("room_num"), proved.alias("proved"))
    return j.where("inside_count = 8 or (inside_count > 0 and proved)").drop("proved")


#: Grids of strongest_members, each half as wide as the one before; panels that a part's own cell holds in the grid it
#: begins with; and grids that it is asked in.
GRIDS, NEAR, ROUNDS = 17, 2, 3


def strongest_members(parts: DataFrame, panels: DataFrame, points: DataFrame, cell: float, least: float = 0.9, digits: int | None = None) -> DataFrame:
    """relate.strongest of room_members, with distances rounded to so many digits, without its pairs: (element, room,
    inside_count, center_dist, room_num).  No panel is stronger than one that holds all corners, but a nearer one that does
    so too.  A part is asked in the finest grid in which its own cell holds NEAR centres of panels, whose 27 cells about it
    hold all that are no farther than a cell is wide: a room found there within that distance is the strongest.  Parts without
    one are asked in wider grids, ROUNDS in all, and what is left (parts that no room near holds whole) meets all panels that
    touch it.  Of panels with the same box and planes only the one of least number can be a part's room."""
    scratch = Scratch(parts.sparkSession)
    planes = ["planes"] if "planes" in panels.columns else []
    own = panels.where(real_box()).groupBy(*instances.BOX, *planes).agg(F.min(F.struct("room_num", "panel")).alias("p")).select("p.*", *instances.BOX, *planes)
    own = scratch.keep(own, "panels")
    real = _no_panels(parts, panels, least).where(real_box()).select("element", *instances.BOX)
    real = scratch.keep(real.withColumn("row", F.monotonically_increasing_id()), "parts")

    def wide(grid: Column) -> Column:
        return F.lit(float(cell)) / F.pow(F.lit(2.0), grid)

    def at(a: str, grid: str = "grid") -> Column:
        return F.floor((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 / wide(F.col(grid)))

    def dealt(df: DataFrame, grids: list[int], most: float) -> DataFrame:
        """Each row in its cell of each of the grids; cells with numbers so large that doubles cannot tell them are left out."""
        df = df.withColumn("grid", F.explode(F.array(*map(F.lit, grids))))
        for a in AXES:
            df = df.where(F.abs((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 / wide(F.col("grid"))) < most)
        return df.withColumns({f"c{a}": at(a) for a in AXES})

    keys = ["grid", *(f"c{a}" for a in AXES)]
    held = dealt(own, list(range(GRIDS)), 2e9).groupBy(*keys).agg(F.count("*").alias("n")).where(f"n >= {NEAR}").drop("n")
    first = dealt(real, list(range(GRIDS)), 1e9).join(held.hint("merge"), keys).groupBy("row").agg(F.max("grid").alias("grid"))
    todo = scratch.keep(real.join(first.hint("merge"), "row", "left"), "todo")
    rest, best = todo.where("grid is null").drop("grid"), []
    near = F.col("center_dist") if digits is None else F.round("center_dist", digits)
    for _ in range(ROUNDS):
        grids = sorted(r[0] for r in todo.where("grid is not null").select("grid").distinct().collect())
        if not grids:
            break
        asked = todo.where("grid is not null")
        about = asked
        for a in AXES:
            about = about.withColumn(f"c{a}", F.explode(F.sequence(at(a) - 1, at(a) + 1)))
        bound = wide(F.col("grid")) * (1 - 1e-6)
        about = about.select(*keys, (bound if digits is None else F.round(bound, digits)).alias("bound"), *(F.col(c).alias(f"left_{c}") for c in ("row", *instances.BOX)))
        there = dealt(own, grids, 2e9).select(*keys, *(F.col(c).alias(f"right_{c}") for c in own.columns))
        pairs = in_blocks(about, there, keys, ("left_row", "right_panel"))
        for a in AXES:
            pairs = pairs.where((F.col(f"left_min_{a}") >= F.col(f"right_min_{a}")) & (F.col(f"left_max_{a}") <= F.col(f"right_max_{a}")))
        if planes:
            pairs = pairs.where(_corners(True) == 8)
        pairs = pairs.select(F.col("left_row").alias("row"), F.col("right_panel").alias("room"), F.col("right_room_num").alias("room_num"), _apart().alias("center_dist"), "bound").withColumn("center_dist", near).where("center_dist < bound")
        found = pairs.groupBy("row").agg(F.min_by(F.struct("room", "center_dist", "room_num"), F.struct("center_dist", "room_num")).alias("b"))
        done = scratch.keep(asked.join(found.hint("merge"), "row", "left"), "round")
        best.append(done.where("b is not null").select("element", "b.room", F.lit(8).alias("inside_count"), "b.center_dist", "b.room_num"))
        rest = rest.union(done.where("b is null and grid = 0").select(*rest.columns))
        todo = done.where("b is null and grid > 0").withColumn("grid", F.col("grid") - 1).select(*todo.columns)
    rest = scratch.keep(rest.union(todo.where("grid is not null").select(*rest.columns)), "rest")
    few = points.join(rest.select("element").distinct().hint("merge"), "element", "left_semi")
    touched = room_members(rest.select("element", *instances.BOX), own, few, cell, 0.0).withColumn("center_dist", near)
    edges = touched.select("element", F.col("panel").alias("room"), "inside_count", "center_dist", "room_num")
    for b in best:
        edges = edges.union(b)
    return strongest(edges)


def room_code(frame_name: Column, room_num: Column) -> Column:
    """PREFIX-NUMBER: what stands between the first sign and the first hyphen of the frame's name, and the room's number of
    four signs; of five, the second is left out; null for any other."""
    prefix = F.get(F.split(F.substr(frame_name, F.lit(2)), "-"), F.lit(0))
    number = F.when(F.length(room_num) == 4, room_num).when(F.length(room_num) == 5, F.concat(F.substring(room_num, 1, 1), F.substr(room_num, F.lit(3))))
    return F.concat(prefix, F.lit("-"), number)


def room_numbers(elements: DataFrame, closed: DataFrame, rooms: DataFrame, own: DataFrame) -> DataFrame:
    """elements: refno, noun.  rooms: element, room_num, the strongest of each.  own: refno, room_num, as the element's own
    attribute names it.  (refno, room_num), each once: an element's own numbers; else those of its children and their
    children (equipment, structures, restraints), of its children (branches), of itself (all others); supports take those
    of what lies three levels below in any case."""
    wide, support, branch = F.col("noun").isin("EQUI", "STRU", "REST"), F.col("noun") == "SUPPO", F.col("noun") == "BRAN"
    told = own.where("room_num is not null").select("refno", "room_num")
    plain = elements.select("refno", "noun").join(told.select("refno").distinct().withColumn("told", F.lit(True)), "refno", "left")
    asked = plain.where(support | F.col("told").isNull())
    low = F.when(wide | branch, 1).when(support, 3).otherwise(0)
    high = F.when(wide, 2).when(branch, 1).when(support, 3).otherwise(0)
    reach = asked.select(F.col("refno").alias("anc"), low.alias("low"), high.alias("high"))
    found = closed.where("depth <= 3").join(reach, "anc").where("depth between low and high").select(F.col("anc").alias("of"), "refno")
    numbers = found.join(rooms.where("room_num is not null").select(F.col("element").alias("refno"), "room_num"), "refno").select(F.col("of").alias("refno"), "room_num")
    said = told.join(elements.where(~support).select("refno"), "refno", "left_semi")
    return numbers.union(said.select("refno", "room_num")).distinct()
