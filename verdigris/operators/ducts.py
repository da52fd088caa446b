"""Ventilation ducts: bolts, washers and plates by shape, size and what stands at a part's ends.

An end is `dressed` where a damper or a mesh stands there.  Material 6 (fire board) has neither bolts nor washers.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRE_BOARD = 6
#: Washer letters by material.  Fixed values.
WASHERS = {1: "A型", 2: "A型", 4: "A型", 3: "B型", 5: "B型"}
FAN_WASHER = "D型"


def dressed(noun: Column) -> Column:
    return F.coalesce(noun.isin("DAMP", "MESH"), F.lit(False))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _holes(size: Column) -> Column:
    """Holes along a length: one each 150, half a step in."""
    return (_or_zero(size) + 75) / 150


def frame_holes(width: Column, height: Column, flange: Column) -> Column:
    """Holes along two sides of a rectangular flange."""
    edge = 2 * _or_zero(flange)
    return F.round(_holes(_or_zero(width) + edge)) + F.round(_holes(_or_zero(height) + edge)) - 2


def bolts_straight(circle: Column, material: Column, prev: Column, next: Column, flange_length: Column, width: Column, height: Column, flange: Column) -> Column:
    """Bolts of a straight duct: half of both flanges' belong to it, all of one at a dressed end."""
    ends = dressed(prev).cast("double") + dressed(next).cast("double")
    side = lambda x: F.round((_or_zero(x) + _or_zero(flange)) / 150 + 1.5)
    n = F.when(circle, F.round(_holes(flange_length) * (0.5 + ends / 4))).otherwise((side(width) + side(height)) * (2 + ends))
    return F.when(material == FIRE_BOARD, 0.0).otherwise(n)


def bolts_taper(circle: Column, material: Column, prev: Column, next: Column, flange_length: Column, first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> Column:
    """Array of the bolts at a taper's two ends; first and second: width, height and flange width there.  A dressed
    second end counts the first end's frame, rounded once over both sides."""
    half, full = F.round(_holes(flange_length) / 2), F.round(_holes(flange_length))
    width, height, flange = map(_or_zero, first)
    once = F.round(_holes(width + 2 * flange) + _holes(height + 2 * flange) - 2)
    round_ends = F.array(*(F.when(dressed(e), full).otherwise(half) for e in (prev, next)))
    box_ends = F.array(frame_holes(*first) * F.when(dressed(prev), 2).otherwise(1), F.when(dressed(next), once * 2).otherwise(frame_holes(*second)))
    return F.when(material == FIRE_BOARD, F.array(F.lit(0.0), F.lit(0.0))).when(circle, round_ends).otherwise(box_ends)


def bolts_at_ends(ends: list[tuple[Column, Column, Column]]) -> Column:
    """Array of the bolts at each end of a branch piece or transition.  ends: (noun that stands there, round end's flange
    length or null, rectangular end's frame holes); the whole flange counts at a dressed end, half of it elsewhere."""
    return F.array(*(F.round(F.coalesce(F.when(length.isNotNull(), _holes(length)), holes, F.lit(0.0)) * F.when(dressed(noun), 1.0).otherwise(0.5)) for noun, length, holes in ends))


def bolts_offset(circle: Column, prev: Column, next: Column, flange_length: Column, width: Column, height: Column, flange: Column) -> Column:
    ends = 2.0 + dressed(prev).cast("double") + dressed(next).cast("double")
    return F.when(circle, F.round(_holes(flange_length) * ends)).otherwise(F.round(frame_holes(width, height, flange) * ends / 4))


def washers_of_bolts(bolts: Column) -> Column:
    """Two on each bolt."""
    return F.transform(bolts, lambda b: b * 2)


def washer_type(fan: Column, noun: Column, material: Column) -> Column:
    """At an end: a damper of a fan has its own; else by material where no fan stands there; null at another fan end."""
    by_material = reduce(lambda w, m: w.when(material == m, WASHERS[m]), list(WASHERS)[1:], F.when(material == 1, WASHERS[1])).otherwise("")
    fan = F.coalesce(fan, F.lit(False))
    return F.when(fan & (noun == "DAMP"), FAN_WASHER).when(~fan, by_material)


def bend_area(fire: Column, angle: Column, height: Column, width: Column) -> Column:
    """Plate of a rectangular bend in square metres: its radius grows in three steps of height; none up to 500."""
    radius = F.when(height <= 1000, height / 2 + 100).when(height <= 1500, height + 200).otherwise(height * 1.5 + 300)
    return F.when((angle > 30) & (height > 500) & ~fire, width * (angle * 3.14 / 180 * radius) / 1000000).otherwise(0.0)


def bend_weight(fire: Column, angle: Column, height: Column, width: Column, thickness: Column) -> Column:
    """Steel of that plate, in kilograms; thickness in millimetres."""
    return bend_area(fire, angle, height, width) * _or_zero(thickness) * 7.85


def section_code(branch_name: Column, section: Column) -> Column:
    """Third part of the branch's name, sixth up to a blank, a stroke and the last five characters of the section."""
    parts = F.split(branch_name, "-")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return reduce(lambda a, b: F.concat(a, b), [part(2), F.get(F.split(part(5), " "), F.lit(0)), F.lit("/"), F.right(F.coalesce(section, F.lit("")), F.lit(5))])


def total(bolts: Column) -> Column:
    """Sum of an array of counts."""
    return F.aggregate(bolts, F.lit(0.0), add)


#: Numbers that stand for words in a part's description, and materials by number.  Fixed values.
SHAPES = {927441: "RECT", 603858: "CIRC"}
FLANGES = {531717: "FJ", 531501: "FB"}
FLEXIBLE = 614823
MATERIALS = {1: "GS", 2: "CS", 3: "ACS", 4: "SS", 5: "GS", 6: "FP"}
#: Flanges: code, type, kilograms a metre.  Fixed values.
FLANGE_TYPES = [
    ("FJ25", "L25X3", 1.124), ("FJ303", "L30X3", 1.373), ("FJ30", "L30X4", 1.786), ("FJ35", "L35X4", 1.656), ("FJ40", "L40X4", 2.422), ("FJ45", "L45X4", 2.736), ("FJ50", "L50X5", 3.77), ("FJ60", "L60X6", 5.369),
    ("FJ608", "L60X8", 7.081), ("FJ6550", "L65X50X6", 5.134), ("FJ65", "L65X6", 5.3694), ("FJ63", "L63X6", 5.721), ("FJ70", "L70X7", 7.398), ("FJ7550", "L75X50X6", 5.699), ("FJ75", "L75X7", 7.976), ("FJ8060", "L80X60X6", 6.311),
    ("FJ80", "L80X8", 9.658), ("FJ8010", "L80X10", 11.874), ("FJ90", "L90X9", 5.661), ("FJ9056", "L90X56X5", 5.661), ("FJ10065", "L100X65X8", 9.8596), ("FJ10080", "L100X80X8", 10.946), ("FJ100", "L100X8", 12.276),
    ("FB253", "FB25X3", 0.59), ("FB254", "FB25X4", 0.78), ("FB304", "FB30X4", 0.94), ("FB305", "FB30X5", 1.18), ("FB354", "FB35X4", 1.1), ("FB404", "FB40X4", 1.26), ("FB405", "FB40X5", 1.57), ("FB505", "FB50X5", 1.96),
    ("FB606", "FB60X6", 2.826), ("FB608", "FB60X8", 3.77), ("FB6010", "FB60X10", 4.71), ("FB808", "FB80X8", 5.02), ("FB8010", "FB80X10", 6.28), ("FB8012", "FB80X12", 7.54),
]


def _look_up(table: dict, key: Column, otherwise) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(entries, key), F.lit(otherwise))


def shape(code: Column) -> Column:
    return _look_up(SHAPES, code.cast("int"), "unset")


def flange_kind(code: Column) -> Column:
    return _look_up(FLANGES, code.cast("int"), "")


def material_number(branch_name: Column) -> Column:
    """The number in the fourth part of the branch's name, 0 if there is none."""
    return F.coalesce(F.get(F.split(branch_name, "-"), F.lit(3)).try_cast("int"), F.lit(0))


def material_code(number: Column) -> Column:
    return _look_up(MATERIALS, number.cast("int"), "unset")


def flange_length(shape: Column, kind: Column, material: Column, width: Column, height: Column, flange: Column, prev: tuple[Column, Column], next: tuple[Column, Column]) -> Column:
    """Metres of flange at both ends of a duct.  A fire board duct has one only at a damper, by that damper's flange
    width; the next part's counts before the one before.  prev and next: noun and flange width there."""
    w, h, f = map(_or_zero, (width, height, flange))
    allowance = F.when(kind == "FJ", 3).when(kind == "FB", 5)
    usual = F.when(shape == "RECT", (w + h + f * 2 + allowance) * 4 / 1000).when(shape == "CIRC", (w + f * 2 + allowance) * 6.28 / 1000)
    at_damper = lambda width_there: (w + h + _or_zero(width_there) * 2 + 3) * 2 / 1000
    fire = F.when(next[0] == "DAMP", at_damper(next[1])).when(prev[0] == "DAMP", at_damper(prev[1]))
    return F.coalesce(F.when(material == FIRE_BOARD, fire).otherwise(usual), F.lit(0.0))


def flange_code(kind: Column, size: Column) -> Column:
    return F.concat(kind, size.cast("int").cast("string"))


def flange_name(code: Column) -> Column:
    """Type of a flange; unset where it is not listed."""
    return _look_up({c: name for c, name, _ in FLANGE_TYPES}, code, "unset")


def flange_weight(code: Column, length: Column) -> Column:
    """Kilograms of a flange of that length in metres; 0 for one that is not listed."""
    return _or_zero(length) * _look_up({c: kg for c, _, kg in FLANGE_TYPES}, code, 0.0)


def washer_length(circle: Column, material: Column, prev: tuple[Column, Column], next: tuple[Column, Column], length: Column) -> Column:
    """Of a straight duct; prev and next: noun and whether a fan stands there.  The third case asks the damper before for
    either end's fan, as the reports do."""
    (p, pf), (n, nf) = ((noun, F.coalesce(fan, F.lit(False))) for noun, fan in (prev, next))
    is_damper = lambda x: F.coalesce(x == "DAMP", F.lit(False))
    is_mesh = lambda x: F.coalesce(x == "MESH", F.lit(False))
    before, after = (is_damper(p) & ~pf) | is_mesh(p), (is_damper(n) & ~nf) | is_mesh(n)
    some = (is_damper(p) & ~(pf & nf)) | is_mesh(n)
    ratio = F.when(before & after, 1.0).when((~dressed(p) & after) | some, 0.75).when(~dressed(p) & ~dressed(n), 0.5).otherwise(0.0)
    metres = F.when(circle, _or_zero(length) / 1000 * 8 * ratio).otherwise(_or_zero(length) * ratio)
    return F.when(material == FIRE_BOARD, 0.0).otherwise(F.round(metres, 2))


def shown_width(circle: Column, width: Column) -> Column:
    return F.when(circle, F.concat(F.lit("φ"), width.cast("string"))).otherwise(width.cast("string"))


def washer_lengths_at_ends(circle: Column, ends: list[tuple[Column, Column, Column]]) -> Column:
    """Array by end of a branch piece.  ends: (noun that stands there, flange length, flange width): the whole length at
    a dressed end, half of it elsewhere; a round end has four flange widths more."""
    whole = lambda length, flange: _or_zero(length) + F.when(circle, _or_zero(flange) * 4 / 1000).otherwise(0.0)
    return F.array(*(whole(length, flange) * F.when(dressed(noun), 1.0).otherwise(0.5) for noun, length, flange in ends))


def washer_type_at_fan(fan: Column, material: Column) -> Column:
    """Of a cap or an end of a branch piece: a fan's own, else by material in two groups."""
    return F.when(F.coalesce(fan, F.lit(False)), FAN_WASHER).when(material.isin(1, 2, 4), "B型").otherwise("A型")


def taper_flange_lengths(shape: Column, width: Column, height: Column, diameter: Column, flange: Column, other: Column) -> Column:
    """Array of the metres of flange at a taper's two ends, to two decimals; 0 for other shapes.  width, height and diameter
    are the first, second and third size of its description, flange and other the flange widths of its ends."""
    w, h, d, f, o = map(_or_zero, (width, height, diameter, flange, other))
    rect = F.array((w + h * 2) * 2, (d + o * 2) * 2)
    circ = F.array((w + f * 2) * 3.14, (d + o * 2) * 3.14)
    found = F.when(shape == "RECT", rect).when(shape == "CIRC", circ).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    return F.transform(found, lambda x: F.round(x / 1000, 2))


def flexible_flange_length(shape: Column, width: Column, height: Column, flange: Column) -> Column:
    """Metres of flange at both ends of a flexible duct."""
    w, h, f = map(_or_zero, (width, height, flange))
    return F.when(shape == "RECT", (w + h + f * 2) * 4 / 1000).when(shape == "CIRC", (w + f * 2) * 6.28 / 1000).otherwise(0.0)


def gasket_length(shape: Column, material: Column, prev: tuple[Column, Column], next: tuple[Column, Column], length: Column, flange: Column) -> Column:
    """Metres of gasket of a straight duct, by what stands at its ends: prev and next are the noun there and the number of
    its kind.  length is that of its flanges.  The first case that holds counts; fire board has none."""
    (p, pk), (n, nk) = prev, next
    flex, flex_next = (F.coalesce(k == FLEXIBLE, F.lit(False)) for k in (pk, nk))
    (pd, nd), (pm, nm) = ([F.coalesce(x == noun, F.lit(False)) for x in (p, n)] for noun in ("DAMP", "MESH"))
    whole, f = _or_zero(length), _or_zero(flange)
    frame, square = (whole + f * 8) / 1000, (whole + f * f * 8) / 1000
    cases = [
        (flex & flex_next, frame, whole),
        (flex, frame / 2, whole / 2),
        (flex_next & ~pd & ~pm, square, whole / 4),
        (flex_next & pd, square, whole / 2),
        (flex_next, frame / 2, whole / 2),
        ((pd | ~pm) & (nd | nm), frame, whole),
        ((~pd & ~pm & ~nd) | nm, frame * 0.75, whole / 2 * 0.75),
        ((pd | pm) & ~nd & ~nm, frame * 0.75, whole * 0.75),
    ]
    out = F.when(material == FIRE_BOARD, 0.0)
    for holds, rect, circ in cases:
        out = out.when(holds & (shape == "RECT"), rect).when(holds & (shape == "CIRC"), circ)
    return out.otherwise(0.0)


def bend_bolts(shape: Column, material: Column, prev: Column, next: Column, width: Column, height: Column, flange: Column, flange_length: Column) -> Column:
    """Bolts at both ends of a bend, as a number that reports round: four quarters of the holes with two dressed ends, three
    with one, two with none.  Where only the end after it is dressed, a frame counts one and a half holes more; where only
    the one before, a round flange counts by its width."""
    w, h, f = map(_or_zero, (width, height, flange))
    holes = (w + f * 2 + 75) / 150 + (h + f * 2 + 75) / 150 - 2
    before, after = dressed(prev), dressed(next)
    rect = F.when(before & after, holes * 4).when(before, holes * 3).when(after, (holes + 1.5) * 3).otherwise(holes * 2)
    circ = F.when(before & after, _holes(flange_length)).when(before, _holes(flange) * 0.75).when(after, _holes(flange_length) * 0.75).otherwise(_holes(flange_length) / 2)
    return F.when(material == FIRE_BOARD, 0.0).when(shape == "RECT", rect).when(shape == "CIRC", circ).otherwise(0.0)


#: Nuts of a rectangular bend: least angle above which a table holds, then widths up to which a row holds, with the nuts
#: for heights above 500, 1000 and 1500.  Fixed values.
BEND_NUTS = [
    (60, [(900, (3, 6, 9)), (1400, (11, 10, 13)), (2000, (19, 14, 0)), (None, (27, 18, 21))]),
    (30, [(600, (3, 6, 6)), (900, (11, 10, 13)), (1200, (11, 14, 17)), (1500, (27, 18, 21)), (None, (35, 22, 25))]),
]


def bend_nuts(shape: Column, material: Column, angle: Column, width: Column, height: Column) -> Column:
    """Nuts of a bend's plates, by bands of angle, width and height; 0 for other shapes and fire board."""
    a, w, h = map(_or_zero, (angle, width, height))

    def by_height(nuts: tuple[int, int, int]) -> Column:
        return F.when(h > 1500, nuts[2]).when(h > 1000, nuts[1]).when(h > 500, nuts[0]).otherwise(0)

    def by_width(rows: list) -> Column:
        out = F.when(w < rows[0][0], by_height(rows[0][1]))
        for top, nuts in rows[1:-1]:
            out = out.when(w < top, by_height(nuts))
        return out.otherwise(by_height(rows[-1][1]))

    out = F.when((shape != "RECT") | (material == FIRE_BOARD), 0)
    for least, rows in BEND_NUTS:
        out = out.when(a > least, by_width(rows))
    return F.coalesce(out.otherwise(0), F.lit(0))


def insulation_thickness(material: Column, first: Column) -> Column:
    """Half of the first number of the insulation's description, for the numbered materials; null without one."""
    return F.when(material.between(1, 6) & (first > 0), first / 2)


#: Sides up to which a rectangular duct needs no frame, and one; by its pressure class.  Fixed values.
FRAME_SIDES = {"L": (800, 2000), "M": (800, 2000), "H": (600, 1800)}


def frame_length(shape: Column, pressure: Column, material: Column, length: Column, width: Column, height: Column) -> Column:
    """Metres of stiffening frames of a duct by its pressure class: none for small sides, one for middle ones, one each
    800 of length, less half, for large ones.  Fire board has none, but for large ducts of the classes L and H."""
    side, around = F.greatest(width, height), width + height
    out = F.lit(0.0)
    for name, (small, middle) in FRAME_SIDES.items():
        fire = F.coalesce(material == FIRE_BOARD, F.lit(False))
        one = F.when(fire, 0.0).otherwise((around + (82 if name == "L" else 83)) / 500)
        many = (around + 103) * (length / 800 - 0.5) / 500
        many = F.when(fire, 0.0).otherwise(many) if name == "M" else many
        out = F.when((shape == "RECT") & (pressure == name), F.when(side <= small, 0.0).when(side <= middle, one).otherwise(many)).otherwise(out)
    return out


def frame_weight(shape: Column, pressure: Column, metres: Column, width: Column, height: Column) -> Column:
    """Kilograms of these frames: a heavier section for large sides, but not in class M."""
    side = F.greatest(width, height)
    heavy = ((pressure == "L") & (side > 2000)) | ((pressure == "H") & (side > 1800))
    return F.when((shape == "RECT") & pressure.isin(*FRAME_SIDES), metres * F.when(heavy, 3.77).otherwise(2.422)).otherwise(0.0)
