"""Registered queries of the discipline reports (piping, ducts, trays, equipment), reference closures, user attributes and
change events, with their SQL.

Order lines stand for the parts of a branch (order), in the order of their line numbers; a part's noun and sizes come
from its part key and quantity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import branches, changes, ducts, references, relate, trays
from verdigris.plant_queries import LEVEL, _t
from verdigris.sources import component_text

_PIPE_NOUN = "case p % 5 when 0 then 'ELBO' when 1 then 'TEE' when 2 then 'BEND' when 3 then 'VALV' else 'ATTA' end"
_DUCT_NOUN = "case p % 4 when 0 then 'DAMP' when 1 then 'MESH' else 'STRT' end"
_SPEC = "case o_orderkey % 7 when 0 then 'x-Ladder' when 1 then 'TROUGH-2' when 2 then 'ventilated' when 3 then 'Riser/9' when 4 then 'divider' else 'plain' end"


def parts(spark, d):
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("branch"), F.col("l_linenumber").cast("bigint").alias("seq"))
    return li.agg(F.min("l_partkey").alias("p"), F.sum("l_quantity").alias("q"))


_PARTS = "parts as (select l_orderkey as branch, cast(l_linenumber as bigint) as seq, min(l_partkey) as p, sum(l_quantity) as q from lineitem group by 1, 2)"


def q_branch_lengths(spark, d):
    c = parts(spark, d).selectExpr("branch", f"{_PIPE_NOUN} as noun", "p % 3 as rins", "p % 90 as angle", "q", "array(q, cast(p % 7 as double)) as legs", "array(cast(p % 10 as double), 0d, 0d) as a", "if(p % 20 = 3, null, array(0d, q, 1d)) as b")
    length = branches.component_length(*(F.col(x) for x in ("noun", "rins", "angle", "q", "legs", "a", "b")))
    out = branches.branch_lengths(c.select("branch", length.alias("length")), _t(spark, d, "orders").selectExpr("o_orderkey as branch", "o_totalprice as length"))
    return out.select("branch", *(F.round(x, 4).alias(x) for x in ("tube_length", "component_length", "length")))


def q_valve_report(spark, d):
    v = parts(spark, d).selectExpr("branch", "seq", "branch * 10 + seq as refno", f"{_PIPE_NOUN} as noun", "concat('/A', branch % 7, '-B') as branch_name", "if(p % 6 = 0, null, array(cast(p % 2 as double), 0d, 0d)) as pos",
                                   "if(p % 4 < 2, 'VALVR1', 'VALVE') as catalogue", "transform(sequence(0, 14), i -> i + p / 4) as para")
    return branches.valve_report(v)


def q_valve_materials(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", branches.valve_material(F.concat(F.lit("/A-B-C-"), (F.col("o_orderkey") % 10).cast("string"))).alias("material"))


def q_bend_lengths(spark, d):
    return _t(spark, d, "part").select("p_partkey", branches.spec_code(F.concat(F.lit("/S/"), "p_brand", F.lit(":9"))).alias("code"), branches.bend_length(F.col("p_size") * 3.0, F.col("p_retailprice")).alias("length"))


def q_branch_by_site(spark, d):
    c = _t(spark, d, "customer").selectExpr("c_custkey as refno", "(c_custkey * 7 + 3) % 97 + 1 as target")
    sites = c.selectExpr("refno", "refno * 10 as branch", "if(refno % 11 = 0, '/1-PIPE', '/2-INST') as site_name")
    return branches.first_branch_by_site(c, c, sites)


def q_duct_pieces(spark, d):
    """Flanges of tapers and flexible ducts, bolts, nuts and insulation of bends, frames of straight ones."""
    p = parts(spark, d).selectExpr("branch", "seq", f"{_DUCT_NOUN} as noun", "element_at(array('RECT', 'CIRC', 'unset'), cast(p % 3 as int) + 1) as shape", "element_at(array('L', 'M', 'H', 'X'), cast(p % 4 as int) + 1) as class", "cast(p % 7 as int) as material", "p % 2500 as w", "p * 7 % 2200 as h", "q as dia", "p % 40 as f", "p % 30 as o", "p % 100 as angle", "q * 100 as len")
    a = {k: F.col(k) for k in (*p.columns, "prev_noun", "next_noun")}
    n = branches.neighbours(p)
    taper = ducts.taper_flange_lengths(a["shape"], a["w"], a["h"], a["dia"], a["f"], a["o"])
    flexible = ducts.flexible_flange_length(a["shape"], a["w"], a["h"], a["f"])
    frames = ducts.frame_length(a["shape"], a["class"], a["material"], a["len"], a["w"], a["h"])
    numbers = {
        "taper_1": F.get(taper, F.lit(0)),
        "taper_2": F.get(taper, F.lit(1)),
        "flexible": flexible,
        "bolts": ducts.bend_bolts(a["shape"], a["material"], a["prev_noun"], a["next_noun"], a["w"], a["h"], a["f"], flexible),
        "thickness": ducts.insulation_thickness(a["material"], a["o"].cast("double")),
        "frames": frames,
        "frame_weight": ducts.frame_weight(a["shape"], a["class"], frames, a["w"], a["h"]),
    }
    return n.select("branch", "seq", ducts.bend_nuts(a["shape"], a["material"], a["angle"], a["w"], a["h"]).alias("nuts"), *(F.round(c, 8).alias(k) for k, c in numbers.items()))


def q_gaskets(spark, d):
    p = parts(spark, d).selectExpr("branch", "seq", f"{_DUCT_NOUN} as noun", "if(p % 5 < 2, 614823, 1) as kind", "if(p % 3 = 0, 'RECT', 'CIRC') as shape", "cast(p % 7 as int) as material", "q as len", "p % 40 as f")
    n = branches.neighbours(p, ("noun", "kind"))
    length = ducts.gasket_length(F.col("shape"), F.col("material"), (F.col("prev_noun"), F.col("prev_kind")), (F.col("next_noun"), F.col("next_kind")), F.col("len"), F.col("f"))
    return n.select("branch", "seq", F.round(length, 6).alias("length"))


def q_duct_bolts(spark, d):
    p = parts(spark, d).selectExpr("branch", "seq", f"{_DUCT_NOUN} as noun", "p % 2 = 0 as circle", "p % 7 as material", "q * 30 as fl", "p % 500 + 200d as w", "p % 300 + 100d as h", "25d as f", "p % 3 = 0 as fan")
    n = branches.neighbours(p)
    a = {k: F.col(k) for k in n.columns}
    box, other = (a["w"], a["h"], a["f"]), (a["w"] + 50, a["h"] + 30, a["f"] + 5)
    taper = ducts.bolts_taper(a["circle"], a["material"], a["prev_noun"], a["next_noun"], a["fl"], box, other)
    length = F.when(a["circle"], a["fl"])
    ends = ducts.bolts_at_ends([(a["prev_noun"], length, ducts.frame_holes(*box)), (a["next_noun"], length, ducts.frame_holes(*other)), (a["noun"], length, ducts.frame_holes(*box))])
    return n.select("branch", "seq", ducts.bolts_straight(a["circle"], a["material"], a["prev_noun"], a["next_noun"], a["fl"], *box).alias("straight"), F.get(taper, F.lit(0)).alias("taper_1"), F.get(taper, F.lit(1)).alias("taper_2"),
                    ducts.bolts_offset(a["circle"], a["prev_noun"], a["next_noun"], a["fl"], *box).alias("offset_bolts"), ducts.total(ducts.washers_of_bolts(ends)).alias("washers"), ducts.washer_type(a["fan"], a["prev_noun"], a["material"]).alias("washer_type"))


def q_bend_plates(spark, d):
    p = _t(spark, d, "part").selectExpr("p_partkey", "p_partkey % 9 = 0 as fire", "p_size * 2d as angle", "p_partkey % 2000 * 1d as height", "p_retailprice as width", "p_partkey % 4 * 0.5d as thick", "concat('A-B-', p_brand, '-D-E-', p_type) as name")
    a = [F.col(x) for x in ("fire", "angle", "height", "width")]
    return p.select("p_partkey", F.round(ducts.bend_area(*a), 6).alias("area"), F.round(ducts.bend_weight(*a, F.col("thick")), 6).alias("weight"), ducts.section_code(F.col("name"), F.col("p_partkey").cast("string")).alias("code"))


def q_tray_report(spark, d):
    t = _t(spark, d, "customer").selectExpr("c_custkey as refno", "if(c_custkey % 5 = 0, '/1RX-MCT', '/2NX-Y') as site_name", "if(c_custkey % 7 = 0, 'MSUP1', 'Z') as zone_name")
    o = _t(spark, d, "orders").selectExpr("o_custkey as owner", "o_orderkey as seq", "if(o_orderkey % 3 = 0, 'ATTA', 'STRT') as noun", f"{_SPEC} as spec", "o_orderkey % 2 as cover")
    return trays.tray_report(t, o)


def q_cable_lengths(spark, d):
    """An order's line of a kind is a cable, with a point for each."""
    o = _t(spark, d, "orders").selectExpr("o_custkey * 10 + o_orderkey % 7 as cable", "array(o_orderkey % 10 * 1d, o_orderkey % 37 * 1d, o_orderkey % 11 * 1d) as pos")
    return trays.cable_lengths(o)


def q_box_groups(spark, d):
    o = _t(spark, d, "orders").selectExpr("o_custkey as c_custkey", "if(o_orderkey % 20 = 0, 'CYLI', 'BOX') as noun", "o_totalprice as scale", "o_orderkey % 100 as z", "o_orderkey % 3 as g")
    c = _t(spark, d, "customer").selectExpr("c_custkey", "c_nationkey as equipment")
    return trays.box_groups(o.join(c, "c_custkey").selectExpr("equipment", "c_custkey * 3 + g as group_seq", "c_custkey * 3 + g as owner", "noun", "scale", "z"))


def q_sub_equipment(spark, d):
    c = _t(spark, d, "customer").selectExpr(f"{3 * LEVEL} + c_custkey as refno", "cast(c_nationkey as bigint) as owner", "if(c_custkey % 4 = 0, 'SUBE', 'BOX') as noun")
    o = _t(spark, d, "orders").selectExpr(f"{4 * LEVEL} + o_orderkey as refno", f"{3 * LEVEL} + o_custkey as owner", "'CYLI' as noun")
    return trays.grandchildren(c.union(o))


def q_duct_flanges(spark, d):
    p = parts(spark, d).selectExpr("branch", "seq", f"{_DUCT_NOUN} as noun", "concat('/a-b-c-', p % 7) as branch_name", "element_at(array(927441, 603858, 1), cast(p % 3 as int) + 1) as shape_code", "if(p % 2 = 0, 531717, 531501) as kind_code",
                                   "element_at(array(25, 40, 608, 8010, 7), cast(p % 5 as int) + 1) as size", "p % 500 as w", "p % 300 as h", "p % 40 as f", "p % 3 = 0 as fan")
    n = branches.neighbours(p, ("noun", "f", "fan"))
    a = {k: F.col(k) for k in n.columns}
    n = n.select("*", ducts.shape(a["shape_code"]).alias("shape"), ducts.flange_kind(a["kind_code"]).alias("kind"), ducts.material_number(a["branch_name"]).alias("material"))
    length = ducts.flange_length(F.col("shape"), F.col("kind"), F.col("material"), a["w"], a["h"], a["f"], (a["prev_noun"], a["prev_f"]), (a["next_noun"], a["next_f"]))
    n, circle = n.withColumn("length", length), F.col("shape") == "CIRC"
    return n.select("branch", "seq", ducts.material_code(F.col("material")).alias("material"), F.round("length", 6).alias("length"), F.round(ducts.flange_weight(ducts.flange_code(F.col("kind"), a["size"]), F.col("length")), 6).alias("weight"), ducts.flange_name(ducts.flange_code(F.col("kind"), a["size"])).alias("name"),
                    ducts.washer_length(circle, F.col("material"), (a["prev_noun"], a["prev_fan"]), (a["next_noun"], a["next_fan"]), a["w"] * 1.0).alias("washer"), ducts.shown_width(circle, a["w"]).alias("shown"))


def q_insulation(spark, d):
    c = _t(spark, d, "customer").selectExpr("c_custkey", "c_nationkey as spec", "c_custkey % 100 as temp", "c_custkey % 50 as bore")
    s = _t(spark, d, "supplier").selectExpr("s_nationkey as spec", "s_suppkey as sele", "s_suppkey % 60 as lo", "s_suppkey % 60 + 40 as hi")
    p = _t(spark, d, "part").selectExpr("p_partkey % 10 + 1 as sele", "p_partkey as seq", "p_size as lo", "p_size + 5 as hi", "p_retailprice as answer")
    return relate.two_ranges(c, s, p, "c_custkey", "temp", "bore").select("c_custkey", "answer")


def q_component_text(spark, d):
    p = parts(spark, d).selectExpr("branch", "concat('/L', branch) as branch_name", "seq", f"if(p % 31 = 0, 'CAP', {_PIPE_NOUN}) as noun", "array(p * 1d, q, 0.5d) as arrive", "array(q, p * 1d, -1d) as leave", "if(p % 2 = 0, array(1d, 2d, 3d), null) as centre", "p % 200 as bore",
                                   "if(p % 3 = 0, 'ELBW', null) as skey", "if(p % 4 = 0, p % 90 + 0.25d, null) as angle", "if(p % 7 = 0, null, p % 50) as item_code", "null as weld_spec", "p as refno", "null as radius")
    items = _t(spark, d, "part").selectExpr("p_partkey as item_code", "p_name as description")
    return component_text.component_text(p, items)


def q_change_buckets(spark, d):
    e = _t(spark, d, "events").selectExpr("event_id as seq", "user_id as refno", "case event_id % 5 when 0 then 'A' when 4 then 'D' else 'M' end as op", "if(event_id % 10 = 0, null, user_id % 17) as owner", "if(event_id % 3 = 0, user_id % 19, null) as old_owner", "if(event_id % 3 = 0, user_id % 23, null) as new_owner",
                                          "if(event_id % 2 = 0, array('OWNER'), array('OWNER', 'POS')) as attributes", "array(1, 2) as children_old", "if(event_id % 7 = 0, array(2, 1), array(1, 2)) as children_new")
    return changes.buckets(e)


def q_reference_closure(spark, d):
    c = _t(spark, d, "customer").selectExpr("c_custkey as refno", "if(c_custkey % 9 = 0, null, c_custkey div 3) as owner", "if(c_custkey % 4 = 0, 'GMSE', 'SPEC') as noun", "c_custkey % 3 as dbnum")
    edges = _t(spark, d, "customer").selectExpr("c_custkey as referrer", "c_custkey * 2 + 1 as referenced").where("referrer % 5 = 0")
    return references.reference_closure(c, edges, _t(spark, d, "nation").selectExpr("n_nationkey * 5L as refno")).select("refno", "dbnum", "truncated")


def q_user_values(spark, d):
    p = _t(spark, d, "part")
    definitions = p.groupBy(F.concat(F.lit(":"), F.col("p_partkey") % 3).alias("name"), F.col("p_brand").alias("noun")).agg(F.min("p_type").alias("default"))
    values = p.selectExpr("p_partkey as refno", "concat(':', p_partkey % 4) as name", "if(p_partkey % 6 = 0, null, p_name) as value").where("refno % 2 = 0")
    return references.user_values(p.selectExpr("p_partkey as refno", "p_brand as noun"), values, definitions)


def q_duct_end_washers(spark, d):
    n = branches.neighbours(parts(spark, d).selectExpr("branch", "seq", f"{_DUCT_NOUN} as noun", "p % 2 = 0 as circle", "p % 7 as material", "q as fl", "p % 40 as f", "p % 3 = 0 as fan"), ("noun", "fan"))
    a = {k: F.col(k) for k in n.columns}
    ends = ducts.washer_lengths_at_ends(a["circle"], [(a["prev_noun"], a["fl"], a["f"]), (a["next_noun"], a["fl"] + 1, a["f"])])
    return n.select("branch", "seq", F.round(F.get(ends, F.lit(0)), 6).alias("first"), F.round(F.get(ends, F.lit(1)), 6).alias("second"), ducts.washer_type_at_fan(a["prev_fan"], a["material"]).alias("kind"))


def q_equipment_report(spark, d):
    c = _t(spark, d, "customer").selectExpr("c_custkey as refno", "c_name as name", "if(c_nationkey % 6 = 0, '/1-FAD', null) as zone_name")
    o = _t(spark, d, "orders")
    rooms = o.where("o_orderkey % 4 = 0").selectExpr("o_custkey as element", "o_orderkey as room", "concat('K', o_orderkey) as room_num", "o_orderkey % 9 as inside_count", "o_totalprice as center_dist")
    s = _t(spark, d, "supplier")
    return trays.equipment_report(c, rooms, s.selectExpr("s_suppkey as refno", "s_acctbal as z"), s.where("s_suppkey % 2 = 0").selectExpr("s_suppkey as refno", "s_nationkey * 1d as dist"), "FAD")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_FRAME = "(round(({w} + 2 * {f} + 75) / 150) + round(({h} + 2 * {f} + 75) / 150) - 2)"
_BOX, _OTHER = _FRAME.format(w="w", h="h", f="25"), _FRAME.format(w="(w + 50)", h="(h + 30)", f="30")
_DRESSED = "coalesce({} in ('DAMP', 'MESH'), false)"
_P, _N, _O = (_DRESSED.format(x) for x in ("pn", "nn", "noun"))
_END = "round(case when circle then (fl + 75) / 150 else {} end * case when {} then 1.0::double else 0.5::double end)"
_PARA = "round(case when p % 4 < 2 then {} else {} end + p / 4, 2)"
_RADIUS = "case when height <= 1000 then height / 2 + 100 when height <= 1500 then height + 200 else height * 1.5::double + 300 end"
SQL = {
    "branch_lengths": f"""with {_PARTS}, c as (select branch, case when p % 5 in (0, 2) then (p % 3 + 1) / 2 * radians(p % 90) * q when p % 5 = 1 then q + p % 7 when p % 20 = 3 then 0 else sqrt((p % 10) * (p % 10) + q * q + 1) end as l from parts),
 s as (select branch, sum(l) as c from c group by 1), b as (select coalesce(o_orderkey, branch) as branch, coalesce(o_totalprice, 0) as t, coalesce(c, 0) as c from orders full join s on branch = o_orderkey)
 select branch, round(t, 4) as tube_length, round(c, 4) as component_length, round(t + c, 4) as length from b""",
    "valve_report": f"""with {_PARTS}, n as (select *, lag(p) over (partition by branch order by seq) as pp from parts)
 select branch * 10 + seq as refno, 'A' || (branch % 7) as belongs, (1 + p / 4) * 2 as length, {_PARA.format(14, 10)} as weight, {_PARA.format(11, 7)} as x, {_PARA.format(12, 8)} as y, {_PARA.format(13, 9)} as z,
 coalesce(pp % 5 = 4 and pp % 6 <> 0 and p % 6 <> 0 and pp % 2 = p % 2, false) as supported from n where p % 5 = 3""",
    "valve_materials": "select o_orderkey, case o_orderkey % 10 when 1 then 'SS' when 2 then 'GS' when 3 then 'CS' when 4 then 'ACS' when 5 then 'ASS' when 6 then 'AS' when 7 then 'FP' end as material from orders",
    "bend_lengths": "select p_partkey, p_brand as code, round(p_size * 3.0::double / 360 * 2 * 3.1415::double * p_retailprice, 2) as length from part",
    "branch_by_site": """with recursive w as (select c_custkey as refno, (c_custkey * 7 + 3) % 97 + 1 as here, 1 as hops from customer
 union all select refno, (here * 7 + 3) % 97 + 1, hops + 1 from w where here % 11 <> 0 and hops < 200) select refno, here * 10 as branch, hops, false as truncated from w where here % 11 = 0""",
    "duct_bolts": f"""with {_PARTS}, a as (select branch, seq, p, {_DUCT_NOUN} as noun, p % 2 = 0 as circle, p % 7 as m, q * 30 as fl, p % 500 + 200::double as w, p % 300 + 100::double as h from parts),
 n as (select *, lag(noun) over x as pn, lead(noun) over x as nn from a window x as (partition by branch order by seq)), e as (select *, {_P}::int + {_N}::int as ends from n)
 select branch, seq, case when m = 6 then 0 when circle then round((fl + 75) / 150 * (0.5::double + ends / 4)) else (round((w + 25) / 150 + 1.5::double) + round((h + 25) / 150 + 1.5::double)) * (2 + ends) end as straight,
 case when m = 6 then 0 when circle then case when {_P} then round((fl + 75) / 150) else round((fl + 75) / 150 / 2) end else {_BOX} * case when {_P} then 2 else 1 end end as taper_1,
 case when m = 6 then 0 when circle then case when {_N} then round((fl + 75) / 150) else round((fl + 75) / 150 / 2) end when {_N} then round((w + 125) / 150 + (h + 125) / 150 - 2) * 2 else {_OTHER} end as taper_2,
 case when circle then round((fl + 75) / 150 * (2 + ends)) else round({_BOX} * (2 + ends) / 4) end as offset_bolts,
 2 * ({_END.format(_BOX, _P)} + {_END.format(_OTHER, _N)} + {_END.format(_BOX, _O)}) as washers,
 case when p % 3 = 0 then case when pn = 'DAMP' then 'D型' end when m in (1, 2, 4) then 'A型' when m in (3, 5) then 'B型' else '' end as washer_type from e""",
    "duct_pieces": f"""with {_PARTS}, a as (select branch, seq, p, q, {_DUCT_NOUN} as noun, p % 3 as s, p % 4 as c, p % 7 as m, (p % 2500)::double as w, (p * 7 % 2200)::double as h, (p % 40)::double as f, (p % 30)::double as o, p % 100 as g, q * 100 as len from parts),
 n as (select *, lag(noun) over x as pn, lead(noun) over x as nn from a window x as (partition by branch order by seq)),
 e as (select *, {_P} as b, {_N} as t, (w + f * 2 + 75) / 150 + (h + f * 2 + 75) / 150 - 2 as holes, case s when 0 then (w + h + f * 2) * 4 / 1000 when 1 then (w + f * 2) * 6.28::double / 1000 else 0 end as flexible, greatest(w, h) as side, w + h as around, case when h > 1500 then 3 when h > 1000 then 2 when h > 500 then 1 else 0 end as band from n),
 k as (select *, case when s <> 0 or c = 3 or side <= case when c = 2 then 600 else 800 end then 0 when side <= case when c = 2 then 1800 else 2000 end then case when m = 6 then 0 else (around + case when c = 0 then 82 else 83 end) / 500 end when c = 1 and m = 6 then 0 else (around + 103) * (len / 800 - 0.5::double) / 500 end as frames from e)
 select branch, seq, case when s <> 0 or m = 6 or band = 0 or g <= 30 then 0 when g > 60 then case when w < 900 then [3, 6, 9][band] when w < 1400 then [11, 10, 13][band] when w < 2000 then [19, 14, 0][band] else [27, 18, 21][band] end
  else case when w < 600 then [3, 6, 6][band] when w < 900 then [11, 10, 13][band] when w < 1200 then [11, 14, 17][band] when w < 1500 then [27, 18, 21][band] else [35, 22, 25][band] end end as nuts,
 round(case s when 0 then round((w + h * 2) * 2 / 1000, 2) when 1 then round((w + f * 2) * 3.14::double / 1000, 2) else 0 end, 8) as taper_1, round(case s when 0 then round((q + o * 2) * 2 / 1000, 2) when 1 then round((q + o * 2) * 3.14::double / 1000, 2) else 0 end, 8) as taper_2, round(flexible, 8) as flexible,
 round(case when m = 6 then 0 when s = 0 then case when b and t then holes * 4 when b then holes * 3 when t then (holes + 1.5::double) * 3 else holes * 2 end when s = 1 then case when b and t then (flexible + 75) / 150 when b then (f + 75) / 150 * 0.75::double when t then (flexible + 75) / 150 * 0.75::double else (flexible + 75) / 150 / 2 end else 0 end, 8) as bolts,
 round(case when m between 1 and 6 and o > 0 then o / 2 end, 8) as thickness, round(frames, 8) as frames, round(case when s = 0 and c < 3 then frames * case when (c = 0 and side > 2000) or (c = 2 and side > 1800) then 3.77::double else 2.422::double end else 0 end, 8) as frame_weight from k""",
    "gaskets": f"""with {_PARTS}, a as (select *, {_DUCT_NOUN} as noun, p % 5 < 2 as flex, (p % 40)::double as f from parts), n as (select *, coalesce(lag(noun) over x, '') as pn, coalesce(lead(noun) over x, '') as nn, coalesce(lag(flex) over x, false) as pf, coalesce(lead(flex) over x, false) as nf from a window x as (partition by branch order by seq)),
 k as (select *, case when pf and nf then 1 when pf then 2 when nf and pn not in ('DAMP', 'MESH') then 3 when nf and pn = 'DAMP' then 4 when nf then 5 when pn <> 'MESH' and nn in ('DAMP', 'MESH') then 6 when nn = 'MESH' or (pn not in ('DAMP', 'MESH') and nn <> 'DAMP') then 7 when pn in ('DAMP', 'MESH') and nn not in ('DAMP', 'MESH') then 8 else 9 end as c, (q + f * 8) / 1000 as frame, (q + f * f * 8) / 1000 as square from n)
 select branch, seq, round(case when p % 7 = 6 then 0 when p % 3 = 0 then case c when 1 then frame when 2 then frame / 2 when 3 then square when 4 then square when 5 then frame / 2 when 6 then frame when 7 then frame * 0.75::double when 8 then frame * 0.75::double else 0 end
 else case c when 1 then q when 2 then q / 2 when 3 then q / 4 when 4 then q / 2 when 5 then q / 2 when 6 then q when 7 then q / 2 * 0.75::double when 8 then q * 0.75::double else 0 end end, 6) as length from k""",
    "bend_plates": f"""with p as (select p_partkey, p_partkey % 4 * 0.5::double as thick, case when p_size * 2 > 30 and height > 500 and p_partkey % 9 <> 0 then p_retailprice * (p_size * 2::double * 3.14::double / 180 * ({_RADIUS})) / 1000000 else 0 end as area, p_brand || string_split(p_type, ' ')[1] || '/' || right(p_partkey::varchar, 5) as code
 from (select *, (p_partkey % 2000)::double as height from part)) select p_partkey, round(area, 6) as area, round(area * thick * 7.85::double, 6) as weight, code from p""",
    "tray_report": f"""with f as (select o_custkey, {_SPEC} as spec, o_orderkey % 2 = 1 as cover from orders where o_orderkey % 3 <> 0 qualify row_number() over (partition by o_custkey order by o_orderkey) = 1)
 select c_custkey as refno, case when c_custkey % 5 = 0 then '1' else '2' end as unit, case when c_custkey % 5 = 0 then 'RX' else 'NX' end as project, case when c_custkey % 5 = 0 or c_custkey % 7 = 0 then '主托盘' else '次托盘' end as rank,
 case spec when 'x-Ladder' then '梯架' when 'TROUGH-2' then '实底托盘' when 'ventilated' then '带孔托盘' when 'Riser/9' then '竖梯' when 'divider' then '分隔板' else '未知类型' end as kind, case when spec in ('Riser/9', 'divider') then '竖向' else '水平' end as orientation, coalesce(cover, false) as cover from customer left join f on o_custkey = c_custkey""",
    "cable_lengths": """with g as (select o_custkey * 10 + o_orderkey % 7 as cable, min(o_orderkey) as a, max(o_orderkey) as b, count(*) as n from orders group by 1)
 select cable, case when n = 2 then round(sqrt((a % 10 - b % 10) ** 2 + (a % 37 - b % 37) ** 2 + (a % 11 - b % 11) ** 2), 3) else 0 end as length from g""",
    "box_groups": """with g as (select c_nationkey as equipment, c_custkey * 3 + o_orderkey % 3 as c_custkey, max(o_totalprice) as scale, max(o_orderkey % 100) as z from orders join customer on o_custkey = c_custkey group by 1, 2 having count(*) in (3, 4) and count(*) filter (o_orderkey % 20 = 0) = 0)
 select equipment, scale, z from g qualify row_number() over (partition by equipment order by c_custkey) = 1""",
    "sub_equipment": f"select cast(c_nationkey as bigint) as root, {4 * LEVEL} + o_orderkey as refno from customer join orders on o_custkey = c_custkey where c_custkey % 4 = 0",
    "duct_flanges": f"""with {_PARTS}, a as (select *, {_DUCT_NOUN} as noun, p % 7 as m, p % 500::double as w, p % 300::double as h, p % 40::double as f, p % 3 = 0 as fan, case when p % 2 = 0 then 3 else 5 end as al from parts),
 n as (select *, coalesce(lag(noun) over x, '') as pn, coalesce(lead(noun) over x, '') as nn, lag(f) over x as pf, lead(f) over x as nf, coalesce(lag(fan) over x, false) as pfan, coalesce(lead(fan) over x, false) as nfan from a window x as (partition by branch order by seq)),
 l as (select *, case when m = 6 then case when nn = 'DAMP' then (w + h + nf * 2 + 3) * 2 / 1000 when pn = 'DAMP' then (w + h + pf * 2 + 3) * 2 / 1000 else 0 end when p % 3 = 0 then (w + h + f * 2 + al) * 4 / 1000 when p % 3 = 1 then (w + f * 2 + al) * 6.28::double / 1000 else 0 end as len,
 (pn = 'DAMP' and not pfan) or pn = 'MESH' as b, (nn = 'DAMP' and not nfan) or nn = 'MESH' as c, pn not in ('DAMP', 'MESH') as po, nn not in ('DAMP', 'MESH') as no from n),
 r as (select *, case when b and c then 1.0::double when (po and c) or (pn = 'DAMP' and (not pfan or not nfan)) or nn = 'MESH' then 0.75::double when po and no then 0.5::double else 0 end as ratio from l)
 select branch, seq, coalesce(['unset', 'GS', 'CS', 'ACS', 'SS', 'GS', 'FP'][m + 1], 'unset') as material, round(len, 6) as length,
 round(len * coalesce(case when p % 2 = 0 then [1.124::double, 2.422, 7.081, 11.874, 0][p % 5 + 1] else [0::double, 0, 3.77, 6.28, 0][p % 5 + 1] end, 0), 6) as weight, case when p % 2 = 0 then ['L25X3', 'L40X4', 'L60X8', 'L80X10', 'unset'][p % 5 + 1] else ['unset', 'unset', 'FB60X8', 'FB80X10', 'unset'][p % 5 + 1] end as name,
 case when m = 6 then 0 else cast(round(cast(cast(case when p % 3 = 1 then w / 1000 * 8 * ratio else w * ratio end as varchar) as decimal(18, 10)), 2) as double) end as washer, case when p % 3 = 1 then 'φ' else '' end || (p % 500) as shown from r""",
    "insulation": """with h as (select c_custkey, s_suppkey as sele, p_partkey as seq, p_retailprice as answer from customer join supplier on s_nationkey = c_nationkey join part on p_partkey % 10 + 1 = s_suppkey
 where c_custkey % 100 between s_suppkey % 60 and s_suppkey % 60 + 40 and c_custkey % 50 between p_size and p_size + 5), b as (select * from h qualify row_number() over (partition by c_custkey order by sele, seq) = 1)
 select c_custkey, answer from customer left join b using (c_custkey)""",
    "component_text": f"""with {_PARTS}, y as (select *, case when p % 31 = 0 then 'CAP' else {_PIPE_NOUN} end as noun from parts), x as (select *, cast(q as bigint)::varchar as qs, case when p % 7 = 0 then null else p % 50 end as item from (select *, count(*) filter (noun = 'CAP') over (partition by branch order by seq) - (noun = 'CAP')::int as capped from y) where capped = 0),
 k as (select branch, item, min(seq) as seq from x where item is not null group by 1, 2)
 select branch, 0 as place, 0::bigint as seq, 'PIPELINE-REFERENCE      /L' || branch as text from (select distinct branch from parts)
 union all select branch, 2, 0, 'MATERIALS' from (select distinct branch from parts)
 union all select branch, 1, seq, concat_ws(chr(13) || chr(10), noun, '        END-POINT    ' || p || '  ' || qs || '  0.5 ' || (p % 200), '        END-POINT    ' || qs || '  ' || p || '  -1 ' || (p % 200), case when p % 2 = 0 then '        CENTRE-POINT    1  2  3' end,
 case when p % 3 = 0 then '        SKEY  ELBW' end, case when p % 4 = 0 then '        ANGLE        ' || (p % 90) || '.25' end, '        ITEM-CODE    ' || item, '        ID-REF-NO    ' || p) from x
 union all select branch, 3, seq, concat_ws(chr(13) || chr(10), 'ITEM-CODE    ' || item, '        DESCRIPTION    ' || p_name) from k left join part on p_partkey = item""",
    "change_buckets": """with e as (select event_id as seq, user_id as refno, case event_id % 5 when 0 then 'A' when 4 then 'D' else 'M' end as op from events)
 select seq, case op when 'A' then 'Created' else 'Deleted' end as bucket, refno from e where op <> 'M' union select seq, 'MemberChanged', refno % 17 from e where op = 'A' and seq % 10 <> 0
 union select seq, 'Moved', refno from e where op = 'M' and seq % 3 = 0 union select seq, 'MemberChanged', refno % 19 from e where op = 'M' and seq % 3 = 0 union select seq, 'MemberChanged', refno % 23 from e where op = 'M' and seq % 3 = 0
 union select seq, 'Modified', refno from e where op = 'M' and seq % 2 <> 0 union select seq, 'MemberChanged', refno from e where op = 'M' and seq % 7 = 0""",
    "reference_closure": """with recursive w as (select n_nationkey * 5::bigint as refno from nation union
 select t.refno from w join (select c_custkey as here, c_custkey * 2 + 1 as refno from customer where c_custkey % 5 = 0 union all select c_custkey, c_custkey // 3 from customer where c_custkey % 9 <> 0
 union all select c_custkey // 3, c_custkey from customer where c_custkey % 9 <> 0 and c_custkey // 3 in (select c_custkey from customer where c_custkey % 4 = 0)) t on t.here = w.refno)
 select w.refno, c_custkey % 3 as dbnum, false as truncated from w left join customer on c_custkey = w.refno""",
    "user_values": """with u as (select p_partkey as refno, name, d from part join (select ':' || (p_partkey % 3) as name, p_brand as noun, min(p_type) as d from part group by 1, 2) on noun = p_brand),
 v as (select p_partkey as refno, ':' || (p_partkey % 4) as name, case when p_partkey % 6 = 0 then null else p_name end as value from part where p_partkey % 2 = 0)
 select refno, name, coalesce(value, d) as value from u full join v using (refno, name)""",
    "duct_end_washers": f"""with {_PARTS}, a as (select branch, seq, p, q, {_DUCT_NOUN} as noun from parts), n as (select *, lag(noun) over x as pn, lead(noun) over x as nn, coalesce(lag(p % 3 = 0) over x, false) as pfan from a window x as (partition by branch order by seq)),
 e as (select *, case when p % 2 = 0 then (p % 40) * 4 / 1000 else 0 end as more from n)
 select branch, seq, round((q + more) * case when {_P} then 1.0::double else 0.5::double end, 6) as first, round((q + 1 + more) * case when {_N} then 1.0::double else 0.5::double end, 6) as second,
 case when pfan then 'D型' when p % 7 in (1, 2, 4) then 'B型' else 'A型' end as kind from e""",
    "equipment_report": """with r as (select o_custkey, 'K' || o_orderkey as room_num from orders where o_orderkey % 4 = 0 qualify row_number() over (partition by o_custkey order by o_orderkey % 9 desc, o_totalprice, 'K' || o_orderkey) = 1)
 select c_custkey as refno, c_name as name, coalesce(room_num, '') as room_num, coalesce(s_acctbal, 0) as z, case when s_suppkey % 2 = 0 then s_nationkey::double else 0 end as floor_height
 from customer left join r on o_custkey = c_custkey left join supplier on s_suppkey = c_custkey where c_nationkey % 6 <> 0""",
}
