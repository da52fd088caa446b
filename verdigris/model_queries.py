"""Registered queries of change impact, generation roots, pending work, instances, tools and reports, with their SQL.

The scene is the owner tree of plant_queries down to the orders, with nouns by id and every thirteenth order deleted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris import reports, tools
from verdigris.operators import impact, instances, meshes, pending, references, rooms, tree
from verdigris.plant_queries import LEVEL, _t, elements

_CUSTOMER = "case {k} % 3 when 0 then 'EQUI' when 1 then 'STRU' else 'PANE' end"
_ORDER = "case {k} % 7 when 0 then 'LOOP' when 1 then 'FTUB' when 2 then 'BRAN' else 'PIPE' end"
_OPS = "case {k} % 5 when 0 then 'A' when 4 then 'D' else 'M' end"
_NAMES = [["POS"], ["NAME", "desc"], ["XLEN"], ["SPRE"], ["att.para3.x"], ["UDA:5"], ["POS", "ORI"], []]


def scene(spark, d):
    noun = F.expr(f"case noun when 'EQUI' then {_CUSTOMER.format(k='refno')} when 'BRAN' then {_ORDER.format(k=f'(refno - {4 * LEVEL})')} else noun end")
    key = F.col("refno") - 4 * LEVEL
    noun = F.when(F.col("noun") == "EQUI", F.expr(_CUSTOMER.format(k=f"(refno - {3 * LEVEL})"))).otherwise(noun)
    return elements(spark, d, lines=False).select("refno", "owner", "seq", noun.alias("noun"), (F.col("noun").eqNullSafe("BRAN") & (key % 13 == 0)).alias("deleted"), F.concat(F.lit("/"), F.col("refno")).alias("name"))


_SCENE = f"""scene as (select {LEVEL} + r_regionkey as refno, cast(null as bigint) as owner, cast(r_regionkey as bigint) as seq, 'SITE' as noun, false as deleted from region
 union all select {2 * LEVEL} + n_nationkey, {LEVEL} + n_regionkey, n_nationkey, 'ZONE', false from nation
 union all select {3 * LEVEL} + c_custkey, {2 * LEVEL} + c_nationkey, c_custkey, {_CUSTOMER.format(k="c_custkey")}, false from customer
 union all select {4 * LEVEL} + o_orderkey, {3 * LEVEL} + o_custkey, o_orderkey, {_ORDER.format(k="o_orderkey")}, o_orderkey % 13 = 0 from orders)"""
_CLOSED = f"""recursive {_SCENE}, closed as (select refno, refno as anc, 0 as depth from scene
 union all select c.refno, e.owner, c.depth + 1 from closed c join scene e on e.refno = c.anc where e.owner is not null)"""
_ROOTS = f"""chain as (select c.refno, c.anc, c.depth, e.noun from closed c join scene e on e.refno = c.anc),
 found as (select refno, arg_min(anc, depth) filter (noun in ('BRAN', 'HANG', 'SUPPO', 'EQUI')) as unit, arg_min(anc, depth) filter (depth > 0 and noun not in ('LOOP', 'FTUB')) as owner,
 arg_min(noun, depth) filter (depth > 0 and noun not in ('LOOP', 'FTUB')) as owner_noun, max(noun) filter (depth = 0) as noun from chain group by refno),
 roots as (select * from (select refno, coalesce(unit, case when noun in ('SITE', 'ZONE') then null when owner is null or owner_noun in ('SITE', 'ZONE') then case when noun <> 'LOOP' then refno end else owner end) as root,
 case when unit is not null then 'unit' else 'normal' end as kind from found) where root is not null)"""
_COVER = f"""units as (select c.refno from closed c join scene e on e.refno = c.anc where c.depth > 0 and e.noun in ('EQUI', 'BRAN')),
 mdu as (select * from scene where noun in ('EQUI', 'BRAN') and not deleted and refno not in (select refno from units)),
 bearing as (select distinct anc from closed where depth > 0 and refno in (select refno from mdu)),
 parents as (select anc from bearing union select refno from scene where noun in ('SITE', 'ZONE')),
 residue as (select * from scene where not deleted and noun not in ('EQUI', 'BRAN', 'SITE', 'ZONE', 'LOOP') and refno not in (select anc from bearing) and (owner in (select anc from parents) or owner not in (select refno from scene))),
 sized as (select anc, count(*) as subtree from closed group by anc),
 cover as (select refno as root, kind, noun, subtree from (select refno, noun, 'mdu' as kind from mdu union all select refno, noun, 'residue' from residue) join sized on anc = refno)"""
_STATUS = "case {k} % 4 when 0 then 'Generated' when 1 then 'http_422' when 2 then 'Failed' end"
_IMPACT = "case when op <> 'M' or again or k in (2, 3, 4, 5, 7) then 'regen' when k in (0, 6) then case when noun = 'LOOP' then 'regen' else 'transform' end else 'skip' end"


def _names(k):
    return F.get(F.array(*(F.array(*(F.lit(n) for n in names)).cast("array<string>") for names in _NAMES)), k)


def _changes(spark, d):
    """Every order as a change of its element."""
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select((k + 4 * LEVEL).alias("refno"), F.expr(_OPS.format(k="o_orderkey")).alias("op"), _names((k % 8).cast("int")).alias("attributes"), (k % 17 == 0).alias("children_changed"))


_EFFECT_NAMES = [(n, e) for e, names in impact.EFFECTS.items() for n in names.split()[:3]] + [("att.pos.1", "transform"), ("para9", "geometry"), ("XYZ", "cascade"), ("uda:1", "unknown")]


def q_attribute_effects(spark, d):
    """Each part's name is that of an attribute: some of each effect, and of no list."""
    names = F.array(*(F.lit(n) for n, _ in _EFFECT_NAMES))
    rows = _t(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_EFFECT_NAMES)).cast("int")).alias("name"))
    return rows.select("p_partkey", "name", impact.attribute_effect(F.col("name"), F.col("name") == "XYZ").alias("effect"))


def q_change_impact(spark, d):
    j = _changes(spark, d).join(scene(spark, d).select("refno", "noun"), "refno")
    return j.select("refno", "op", impact.operation_impact(F.col("op"), F.col("attributes"), F.col("children_changed"), F.col("noun")).alias("impact"))


def q_generation_roots(spark, d):
    e = scene(spark, d)
    return impact.generation_roots(e, tree.closure(e))


def q_root_cover(spark, d):
    e = scene(spark, d)
    return impact.root_cover(e, tree.closure(e))


def q_root_members(spark, d):
    e = scene(spark, d)
    c = tree.closure(e)
    return impact.root_covers(c, impact.root_cover(e, c))


def _cover_status(spark, d):
    e = scene(spark, d)
    cover = impact.root_cover(e, tree.closure(e))
    return cover, e.select(F.col("refno").alias("root"), F.expr(_STATUS.format(k="refno")).alias("status"))


def q_cover_progress(spark, d):
    return impact.cover_progress(*_cover_status(spark, d))


def q_roots_todo(spark, d):
    return impact.roots_todo(*_cover_status(spark, d))


def q_work_plan(spark, d):
    e = scene(spark, d)
    changed = q_change_impact(spark, d)
    return impact.work_plan(changed, impact.generation_roots(e, tree.closure(e)), e.select("refno", "noun"))


def q_children_delta(spark, d):
    """Lines of each order by number against lines by part, both without some."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    lists = li.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") != 2, F.struct("l_linenumber")))), lambda s: s["l_linenumber"]).alias("old"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") != 3, F.struct("l_partkey", "l_linenumber")))), lambda s: s["l_linenumber"]).alias("new"),
    )
    j = lambda c: F.concat_ws(",", F.array_sort(c))
    return lists.select("l_orderkey", impact.children_delta(F.col("old"), F.col("new")).alias("x")).select("l_orderkey", j("x.came").alias("came"), j("x.went").alias("went"), "x.reordered")


def _observations(spark, d):
    return _t(spark, d, "events").selectExpr("user_id as dbnum", "event_id as seq", "cast(user_id % 7 as bigint) as applied", "case when event_id % 4 <> 3 then cast(floor(event_id % 100 + event_id / 10) as bigint) end as latest")


def q_batch_queue(spark, d):
    return pending.enqueued(_observations(spark, d))


def q_watermark(spark, d):
    o = _observations(spark, d)
    return pending.advance(o.groupBy("dbnum").agg(F.min("applied").alias("applied")), o.where("latest is not null").select("dbnum", F.col("latest").alias("end")))


def _pending(spark, d):
    return _t(spark, d, "part").selectExpr("case when p_partkey % 3 = 0 then 'room' else 'regen' end as action", "p_partkey as target", "cast(p_size as bigint) as revision", "cast(p_partkey % 6 as int) as attempts")


def q_pending_upsert(spark, d):
    plan = _t(spark, d, "lineitem").where("l_quantity > 45").selectExpr("'regen' as action", "l_partkey as target")
    return pending.upsert(_pending(spark, d), plan)


def q_pending_settle(spark, d):
    results = _t(spark, d, "part").where("p_partkey % 5 < 3").selectExpr("case when p_partkey % 3 = 0 then 'room' else 'regen' end as action", "p_partkey as target", "cast(p_size - case when p_partkey % 7 = 0 then 1 else 0 end as bigint) as revision", "p_partkey % 2 = 0 as ok")
    return pending.settle(_pending(spark, d), results)


def q_pending_counts(spark, d):
    return pending.count_targets(_pending(spark, d), 5)


def q_authoritative_members(spark, d):
    """A customer's latest order's lines are its members; others' lines are pruned."""
    li = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lists = li.groupBy(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("sesno")).agg(F.array_sort(F.collect_list("l_partkey")).alias("children"))
    return pending.prune_resurrected(li.select(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("child")).distinct(), pending.authoritative_members(lists))


def q_union_boxes(spark, d):
    p = _t(spark, d, "embeddings").where("size(embedding) > 2")
    one = p.select("label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"{e}_{a}") for e in ("min", "max") for i, a in enumerate("xyz")))
    return instances.union_boxes(one, "label")


def q_shared_contents(spark, d):
    """Parts by brand and size: how many distinct contents, and how many rows share them."""
    marked, contents = instances.deduplicate(_t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"])
    return marked.groupBy("digest").agg(F.count("*").alias("n")).join(contents, "digest").select("p_brand", "p_size", "n")


def q_unreferenced_nodes(spark, d):
    """Parts that no line uses once the lines of quantity above 2 are gone."""
    edges = _t(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as edge_id", "l_partkey as p_partkey", "l_quantity")
    return instances.unreferenced(_t(spark, d, "part").select("p_partkey"), edges.drop("l_quantity"), edges.where("l_quantity > 2").select("edge_id"), "p_partkey")


def q_prune_stale(spark, d):
    stored = _t(spark, d, "orders").selectExpr("o_custkey as root", "o_orderkey as refno")
    produced = stored.where("refno % 3 <> 0")
    return instances.prune_stale(stored, produced, stored.where("root % 2 = 0").select("root").distinct())


def q_world_position(spark, d):
    """Products of a quarter turn about z and a shift for each order of a customer, in order of their keys."""
    k = F.col("o_orderkey") % 10
    m = F.array(*(x.cast("double") for x in (F.lit(0), F.lit(-1), F.lit(0), k, F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(1))))
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", m.alias("m"))
    world = instances.products(rows, "k", "o_orderkey", "m").withColumnRenamed("m", "w")
    return world.select("k", F.get("w", F.lit(11)).cast("bigint").alias("z"), F.get("w", F.lit(0)).cast("bigint").alias("cos"), F.get("w", F.lit(4)).cast("bigint").alias("sin"))


def _model(spark, d):
    e = scene(spark, d)
    p = _t(spark, d, "orders").selectExpr(f"o_orderkey + {4 * LEVEL} as refno", *(f"cast(o_orderkey % {n} {sign} 1 as double) as {side}_{a}" for side, sign in (("min", "-"), ("max", "+")) for a, n in (("x", 10), ("y", 20), ("z", 30))))
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey") + 4 * LEVEL
    values = o.select(k.alias("refno"), F.explode(F.create_map(F.lit("XLEN"), F.col("o_totalprice").cast("string"), F.lit("NAME"), F.col("o_orderstatus"), F.lit("POS"), F.col("o_custkey").cast("string"))).alias("key", "value"))
    edges = _references(spark, d)
    shift = F.array(*(F.lit(1.0 if i % 5 == 0 else 0.0) if i != 3 else (F.col("refno") % 10).cast("double") for i in range(16)))
    room_edges = _t(spark, d, "lineitem").selectExpr(f"l_orderkey + {4 * LEVEL} as element", "l_partkey as room", "concat('K', l_partkey) as room_num", "cast(l_quantity % 9 as int) as inside_count", "l_extendedprice as center_dist")
    return tools.Model(elements=e, boxes=p, changes=_changes(spark, d), attributes=values, references=edges.select("referrer", F.lit("SPRE").alias("attr"), "referenced"), transforms=e.select("refno", shift.alias("matrix")), rooms=room_edges, pending=_pending(spark, d))


def _first(spark, d):
    """The least order's element: an id that every scale has."""
    return 4 * LEVEL + 1


def q_tool_identity(spark, d):
    return tools.run("element.identity", tools.Model(elements=scene(spark, d)), refno=_first(spark, d))


def q_tool_owner_chain(spark, d):
    return tools.run("element.owner_chain", _model(spark, d), refno=_first(spark, d))


def q_tool_members(spark, d):
    return tools.run("element.members", tools.Model(elements=scene(spark, d)), refno=2 * LEVEL + 3, limit=10, start=2)


def q_tool_generation_root(spark, d):
    return tools.run("model.generation_root", _model(spark, d), refno=_first(spark, d))


def q_tool_change_impact(spark, d):
    return tools.run("model.change_impact", _model(spark, d), refno=_first(spark, d))


def q_tool_spatial_bounds(spark, d):
    return tools.run("spatial.bounds", _model(spark, d), refno=LEVEL + 2)


def q_tool_attributes(spark, d):
    return tools.run("element.attributes", _model(spark, d), refno=_first(spark, d), keys=["XLEN", "NAME"])


def q_tool_geometry_parameters(spark, d):
    return tools.run("geometry.parameters", _model(spark, d), refno=_first(spark, d))


def q_tool_transform(spark, d):
    found = tools.run("element.transform", _model(spark, d), refno=_first(spark, d))
    return found.select("refno", F.get("matrix", F.lit(3)).alias("x"), F.get("matrix", F.lit(0)).alias("cos"))


def q_tool_references(spark, d):
    return tools.run("catalog.references", _model(spark, d), refno=_first(spark, d)).distinct()


def q_tool_room(spark, d):
    return tools.run("room.lookup", _model(spark, d), refno=_first(spark, d))


def q_tool_pending(spark, d):
    return tools.run("model.pending_units", _model(spark, d), action="room", limit=20)


def q_container_moves(spark, d):
    """Every nation has moved: the branches below it are made again."""
    e = scene(spark, d)
    c = tree.closure(e)
    moved = e.where("noun = 'ZONE'").select("refno", F.lit("M").alias("op"), F.lit("transform").alias("impact"))
    return impact.work_plan(moved, impact.generation_roots(e, c), e.select("refno", "noun"), c)


def q_null_impacts(spark, d):
    """Operations without attributes, children or operation."""
    o = _t(spark, d, "orders")
    op, names = F.when(F.col("o_orderkey") % 5 > 0, "M"), F.when(F.col("o_orderkey") % 3 > 0, F.array(F.lit("POS"), F.when(F.col("o_orderkey") % 4 > 0, "ORI")))
    return o.select("o_orderkey", impact.operation_impact(op, names, F.lit(None).cast("boolean"), F.lit(None).cast("string")).alias("impact"))


def q_classify_by_many(spark, d):
    """More rules than an array holds: the first letters of all part types."""
    p = _t(spark, d, "part")
    rules = p.select(F.explode(F.sequence(F.lit(3), F.lit(9))).alias("n"), "p_type", "p_brand").select(F.expr("substring(p_type, n % 4 + 1, n)").alias("part"), F.col("p_brand").alias("code")).distinct()
    return reports.classify_by_name(p.select("p_partkey", "p_name"), "p_partkey", "p_name", rules.union(p.selectExpr("substring(p_name, 2, 5)", "p_brand")), "else", most_rules=0).select("p_partkey", "code")


def q_room_codes(spark, d):
    """Rooms of the parts by the plants' codes."""
    p = _t(spark, d, "part")
    number = F.concat(F.lit("K"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.when(F.col("p_partkey") % 3 == 0, "5").when(F.col("p_partkey") % 3 == 1, "").otherwise("77"))
    return p.select("p_partkey", rooms.room_code(F.concat(F.lit("/"), "p_brand", F.lit("-R-"), number), number).alias("code"))


def q_room_numbers(spark, d):
    e = scene(spark, d)
    edges = e.where("refno % 3 > 0").select(F.col("refno").alias("element"), F.concat(F.lit("K"), F.col("refno") % 7).alias("room_num"))
    own = e.where("refno % 11 = 0").select("refno", F.lit("OWN").alias("room_num"))
    return rooms.room_numbers(e, tree.closure(e), edges, own)


def q_branch_surface(spark, d):
    li = _t(spark, d, "lineitem").selectExpr("l_orderkey as branch", "l_linenumber as seq", "l_quantity as length").groupBy("branch", "seq").agg(F.sum("length").alias("length"))
    li = li.selectExpr("*", "case when seq % 3 = 0 then 'REDU' else 'TUBI' end as noun", "cast(seq as double) as own_bore")
    o = _t(spark, d, "orders")
    bores = o.selectExpr("o_orderkey as branch", "0L as place", "10.0d as bore").union(o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "1L", "20.0d"))
    return reports.branch_surface(li, bores).select("branch", "length", F.round("surface", 4).alias("surface"))


def q_default_names(spark, d):
    s = tree.siblings(elements(spark, d, lines=False).where("noun in ('SITE', 'ZONE')"))
    name = reports.default_name(F.col("noun"), F.col("same_noun_ordinal"), F.concat(F.lit("/"), F.col("owner")))
    return s.select("refno", name.alias("name")).select("refno", "name", reports.parse_default_name(F.col("name")).alias("p")).select("refno", "name", "p.ordinal", F.col("p.owner").alias("owner_name"))


def q_vague_search(spark, d):
    return reports.vague_search(_t(spark, d, "part").select("p_partkey", "p_type"), "p_type", every=["A*D"], some=["STAND", "LARGE", "MEDI"], none=["PROMO"])


_MAJORS = [("a", "A"), ("large", "LARGE"), ("o", "O"), ("econ", "ECONOM"), ("std", "STANDARD")]


def q_classify_by_name(spark, d):
    rules = spark.createDataFrame(_MAJORS, "code string, part string")
    return reports.classify_by_name(_t(spark, d, "part").select("p_partkey", "p_type"), "p_partkey", "p_type", rules, "else").select("p_partkey", "code")


def q_step_function(spark, d):
    return _t(spark, d, "part").select("p_partkey", reports.step_value(F.col("p_size"), [(10, 1.5), (20, 2.5), (40, 4.0)], 8.0).alias("loss"))


def _references(spark, d):
    """Orders refer to their lines' parts, and every tenth order is referred to by the one after it."""
    li = _t(spark, d, "lineitem").selectExpr(f"l_orderkey + {4 * LEVEL} as referrer", f"l_partkey + {6 * LEVEL} as referenced")
    o = _t(spark, d, "orders").where("o_orderkey % 10 = 1").selectExpr(f"o_orderkey + {4 * LEVEL} as referrer", f"o_orderkey - 1 + {4 * LEVEL} as referenced")
    return li.union(o)


def q_cascade_roots(spark, d):
    e = scene(spark, d)
    seeds = spark.range(6 * LEVEL + 1, 6 * LEVEL + 4).withColumnRenamed("id", "refno")
    return references.cascade_roots(_references(spark, d), seeds, impact.generation_roots(e, tree.closure(e)))


def q_reverse_index(spark, d):
    """Elements of every third order are touched and refer to one part each from then on."""
    edges = _references(spark, d).distinct()
    o = _t(spark, d, "orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") + 4 * LEVEL).alias("refno"))
    return references.replace_edges(edges, o.select(F.col("refno").alias("referrer"), F.lit(6 * LEVEL + 1).alias("referenced")), o)


def q_reference_along_path(spark, d):
    e = scene(spark, d)
    held = e.where("noun in ('STRU', 'ZONE')").select(F.col("refno").alias("referrer"), (F.col("refno") % 97).alias("referenced"))
    return references.first_reference_along_path(tree.closure(e), held)


def _history(spark, d):
    return _t(spark, d, "events").selectExpr("user_id as refno", "user_id % 5 as dbnum", "event_id div 100 as sesno", "event_id as seq", _OPS.format(k="event_id") + " as op", "value")


def q_version_at(spark, d):
    return references.version_at(_history(spark, d), 4)


def q_version_at_date(spark, d):
    e = _t(spark, d, "events")
    sessions = e.selectExpr("user_id % 5 as dbnum", "event_id div 100 as sesno", "ts as date").groupBy("dbnum", "sesno").agg(F.min("date").alias("date"))
    return references.version_at_date(_history(spark, d), sessions, "2024-01-01 12:00:00")


def q_signed_parts(spark, d):
    found = references.signed_parts(scene(spark, d), ["PIPE", "BRAN"], ["LOOP"])
    return found.select("owner", F.concat_ws(",", "positive").alias("positive"), F.concat_ws(",", "negative").alias("negative"))


def q_uncovered_nouns(spark, d):
    return references.uncovered_nouns(scene(spark, d), ["BRAN", "EQUI", "PIPE", "STRU"])


_STIFF = [(0, "RECT/L", 0, 800, None, "A", "exp0"), (1, "RECT/L", 800, 2000, [6], "A", "exp1"), (2, "RECT/L", 1200, 100000, None, "B", "exp2"), (3, "RECT/M", 500, 2000, [1, 2], "A", "exp1")]


def q_stiffeners(spark, d):
    ducts = _t(spark, d, "part").selectExpr("p_partkey as refno", "cast(p_size * 50 as double) as width", "cast(p_partkey % 2000 as double) as height", "cast(p_partkey % 5 * 1000 + 950 as double) as length", "case when p_size % 2 = 0 then 'RECT/L' else 'RECT/M' end as shape", "cast(p_partkey % 7 as int) as material")
    rules = spark.createDataFrame([(a, b, float(c), float(e), f, g, h) for a, b, c, e, f, g, h in _STIFF], "rule int, pattern string, lo double, hi double, excluded array<int>, section string, expr string")
    weights = spark.createDataFrame([(0, "RECT/L", 0.0, 2000.0, None, 2.5), (1, "RECT/L", 2000.0, 1e5, None, 3.5), (2, "RECT/M", 0.0, 1e5, None, 3.5)], "rule int, pattern string, lo double, hi double, excluded array<int>, scale double")
    out = reports.stiffeners(ducts, rules, weights)
    return out.select("refno", "section", F.round("metres", 4).alias("metres"), F.round("weight", 4).alias("weight"))


def q_room_panels(spark, d):
    """Nations as rooms, every fourth without a room number; some of what lies one and two levels below are panels."""
    e = elements(spark, d, lines=False)
    nation = F.col("refno") - 2 * LEVEL
    noun = F.when(F.col("noun") == "ZONE", F.when(nation % 2 == 0, "FRMW").otherwise("SBFR")).when(F.col("refno") % 3 == 0, "PANE").otherwise("PIPE")
    name = F.when(F.col("noun") == "ZONE", F.when(nation % 4 == 0, "/ZZ-R-K12").otherwise(F.concat(F.lit("/ZZ-R-K"), nation + 100)))
    return rooms.room_panels(e.select("refno", noun.alias("noun"), name.alias("name")), tree.closure(e), ["-R-"])


#: An L of eight by eight seen from above; its floor and roof are fans from the first corner.
_L = [(0, 0), (8, 0), (8, 4), (4, 4), (4, 8), (0, 8)]


def _l_triangles():
    """Corners of the floor, roof and walls of an L as (x, y, roof or floor)."""
    flat = [((*_L[0], z), (*_L[i], z), (*_L[i + 1], z)) for z in (0, 1) for i in range(1, 5)]
    sides = list(zip(_L, _L[1:] + _L[:1], strict=True))
    return flat + [((*p, 0), (*q, 0), (*q, 1)) for p, q in sides] + [((*p, 0), (*q, 1), (*p, 1)) for p, q in sides]


def q_mesh_rooms(spark, d):
    """Parts' L-shaped rooms, ten apart, and the orders whose boxes lie in them; lines are the orders' points."""
    p = _t(spark, d, "part").selectExpr(f"p_partkey + {6 * LEVEL} as panel", "concat('K', p_partkey) as room_num", "p_partkey % 50 * 10D as x", "p_partkey div 50 * 10D as y", "p_size % 5 + 4D as z")
    ends = [F.struct(*((F.col(a) * t[2] if a == "z" else F.col(a) + F.lit(float(t["xyz".index(a)]))).alias(f"{v}{a}") for v, t in zip("abc", tri, strict=True) for a in "xyz")) for tri in _l_triangles()]
    triangles = p.select("panel", F.inline(F.array(*ends)))
    centre = {"x": "o_orderkey * 37 % 500", "y": "o_orderkey div 40", "z": "o_custkey % 10"}
    o = _t(spark, d, "orders")
    boxes = o.selectExpr("o_orderkey as element", *(f"cast({c} {s} (1 + o_orderkey % 3) as double) as {e}_{a}" for e, s in (("min", "-"), ("max", "+")) for a, c in centre.items()))
    line = _t(spark, d, "lineitem").join(o.select("o_orderkey", *(F.expr(c).alias(a) for a, c in centre.items())).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    points = line.selectExpr("l_orderkey as element", "cast(x + l_linenumber % 3 - 1 as double) as x", "cast(y + l_quantity % 3 - 1 as double) as y", "cast(z as double) as z")
    return meshes.mesh_members(boxes, p.select("panel", "room_num"), triangles, points, 16.0)


_OBS = "o as (select user_id as dbnum, event_id as seq, cast(user_id % 7 as bigint) as applied, case when event_id % 4 <> 3 then cast(floor(event_id % 100 + event_id / 10) as bigint) end as latest from events)"
_PEND = "p as (select case when p_partkey % 3 = 0 then 'room' else 'regen' end as action, p_partkey as target, cast(p_size as bigint) as revision, cast(p_partkey % 6 as int) as attempts from part)"
_CHANGED = f"changed as (select refno, op, {_IMPACT} as impact from (select {4 * LEVEL} + o_orderkey as refno, {_OPS.format(k='o_orderkey')} as op, o_orderkey % 8 as k, o_orderkey % 17 = 0 as again, {_ORDER.format(k='o_orderkey')} as noun from orders))"
_EFFECT_ROWS = ", ".join(f"({i}, '{n}', '{e}')" for i, (n, e) in enumerate(_EFFECT_NAMES))

_REFS = f"select l_orderkey + {4 * LEVEL} as referrer, l_partkey + {6 * LEVEL} as referenced from lineitem union all select o_orderkey + {4 * LEVEL}, o_orderkey - 1 + {4 * LEVEL} from orders where o_orderkey % 10 = 1"
_HISTORY = f"h as (select user_id as refno, user_id % 5 as dbnum, event_id // 100 as sesno, event_id as seq, {_OPS.format(k='event_id')} as op, value from events)"

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
SQL = {
    "attribute_effects": f"select p_partkey, name, effect from part join (values {_EFFECT_ROWS}) as t(i, name, effect) on i = p_partkey % {len(_EFFECT_NAMES)}",
    "change_impact": f"with {_CHANGED} select * from changed",
    "generation_roots": f"with {_CLOSED}, {_ROOTS} select refno, root, kind from roots",
    "root_cover": f"with {_CLOSED}, {_COVER} select * from cover",
    "root_members": f"with {_CLOSED}, {_COVER} select root, c.refno as member from cover join closed c on c.anc = root",
    "cover_progress": f"with {_CLOSED}, {_COVER} select kind, count(*) as total, count(*) filter (root % 4 = 0) as done, count(*) filter (root % 4 = 1) as refused, count(*) filter (root % 4 > 1) as todo, cast(sum(subtree) as bigint) as elements_total, cast(coalesce(sum(subtree) filter (root % 4 = 0), 0) as bigint) as elements_done from cover group by kind",
    "roots_todo": f"with {_CLOSED}, {_COVER} select * from cover where root % 4 > 1 order by subtree desc, root",
    "work_plan": f"""with {_CLOSED}, {_ROOTS}, {_CHANGED}, j as (select c.*, r.root, s.noun as root_noun, impact = 'regen' or coalesce(s.noun in ('BRAN', 'HANG'), false) as whole from changed c left join roots r using (refno) left join scene s on s.refno = r.root)
 select 'delete' as action, refno as target from j where op = 'D' union select 'regen', root from j where impact <> 'skip' and whole and root is not null and not (op = 'D' and root = refno) union select 'transform', refno from j where impact = 'transform' and not whole""",
    "tool_attributes": f"select 'XLEN' as key, o_totalprice::varchar as value from orders where o_orderkey = 1 union all select 'NAME', o_orderstatus from orders where o_orderkey = 1",
    "tool_geometry_parameters": "select 'XLEN' as key, o_totalprice::varchar as value from orders where o_orderkey = 1",
    "tool_transform": f"with {_CLOSED} select {4 * LEVEL} + 1 as refno, cast(sum(anc % 10) as double) as x, 1.0::double as cos from closed where refno = {4 * LEVEL} + 1",
    "tool_references": f"select distinct 'SPRE' as attr, referenced from (select l_orderkey + {4 * LEVEL} as referrer, l_partkey + {6 * LEVEL} as referenced from lineitem union all select o_orderkey + {4 * LEVEL}, o_orderkey - 1 + {4 * LEVEL} from orders where o_orderkey % 10 = 1) where referrer = {4 * LEVEL} + 1",
    "tool_room": "select l_partkey as room, 'K' || l_partkey as room_num, cast(l_quantity % 9 as int) as inside_count, l_extendedprice as center_dist from lineitem where l_orderkey = 1",
    "tool_pending": f"with {_PEND} select action, target, revision, attempts from p where action = 'room' order by target limit 20",
    "container_moves": f"with {_CLOSED} select 'transform' as action, refno as target from scene where noun = 'ZONE' union select 'regen', c.refno from closed c join scene e on e.refno = c.refno join scene a on a.refno = c.anc where c.depth > 0 and a.noun = 'ZONE' and e.noun in ('BRAN', 'HANG')",
    "null_impacts": "select o_orderkey, case when o_orderkey % 5 = 0 or o_orderkey % 3 = 0 or o_orderkey % 4 = 0 then 'regen' else 'transform' end as impact from orders",
    "classify_by_many": """with r as (select distinct substr(p_type, n % 4 + 1, n) as part, p_brand as code from part, range(3, 10) t(n) union select substr(p_name, 2, 5), p_brand from part), h as (select p_partkey, code, length(part) as l from part join r on contains(p_name, part) and part <> '')
 select p_partkey, coalesce(code, 'else') as code from part left join (select * from h qualify row_number() over (partition by p_partkey order by l desc, code) = 1) using (p_partkey)""",
    "room_codes": "select p_partkey, case p_partkey % 3 when 1 then p_brand || '-' || n when 0 then p_brand || '-K' || substr(n, 3) || '5' end as code from (select *, 'K' || lpad((p_partkey % 1000)::varchar, 3, '0') as n from part)",
    "room_numbers": f"""with {_CLOSED}, t as (select refno from scene where refno % 11 = 0), reach as (select refno, noun, case when noun in ('EQUI', 'STRU', 'BRAN') then 1 else 0 end as low, case when noun in ('EQUI', 'STRU') then 2 when noun = 'BRAN' then 1 else 0 end as high from scene where refno not in (select refno from t))
 select refno, 'OWN' as room_num from t union select r.refno, 'K' || (c.refno % 7) from reach r join closed c on c.anc = r.refno and c.depth between r.low and r.high where c.refno % 3 > 0""",
    "children_delta": """with l as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by 1, 2), x as (select l_orderkey, coalesce(list(l_linenumber order by l_linenumber) filter (l_linenumber <> 2), []) as old, coalesce(list(l_linenumber order by l_partkey, l_linenumber) filter (l_linenumber <> 3), []) as new from l group by 1)
 select l_orderkey, array_to_string(list_sort(list_filter(new, lambda i: not list_contains(old, i))), ',') as came, array_to_string(list_sort(list_filter(old, lambda i: not list_contains(new, i))), ',') as went, list_filter(old, lambda i: list_contains(new, i)) <> list_filter(new, lambda i: list_contains(old, i)) as reordered from x""",
    "batch_queue": f"""with {_OBS}, a as (select *, count(*) filter (latest is null) over w as round, max(case when latest > applied then latest end) over w as top from o window w as (partition by dbnum order by seq rows between unbounded preceding and 1 preceding)),
 b as (select *, coalesce(latest > applied and latest > coalesce(top, applied), false) as raises from a), c as (select *, coalesce(bool_or(raises) over (partition by dbnum, round order by seq rows between unbounded preceding and 1 preceding), false) as queued from b)
 select dbnum, seq, applied, latest, case when not raises then 'covered' when queued then 'merged' when top is not null then 'behind_running' else 'new' end as outcome from c where latest is not null""",
    "watermark": f"with {_OBS} select dbnum, greatest(min(applied), coalesce(max(latest), min(applied))) as applied from o group by 1",
    "pending_upsert": f"with {_PEND}, n as (select distinct 'regen' as action, l_partkey as target, true as again from lineitem where l_quantity > 45) select action, target, coalesce(revision, 0) + case when again then 1 else 0 end as revision, case when again then 0 else attempts end as attempts from p full join n using (action, target)",
    "pending_settle": f"with {_PEND} select action, target, revision, cast(attempts + case when target % 5 < 3 and target % 7 <> 0 then 1 else 0 end as int) as attempts from p where not (target % 5 < 3 and target % 7 <> 0 and target % 2 = 0)",
    "pending_counts": f"with {_PEND} select action, count(*) filter (attempts < 5) as live, count(*) filter (attempts >= 5) as dead from p group by 1",
    "authoritative_members": "with last as (select o_custkey as owner, max(o_orderkey) as o from orders where o_orderkey in (select l_orderkey from lineitem) group by 1) select distinct owner, l_partkey as child from last join lineitem on l_orderkey = o",
    "union_boxes": "select label, " + ", ".join(f"{f}(cast(embedding[{i}] as double)) as {f}_{a}" for f in ("min", "max") for i, a in enumerate("xyz", 1)) + " from embeddings group by label",
    "shared_contents": "select p_brand, p_size, count(*) as n from part group by 1, 2",
    "unreferenced_nodes": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem l where l_orderkey * 10 + l_linenumber not in (select l_orderkey * 10 + l_linenumber from lineitem where l_quantity > 2))",
    "prune_stale": "select o_custkey as root, o_orderkey as refno from orders where not (o_custkey % 2 = 0 and o_orderkey % 3 = 0)",
    "world_position": "select o_custkey as k, count(*) as z, cast(case count(*) % 4 when 0 then 1 when 2 then -1 else 0 end as bigint) as cos, cast(case count(*) % 4 when 1 then 1 when 3 then -1 else 0 end as bigint) as sin from orders group by 1",
    "tool_identity": f"with {_SCENE} select refno, noun, '/' || refno as name from scene where refno = {4 * LEVEL + 1}",
    "tool_owner_chain": f"with {_CLOSED} select c.depth, e.refno, e.noun, '/' || e.refno as name, true as complete, false as truncated from closed c join scene e on e.refno = c.anc where c.refno = {4 * LEVEL + 1}",
    "tool_members": f"with {_SCENE} select refno, noun, '/' || refno as name, seq from scene where owner = {2 * LEVEL + 3} order by seq, refno limit 10 offset 2",
    "tool_generation_root": f"with {_CLOSED}, {_ROOTS} select refno, root, kind from roots where refno = {4 * LEVEL + 1}",
    "tool_change_impact": f"with {_CHANGED} select * from changed where refno = {4 * LEVEL + 1}",
    "tool_spatial_bounds": f"with {_CLOSED} select c.anc as root, " + ", ".join(f"cast({f}(o_orderkey % {n}) {s} 1 as double) as {f}_{a}" for f, s in (("min", "-"), ("max", "+")) for a, n in (("x", 10), ("y", 20), ("z", 30))) + f" from closed c join orders on {4 * LEVEL} + o_orderkey = c.refno where c.anc = {LEVEL + 2} group by 1",
    "branch_surface": """with l as (select l_orderkey as branch, l_linenumber as seq, sum(l_quantity) as length from lineitem group by 1, 2), x as (select *, count(*) filter (seq % 3 = 0) over (partition by branch order by seq) as place, seq = max(seq) over (partition by branch) and seq % 3 = 0 as last from l)
 select branch, sum(length) as length, round(sum(case when last then seq when place = 0 then 10.0 when place = 1 and branch % 2 = 0 then 20.0 else seq end * 3.141592653589793::double * length), 4) as surface from x group by 1""",
    "default_names": f"select {2 * LEVEL} + n_nationkey as refno, 'ZONE ' || o || ' of ' || p as name, cast(o as int) as ordinal, p as owner_name from (select n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as o, '/' || ({LEVEL} + n_regionkey) as p from nation)",
    "vague_search": "select p_partkey, p_type from part where p_type like '%A%D%' and p_type not like '%PROMO%' and (contains(p_type, 'STAND') or contains(p_type, 'LARGE') or contains(p_type, 'MEDI'))",
    "classify_by_name": "select p_partkey, case when contains(p_type, 'STANDARD') then 'std' when contains(p_type, 'ECONOM') then 'econ' when contains(p_type, 'LARGE') then 'large' when contains(p_type, 'A') then 'a' when contains(p_type, 'O') then 'o' else 'else' end as code from part",
    "step_function": "select p_partkey, cast(case when p_size <= 10 then 1.5 when p_size <= 20 then 2.5 when p_size <= 40 then 4.0 else 8.0 end as double) as loss from part",
    "cascade_roots": f"""with {_CLOSED}, {_ROOTS}, edges as ({_REFS}), seeds as (select unnest([{6 * LEVEL} + 1, {6 * LEVEL} + 2, {6 * LEVEL} + 3]) as refno),
 walk as (select refno as root, 'none' as kind, 0 as hops from seeds union select coalesce(r.root, e.referrer), coalesce(r.kind, 'none'), w.hops + 1 from walk w join edges e on e.referenced = w.root left join roots r on r.refno = e.referrer where w.kind <> 'unit' and w.hops < 8)
 select root, kind, min(hops) as hops, false as truncated from walk where kind <> 'none' group by 1, 2""",
    "reverse_index": f"select distinct * from ({_REFS}) where (referrer - {4 * LEVEL}) % 3 <> 0 or referrer not in (select o_orderkey + {4 * LEVEL} from orders) union select o_orderkey + {4 * LEVEL}, {6 * LEVEL} + 1 from orders where o_orderkey % 3 = 0",
    "reference_along_path": f"with {_CLOSED} select c.refno, arg_min(c.anc, c.depth) as holder, arg_min(c.anc, c.depth) % 97 as referenced from closed c join scene e on e.refno = c.anc where e.noun in ('STRU', 'ZONE') group by 1",
    "version_at": f"with {_HISTORY} select refno, sesno, op, value from h where sesno <= 4 qualify row_number() over (partition by refno order by sesno desc, seq desc) = 1 and op <> 'D'",
    "version_at_date": f"with {_HISTORY}, s as (select user_id % 5 as dbnum, event_id // 100 as sesno, min(ts) as date from events group by 1, 2), u as (select dbnum, max(sesno) as upto from s where date <= timestamp '2024-01-01 12:00:00' group by 1) select refno, sesno, op, value from h join u using (dbnum) where sesno <= upto qualify row_number() over (partition by refno order by sesno desc, seq desc) = 1 and op <> 'D'",
    "signed_parts": f"with {_SCENE} select owner, coalesce(string_agg(refno, ',' order by refno) filter (noun in ('PIPE', 'BRAN')), '') as positive, string_agg(refno, ',' order by refno) filter (noun = 'LOOP') as negative from scene where noun in ('PIPE', 'BRAN', 'LOOP') group by 1 having count(*) filter (noun = 'LOOP') > 0",
    "uncovered_nouns": f"with {_SCENE} select noun, count(*) as n from scene where noun not in ('BRAN', 'EQUI', 'PIPE', 'STRU') group by 1",
    "stiffeners": """with p as (select p_partkey as refno, p_size * 50.0::double as w, (p_partkey % 2000)::double as h, (p_partkey % 5 * 1000 + 950)::double as l, case when p_size % 2 = 0 then 'RECT/L' else 'RECT/M' end as shape, p_partkey % 7 as m from part),
 r as (select *, greatest(w, h) as g, case when shape = 'RECT/L' then case when greatest(w, h) < 800 then 0 when greatest(w, h) < 2000 and m <> 6 then 1 when greatest(w, h) >= 1200 then 2 end when greatest(w, h) >= 500 and greatest(w, h) < 2000 and m not in (1, 2) then 1 end as expr from p),
 x as (select *, case expr when 1 then (w + h + 83) * 2 / 1000 when 2 then (w + h + 103) * round(l / 800 - 0.5) * 2 / 1000 else 0 end as metres, case when shape = 'RECT/L' and g < 2000 then 2.5::double else 3.5::double end as scale from r)
 select refno, case expr when 2 then 'B' when 0 then 'A' when 1 then 'A' else '-' end as section, round(metres, 4) as metres, round(scale * metres, 4) as weight from x""",
    "mesh_rooms": f"""with p as (select p_partkey + {6 * LEVEL} as panel, 'K' || p_partkey as room_num, p_partkey % 50 * 10 as px, (p_partkey // 50) * 10 as py, p_size % 5 + 4 as h from part),
 o as (select o_orderkey as element, o_orderkey * 37 % 500 as x, o_orderkey // 40 as y, o_custkey % 10 as z, 1 + o_orderkey % 3 as r from orders),
 c as (select element, x + i * r as x, y + j * r as y, z + k * r as z from o, (values (-1), (1)) a(i), (values (-1), (1)) b(j), (values (-1), (1)) e(k)),
 held as (select panel, element from c join p on x >= px and x < px + 8 and y >= py and y < py + 8 and (x < px + 4 or y < py + 4) and z between 0 and h),
 n as (select panel, element, cast(count(*) as int) as inside_count from held group by 1, 2),
 l as (select l_orderkey as element, x + l_linenumber % 3 - 1 as x, y + l_quantity % 3 - 1 as y, z from lineitem join o on element = l_orderkey),
 proved as (select distinct panel, element from n join l using (element) join p using (panel) where x >= px and x < px + 8 and y >= py and y < py + 8 and (x < px + 4 or y < py + 4) and z between 0 and h)
 select panel, element, inside_count, sqrt((x - px - 4)::double ** 2 + (y - py - 4)::double ** 2 + (z - h / 2.0)::double ** 2) as center_dist, room_num from n join p using (panel) join o using (element)
 where inside_count = 8 or (panel, element) in (select (panel, element) from proved)""",
    "room_panels": f"""with rooms as (select n_nationkey, {2 * LEVEL} + n_nationkey as room, 'K' || (n_nationkey + 100) as room_num from nation where n_nationkey % 4 <> 0),
 c as (select room, room_num, n_nationkey, c_custkey from rooms join customer on c_nationkey = n_nationkey)
 select room, room_num, {3 * LEVEL} + c_custkey as panel from c where ({3 * LEVEL} + c_custkey) % 3 = 0 union all select room, room_num, {4 * LEVEL} + o_orderkey from c join orders on o_custkey = c_custkey where n_nationkey % 2 = 0 and ({4 * LEVEL} + o_orderkey) % 3 = 0""",
}
