"""What a change does to the model: effects of attributes, impact of operations, generation roots, root cover, work plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attribute names by effect.
DATA_ONLY = "NAME DESC PURP FUNCTION CACHID LCHKDA"
STRUCTURAL = "OWNER CHILDREN NOUN TYPE LEVE LEVEL"
TRANSFORM = "POS ORI"
CASCADE = """CATR CREF SPRE SPREF PSPREF FSPREF SCREF PSPE PRTREF DESP DKEY DDPR GMREF GMRE GSTR GTYP DPRO DTRE ISPE DDANGLE DDHEIGHT
DDRADIUS IPARAM HREF TREF LSTU HSTU STYP CONN HPOS TPOS HDIR TDIR HBOR TBOR ADIR RDIR LDIR ZDIS LEAV CURD CURTYP OPDI
ROUT DRNS DRNE DETR DELP RINS CTYP JFRE JLIN PKEY PPRO PSTR PTRE PTYP PVER PKDI"""
GEOMETRY = """ANGF ANGL ABOR LBOR PBOR SBOR BORE XLEN YLEN ZLEN LENG HEIG DIAM RADI IRAD ORAD FRAD DRAD CRAD
DTOP DBOT XBOT YBOT XTOP YTOP XOFF YOFF ZOFF THIC WIDE DEPT SIZE SHEA TAPER ECC DWID DHEI DIMD SDIA SHEI STHI SWID
ARRHEI ARRI ARRWID LEAHEI LEAWID MAXA CENT DCEN UBOT UCEN UTOP PTDI PTCI PAXI PHEI PANG PPOS PXDI PYDI PZDI PAAX PBAX PBBT
PBDI PBDM PBOF PBTP PCAX PCBT PCOF PCON PCTP PDIA PDIS PLAX POFF PRAD PTCD PTCP PTCPOS PTDM PWID PXBS PXLE PXTS PYBS
PYLE PYTS PZAXI PZLE PARA PARAM UNIPAR NAPP NGMR SJUS ORRF PTOF VXREF CLFL JUSL NUMB RPRO TUFL OBST NEG POSI BOOL
PX PY PZ DX DY POSL POSS POSE NPOS CPOS YDIR ZDIR BANG"""
EFFECTS = {"data": DATA_ONLY, "structural": STRUCTURAL, "transform": TRANSFORM, "cascade": CASCADE, "geometry": GEOMETRY}
# Nouns by their part in generation.
UNITS = ("BRAN", "HANG", "SUPPO", "EQUI")
CONTAINERS = ("WORL", "WORLD", "SITE", "ZONE")
LOOPS = ("LOOP", "PLOO", "VERT", "PAVE", "JLDATU", "PLDATU", "ENDATU", "SPINE")
COMPONENTS = ("FTUB",)
DERIVED = ("BRAN", "HANG")
DONE = ("Generated", "AlreadyAvailable", "NoRenderableGeometry")
REFUSED = ("http_422",)


def unit_types(replace: tuple[str, ...] = (), append: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Delivery-unit nouns of a project: the defaults or their replacement, and more; containers are refused."""
    found = tuple(dict.fromkeys(n.strip().upper() for n in (*(replace or UNITS), *append)))
    if set(found) & set(CONTAINERS):
        raise ValueError("INVALID_ARGUMENT: a container is no delivery unit")
    return found


def is_loop(noun: Column) -> Column:
    return noun.isin(*LOOPS) | noun.endswith("DATU")


def attribute_name(raw: Column) -> Column:
    """Without the prefix att. and what follows a dot, in upper case."""
    return F.upper(F.split_part(F.regexp_replace(F.trim(raw), "^(?:att\\.|ATT\\.)+", ""), F.lit("."), F.lit(1)))


def attribute_effect(raw: Column, is_reference: Column | None = None) -> Column:
    """data, structural, transform, cascade, geometry or unknown; an unknown name that is a reference cascades."""
    name = attribute_name(raw)
    known = F.create_map(*(F.lit(x) for effect, names in EFFECTS.items() for n in names.split() for x in (n, effect)))
    out = F.coalesce(F.try_element_at(known, name), F.when(name.startswith("PARA"), "geometry"))
    if is_reference is not None:
        out = F.coalesce(out, F.when(is_reference, "cascade"))
    return F.coalesce(out, F.lit("unknown"))


def operation_impact(op: Column, attributes: Column, children_changed: Column, noun: Column) -> Column:
    """regen, transform or skip.  Additions, deletions, changed children and changes without a known attribute
    regenerate; a change of pose alone moves, but a loop container's regenerates; mere data is skipped.  A null list of
    attributes is an empty one, null operations and attributes are unknown ones, null children have not changed."""
    names = F.coalesce(attributes, F.array().cast("array<string>"))
    effects = F.transform(names, lambda a: attribute_effect(F.coalesce(a, F.lit(""))))
    regen = F.coalesce(op != "M", F.lit(True)) | F.coalesce(children_changed, F.lit(False)) | (F.size(names) < 1) | F.exists(effects, lambda e: ~e.isin("data", "transform"))
    pose = F.array_contains(effects, "transform")
    return F.when(regen | (pose & is_loop(F.coalesce(noun, F.lit("")))), "regen").when(pose, "transform").otherwise("skip")


def generation_roots(elements: DataFrame, closed: DataFrame, units: tuple[str, ...] = UNITS) -> DataFrame:
    """(refno, root, kind): the nearest self-or-ancestor that is a delivery unit (kind unit); else the nearest owner that
    is neither loop container nor component, and where that is a container or missing, the element itself (kind normal).
    Containers, and loop containers without such an owner, have no root.  One aggregation over the closure."""
    kinds = elements.select(F.col("refno").alias("anc"), "noun")
    chain = closed.join(kinds, "anc")
    step = F.struct("depth", "anc", F.col("noun").isin(*CONTAINERS).alias("container"))
    found = chain.groupBy("refno").agg(
        F.min(F.when(F.col("noun").isin(*units), step)).alias("unit"),
        F.min(F.when((F.col("depth") > 0) & ~is_loop(F.col("noun")) & ~F.col("noun").isin(*COMPONENTS), step)).alias("owner"),
        F.max(F.when(F.col("depth") == 0, F.col("noun"))).alias("noun"),
    )
    itself = F.when(~is_loop(F.col("noun")), F.col("refno"))
    normal = F.when(F.col("noun").isin(*CONTAINERS), None).when(F.col("owner.container") | F.col("owner").isNull(), itself).otherwise(F.col("owner.anc"))
    root = F.coalesce("unit.anc", normal)
    return found.select("refno", root.alias("root"), F.when(F.col("unit").isNotNull(), "unit").otherwise("normal").alias("kind")).where("root is not null")


def root_cover(elements: DataFrame, closed: DataFrame, units: tuple[str, ...] = UNITS) -> DataFrame:
    """(root, kind, noun, subtree): roots whose subtrees don't overlap and hold every live element that is no container.
    kind mdu: outermost delivery units.  kind residue: the highest elements whose subtrees hold no unit, and those whose
    owner is missing.  elements: refno, owner, noun, deleted."""
    nouns = elements.select(F.col("refno").alias("anc"), "noun")
    above = closed.where("depth > 0").join(nouns, "anc")
    inside = above.where(F.col("noun").isin(*units)).select("refno").distinct()
    live = elements.where(~F.coalesce("deleted", F.lit(False)))
    mdu = live.where(F.col("noun").isin(*units)).join(inside, "refno", "left_anti")
    bearing = above.join(mdu.select("refno"), "refno", "left_semi").select(F.col("anc").alias("refno")).distinct()
    parents = bearing.union(live.where(F.col("noun").isin(*CONTAINERS)).select("refno")).distinct()
    rest = live.where(~F.col("noun").isin(*units, *CONTAINERS, *LOOPS)).join(bearing, "refno", "left_anti")
    below = rest.join(parents.select(F.col("refno").alias("owner")), "owner", "left_semi")
    orphans = rest.join(elements.select(F.col("refno").alias("owner")), "owner", "left_anti")
    roots = mdu.select("refno", "noun", F.lit("mdu").alias("kind")).unionByName(below.unionByName(orphans).select("refno", "noun", F.lit("residue").alias("kind")))
    size = closed.groupBy(F.col("anc").alias("refno")).agg(F.count("*").alias("subtree"))
    return roots.join(size, "refno").select(F.col("refno").alias("root"), "kind", "noun", "subtree")


def root_covers(closed: DataFrame, cover: DataFrame) -> DataFrame:
    """(root, member): every element of the roots' subtrees."""
    return closed.join(cover.select(F.col("root").alias("anc")), "anc").select(F.col("anc").alias("root"), F.col("refno").alias("member"))


def cover_progress(cover: DataFrame, status: DataFrame) -> DataFrame:
    """One row for each kind: roots in total, done, refused and to do, with the elements they stand for."""
    j = cover.join(status.select("root", "status"), "root", "left")
    s = F.coalesce("status", F.lit(""))
    done, refused = s.isin(*DONE), s.isin(*REFUSED)
    return j.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(refused).alias("refused"), F.count_if(~done & ~refused).alias("todo"), F.sum("subtree").alias("elements_total"), F.coalesce(F.sum(F.when(done, F.col("subtree"))), F.lit(0)).cast("bigint").alias("elements_done"))


def roots_todo(cover: DataFrame, status: DataFrame) -> DataFrame:
    """Roots without a final status, those with large subtrees first."""
    ended = status.where(F.col("status").isin(*DONE, *REFUSED)).select("root")
    return cover.join(ended, "root", "left_anti").orderBy(F.desc("subtree"), "root")


def work_plan(changes: DataFrame, roots: DataFrame, nouns: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """changes: refno, op, impact.  roots: refno, root.  nouns: refno, noun.  Distinct (action, target): delete of what
    went, regen of the roots that are touched; a change of pose moves its element, but under a branch or hanger it
    regenerates the root.  With closed (refno, anc, depth), branches and hangers below whatever moves regenerate too: their
    tubes follow from where their members are."""
    j = changes.join(roots, "refno", "left").join(nouns.select(F.col("refno").alias("root"), F.col("noun").alias("root_noun")), "root", "left")
    whole = (F.col("impact") == "regen") | F.coalesce(F.col("root_noun").isin(*DERIVED), F.lit(False))
    items = F.array(
        F.when(F.col("op") == "D", F.struct(F.lit("delete").alias("action"), F.col("refno").alias("target"))),
        F.when((F.col("impact") != "skip") & whole & F.col("root").isNotNull() & ~((F.col("op") == "D") & (F.col("root") == F.col("refno"))), F.struct(F.lit("regen").alias("action"), F.col("root").alias("target"))),
        F.when((F.col("impact") == "transform") & ~whole, F.struct(F.lit("transform").alias("action"), F.col("refno").alias("target"))),
    )
    plan = j.select(F.explode(F.array_compact(items)).alias("x")).select("x.*")
    if closed is not None:
        moved = changes.where("impact = 'transform'").select(F.col("refno").alias("anc"))
        derived = nouns.where(F.col("noun").isin(*DERIVED)).select("refno")
        below = closed.where("depth > 0").join(moved, "anc", "left_semi").join(derived, "refno", "left_semi")
        plan = plan.union(below.select(F.lit("regen"), "refno"))
    return plan.distinct()


def children_delta(old: Column, new: Column) -> Column:
    """Struct: children that came and went, and whether those that stayed changed their order."""
    stay_old, stay_new = F.array_intersect(old, new), F.array_intersect(new, old)
    return F.struct(F.array_except(new, old).alias("came"), F.array_except(old, new).alias("went"), (stay_old != stay_new).alias("reordered"))
