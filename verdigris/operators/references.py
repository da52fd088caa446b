"""The typed reference graph: reversal, keyed replacement, cascades to generation roots, references along the owner path,
and reads of the past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.scratch import Scratch


def cascade_targets(references: DataFrame) -> DataFrame:
    """References that a change passes along: any but the owner, none to the element itself."""
    return references.where("attr <> 'OWNER' and referrer <> referenced").select("referrer", "referenced").distinct()


def replace_edges(edges: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """The reverse index after a batch: every outgoing edge of a touched element (refno) gives way to its fresh ones."""
    cols = ["referrer", "referenced"]
    kept = edges.join(touched.select(F.col("refno").alias("referrer")), "referrer", "left_anti").select(*cols)
    return kept.union(fresh.select(*cols)).distinct()


def cascade_roots(edges: DataFrame, seeds: DataFrame, roots: DataFrame, max_hops: int | None = None) -> DataFrame:
    """edges: referrer, referenced.  seeds: refno.  roots: refno, root, kind.  (root, kind, hops, truncated): generation
    roots that a change of the seeds reaches through their referrers, with the fewest hops.  A delivery unit ends its path;
    the referrers of a normal root, and of an element without one, are followed until nothing new comes, or for max_hops
    rounds; truncated tells of a root whose referrers were left out then.  Each round joins its new rows only."""
    scratch = Scratch(edges.sparkSession)
    back = edges.select(F.col("referenced").alias("refno"), "referrer").distinct()
    of = roots.select(F.col("refno").alias("referrer"), "root", "kind")
    # kind: unit, normal, none (an element without a root), or seed
    seen = scratch.keep(seeds.select(F.col("refno").alias("root"), F.lit("seed").alias("kind"), F.lit(0).alias("hops")).where("root is not null").distinct(), "seen")
    hop = 0
    while True:
        front = seen.where((F.col("hops") == hop) & (F.col("kind") != "unit")).select(F.col("root").alias("refno"))
        if hop == max_hops or front.isEmpty():
            break
        hop += 1
        met = front.join(back, "refno").select("referrer").distinct().join(of, "referrer", "left").select(F.coalesce("root", "referrer").alias("root"), F.coalesce("kind", F.lit("none")).alias("kind"))
        seen = scratch.append(seen, met.distinct().join(seen, ["root", "kind"], "left_anti").withColumn("hops", F.lit(hop)))
    found = seen.where("kind <> 'seed'")
    out = found.where("kind <> 'none'").groupBy("root", "kind").agg(F.min("hops").alias("hops"))
    left = front.where(F.lit(hop == max_hops)).join(back, "refno", "left_semi").select(F.col("refno").alias("root"), F.lit(True).alias("truncated")).distinct()
    return out.join(left, "root", "left").select("root", "kind", "hops", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def first_reference_along_path(closed: DataFrame, references: DataFrame) -> DataFrame:
    """references: referrer, referenced.  (refno, holder, referenced): of the element and its owners, the nearest that
    refers to something; of several references, the least."""
    j = closed.join(references.select(F.col("referrer").alias("anc"), "referenced"), "anc")
    return j.groupBy("refno").agg(F.min(F.struct("depth", "anc", "referenced")).alias("n")).select("refno", F.col("n.anc").alias("holder"), "n.referenced")


def version_at(history: DataFrame, sesno: int) -> DataFrame:
    """history: refno, sesno, seq, op, value.  Each element as it was after the session; those deleted by then are gone."""
    last = history.where(F.col("sesno") <= sesno).groupBy("refno").agg(F.max_by(F.struct("sesno", "op", "value"), F.struct("sesno", "seq")).alias("h"))
    return last.select("refno", "h.*").where("op <> 'D'")


def version_at_date(history: DataFrame, sessions: DataFrame, date: str) -> DataFrame:
    """As version_at, by each database's last session up to a date.  history also has dbnum; sessions: dbnum, sesno, date."""
    last = sessions.where(F.col("date") <= F.lit(date).cast("timestamp")).groupBy("dbnum").agg(F.max("sesno").alias("upto"))
    rows = history.join(last, "dbnum").where("sesno <= upto")
    return version_at(rows, (1 << 63) - 1)


def signed_parts(parts: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """parts: owner, refno, noun.  Each owner's positive and negative geometry, for owners that have a negative one."""
    kind = F.col("noun")
    pick = lambda nouns: F.array_sort(F.collect_list(F.when(kind.isin(*nouns), F.col("refno"))))
    return parts.where(kind.isin(*positive, *negative)).groupBy("owner").agg(pick(positive).alias("positive"), pick(negative).alias("negative")).where("size(negative) > 0")


def uncovered_nouns(elements: DataFrame, routed: list[str]) -> DataFrame:
    """Nouns in use that no route takes, with their numbers."""
    return elements.where(~F.col("noun").isin(*routed)).groupBy("noun").agg(F.count("*").alias("n"))


#: Containers whose members belong to the geometry of what refers to them.  Fixed values.
CONTAINERS = ("GMSE", "GMSS", "NGMS", "PTSE", "PSTR", "SPRO", "DTSE", "SEXT", "NSEX", "SREV", "NSRE", "SLOO")


#: Ids of a round that may be broadcast.
FRONT = 50_000


def reference_closure(elements: DataFrame, edges: DataFrame, seeds: DataFrame, containers: tuple[str, ...] = CONTAINERS, max_rounds: int | None = None) -> DataFrame:
    """elements: refno, owner, noun, dbnum (those in scope, an id once).  edges: referrer, referenced.  seeds: refno.  All that the
    seeds need: what they refer to, their owners, and the members of containers, and so on.  refno, dbnum and the round
    that reached it; dbnum is null where it is in no table (missing).  Each round joins only what the last one added, until
    nothing new comes, or for max_rounds rounds: truncated tells of rows from which more would have followed then."""
    scratch = Scratch(elements.sparkSession)
    elements = scratch.keep(elements.select("refno", "owner", "noun", "dbnum").dropDuplicates(["refno"]), "elements")
    edges = scratch.keep(edges.select("referrer", "referenced").distinct(), "edges")
    columns = ["refno", "owner", "noun", "dbnum"]

    def little(df: DataFrame, n: int) -> DataFrame:
        """What a round adds is broadcast where it is little; the tables never are, however small their files look."""
        return F.broadcast(df) if n <= FRONT else df.hint("merge")

    def reach(to: DataFrame, seen: DataFrame | None, no: int) -> DataFrame:
        """The ids (refno) that nothing has reached, with the elements' columns."""
        to = scratch.keep(to.where("refno is not null").distinct(), "to")
        n = to.count()
        if seen is not None:
            to = to.join(seen.select("refno").join(little(to, n), "refno", "left_semi").hint("merge"), "refno", "left_anti")
        there = elements.join(little(to, n), "refno", "left_semi")
        return to.join(there.hint("merge"), "refno", "left").select(*columns, F.lit(no).alias("round"))

    def onward(found: DataFrame, n: int) -> DataFrame:
        """(refno, to): what the rows found need."""
        here = found.where("dbnum is not null")
        out = edges.join(little(here.select(F.col("refno").alias("referrer")), n), "referrer").select(F.col("referrer").alias("refno"), F.col("referenced").alias("to"))
        up = here.select("refno", F.col("owner").alias("to"))
        holders = here.where(F.col("noun").isin(*containers)).select(F.col("refno").alias("owner"))
        down = elements.select("refno", "owner").join(little(holders, n), "owner").select(F.col("owner").alias("refno"), F.col("refno").alias("to"))
        return out.union(up).union(down).where("to is not null")

    seen, no = scratch.keep(reach(seeds.select("refno"), None, 0), "seen"), 0
    while True:
        found = seen.where(F.col("round") == no)
        n = found.count()
        if n == 0:
            return seen.select("refno", "dbnum", "round", F.lit(False).alias("truncated"))
        no += 1
        if no == max_rounds:
            left = onward(found, n).join(seen.select(F.col("refno").alias("to")).hint("merge"), "to", "left_anti").select("refno", F.lit(True).alias("truncated")).distinct()
            return seen.join(left.hint("merge"), "refno", "left").select("refno", "dbnum", "round", F.coalesce("truncated", F.lit(False)).alias("truncated"))
        seen = scratch.append(seen, reach(onward(found, n).select(F.col("to").alias("refno")), seen, no))


def user_values(elements: DataFrame, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """elements: refno, noun.  values: refno, name, value.  definitions: name, noun, default; once each.  The user
    attributes of each element as refno, name, value: its own, else the default of its noun's definition."""
    usual = elements.join(definitions, "noun").select("refno", "name", "default")
    own = values.join(elements.select("refno"), "refno", "left_semi")
    return usual.join(own, ["refno", "name"], "full").select("refno", "name", F.coalesce("value", "default").alias("value"))
