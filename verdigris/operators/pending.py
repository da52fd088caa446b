"""Batches in the queue and pending work, as keyed tables.

A database has at most one running and one queued batch.  What each observation of a file's latest session does follows
from the ones before it, so it is a window over the database's observations rather than a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enqueued(observations: DataFrame) -> DataFrame:
    """observations: dbnum, seq, applied, latest (null: the queued batch starts to run and is frozen).  Adds outcome: new,
    merged (the queued batch's end rises), behind_running (a new batch after the frozen one) or covered."""
    before = Window.partitionBy("dbnum").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    useful = F.when(F.col("latest") > F.col("applied"), F.col("latest"))
    top = F.max(useful).over(before)
    freezes = F.count_if(F.col("latest").isNull()).over(before)
    marked = observations.select("*", freezes.alias("__round"), top.alias("__top"))
    raises = useful.isNotNull() & (F.col("latest") > F.coalesce("__top", F.col("applied")))
    marked = marked.withColumn("__raises", F.coalesce(raises, F.lit(False)))
    earlier = Window.partitionBy("dbnum", "__round").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    queued = F.coalesce(F.max("__raises").over(earlier), F.lit(False))
    outcome = F.when(~F.col("__raises"), "covered").when(queued, "merged").when(F.col("__top").isNotNull(), "behind_running").otherwise("new")
    return marked.select("*", outcome.alias("outcome")).where("latest is not null").select(*observations.columns, "outcome")


def advance(applied: DataFrame, batches: DataFrame) -> DataFrame:
    """Applied session by database: never falls."""
    return applied.select("dbnum", "applied").union(batches.select("dbnum", F.col("end").alias("applied"))).groupBy("dbnum").agg(F.max("applied").alias("applied"))


def upsert(pending: DataFrame, plan: DataFrame) -> DataFrame:
    """pending: action, target, revision, attempts.  Work planned again gets the next revision and no attempts."""
    j = pending.join(plan.select("action", "target", F.lit(True).alias("again")).distinct(), ["action", "target"], "full_outer")
    again = F.coalesce("again", F.lit(False))
    return j.select("action", "target", (F.coalesce("revision", F.lit(0)) + again.cast("int")).cast("bigint").alias("revision"), F.when(again, 0).otherwise(F.col("attempts")).cast("int").alias("attempts"))


def settle(pending: DataFrame, results: DataFrame) -> DataFrame:
    """results: action, target, revision, ok.  A success of the revision it saw ends the work; a failure counts an attempt;
    results of older revisions change nothing."""
    r = results.groupBy("action", "target", "revision").agg(F.max("ok").alias("ok"))
    j = pending.join(r, ["action", "target", "revision"], "left").where("not coalesce(ok, false)")
    return j.select("action", "target", "revision", (F.col("attempts") + F.col("ok").isNotNull().cast("int")).alias("attempts"))


def count_targets(pending: DataFrame, most_attempts: int) -> DataFrame:
    """Live and dead work by action."""
    dead = F.col("attempts") >= most_attempts
    return pending.groupBy("action").agg(F.count_if(~dead).alias("live"), F.count_if(dead).alias("dead"))


def authoritative_members(lists: DataFrame) -> DataFrame:
    """lists: owner, sesno, children.  (owner, seq, child) of each owner's latest list, a child's first place only."""
    latest = lists.groupBy("owner").agg(F.max_by("children", "sesno").alias("children"))
    return latest.select("owner", F.posexplode(F.array_distinct(F.filter("children", lambda c: c.isNotNull()))).alias("seq", "child"))


def prune_resurrected(members: DataFrame, authoritative: DataFrame) -> DataFrame:
    """Members that the latest lists still name."""
    return members.join(authoritative.select("owner", "child"), ["owner", "child"], "left_semi")
