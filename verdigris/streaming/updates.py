"""Incremental updates: micro-batches of closed sessions, gated, folded, written by key, with a control table last.

A batch may come again after a failure: its output folders are named by its id and overwritten, and what it holds is
gated by the batches before it alone, so a replay writes the same.  A session that is delivered again in another file is
late by then and is set aside, and so are operations that come twice within a batch: each (dbnum, sesno, seq, refno)
counts once.  What is set aside stays under folder/rejected with its reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.changes import fold_maps, join_windows

SCHEMA = "dbnum int, refno bigint, sesno bigint, seq bigint, op string"
#: Kinds of databases that may begin without a watermark.  Fixed values.
COLD_START = ("SYST", "DICT", "GLB", "GLOB")
_CONTROL = "dbnum int, applied_sesno bigint, db_type string, path string, batch bigint"


def anomalies(files: DataFrame, applied: DataFrame, project: str | None = None) -> DataFrame:
    """files: dbnum, db_type, path, latest, and project if one is given.  applied: dbnum, db_type, path, applied_sesno.  One
    verdict for each database, the first that holds: foreign (another project's file), duplicate (several files), missing
    (it has no file any more), new, rollback, type_changed, migrated (does not block), ok."""
    mine = F.lit(True) if project is None else F.col("project").eqNullSafe(project)
    f = files.groupBy("dbnum").agg(F.count_if(~mine).alias("foreign"), F.countDistinct("path").alias("paths"), F.max("db_type").alias("db_type"), F.max("path").alias("path"), F.max("latest").alias("latest"))
    a = applied.select("dbnum", F.col("db_type").alias("old_type"), F.col("path").alias("old_path"), "applied_sesno", F.lit(True).alias("known"))
    j = f.join(a, "dbnum", "full")
    rules = [("foreign", F.col("foreign") > 0), ("duplicate", F.col("paths") > 1), ("missing", F.col("paths").isNull()), ("new", F.col("known").isNull()),
             ("rollback", F.col("latest") < F.col("applied_sesno")), ("type_changed", F.col("db_type") != F.col("old_type")), ("migrated", F.col("path") != F.col("old_path"))]
    verdict = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        verdict = verdict.when(holds, name)
    return j.withColumn("verdict", verdict.otherwise("ok")).select("dbnum", "verdict", F.col("verdict").isin("foreign", "duplicate", "missing", "rollback", "type_changed").alias("blocked"))


def gate(batch: DataFrame, applied: DataFrame, kinds: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """batch: rows of SCHEMA.  applied: dbnum, applied_sesno.  kinds: dbnum, db_type.  blocked: dbnum.  Adds reason, null for
    rows that may be applied: broken (no key, session or known operation: a dead letter), blocked, cold (a database of a
    kind that may not begin without a watermark, where kinds are given), late (its session is applied already) or repeated
(an operation of its session, number and element comes earlier in the batch).  Sides are broadcast by Spark's own check
of their sizes."""
    known = [batch[c].isNotNull() for c in ("dbnum", "refno", "sesno", "seq")]
    sound = known[0] & known[1] & known[2] & known[3] & F.coalesce(batch["op"].isin("A", "M", "D"), F.lit(False))
    j = batch.withColumn("__sound", sound).join(applied.select("dbnum", "applied_sesno"), "dbnum", "left")
    stop, cold = F.lit(False), F.lit(False)
    if blocked is not None:
        j = j.join(blocked.select("dbnum", F.lit(True).alias("__blocked")).distinct(), "dbnum", "left")
        stop = F.coalesce("__blocked", F.lit(False))
    if kinds is not None:
        j = j.join(kinds.select("dbnum", F.col("db_type").alias("__kind")), "dbnum", "left")
        cold = F.col("applied_sesno").isNull() & ~F.coalesce(F.col("__kind").isin(*COLD_START), F.lit(False))
    late = F.coalesce(F.col("sesno") <= F.col("applied_sesno"), F.lit(False))
    reason = F.when(~F.col("__sound"), "broken").when(stop, "blocked").when(cold, "cold").when(late, "late")
    first = F.row_number().over(Window.partitionBy("dbnum", "sesno", "seq", "refno").orderBy("op"))
    reason = reason.when((first > 1) & F.col("__sound"), "repeated")
    return j.select(*batch.columns, reason.alias("reason"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batches, empty before the first one."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def control(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Applied session of each database: the most of all batches' entries, or of those before one."""
    rows = _read(spark, f"{folder}/control", _CONTROL)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("dbnum").agg(F.max("applied_sesno").alias("applied_sesno"))


def _known(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """dbnum, db_type, path, applied_sesno, as `anomalies` asks: kind and path are those of the last batch that knew them."""
    rows = _read(spark, f"{folder}/control", _CONTROL).where(F.col("batch") < before)
    at = F.when(F.col("path").isNotNull(), F.col("batch"))
    return rows.groupBy("dbnum").agg(F.max_by("db_type", at).alias("db_type"), F.max_by("path", at).alias("path"), F.max("applied_sesno").alias("applied_sesno"))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """dbnum, verdict, blocked, batch: what `anomalies` said before each batch."""
    return _read(spark, f"{folder}/verdicts", "dbnum int, verdict string, blocked boolean, batch bigint")


def net(spark: SparkSession, folder: str) -> DataFrame:
    """dbnum, refno, net, n_ops, last_sesno: the fold over all batches, as if they had been one."""
    rows = _read(spark, f"{folder}/net", "dbnum int, refno bigint, map array<string>, n_ops bigint, last_sesno bigint, batch bigint")
    windows = rows.select(F.struct("dbnum", "refno").alias("refno"), F.col("batch").alias("window"), "map", "n_ops", "last_sesno")
    return join_windows(windows).select("refno.dbnum", "refno.refno", "net", "n_ops", "last_sesno")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """What was set aside, with its reason and batch."""
    return _read(spark, f"{folder}/rejected", f"{SCHEMA}, reason string, batch bigint")


def start(
    spark: SparkSession,
    source: str,
    folder: str,
    kinds: DataFrame | None = None,
    blocked: DataFrame | None = None,
    publish: Callable[[DataFrame, int], None] | None = None,
    files: Callable[[], DataFrame] | None = None,
    project: str | None = None,
) -> StreamingQuery:
    """Reads new change files under source and gates each batch by the sessions that earlier ones applied.  files(), if
    given, lists the databases' files as `anomalies` reads them; it is asked anew before each batch, and databases whose
    verdict blocks are set aside.  Writes what is set aside under folder/rejected, verdicts under folder/verdicts, folds of
    operations under folder/net and applied sessions under folder/control, the latter last; then publish(applied sessions of
    the batch, its id), if given, which may come more than once for a batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        stopped, seen = None if blocked is None else blocked.select("dbnum"), None
        if files is not None:
            listed = files()
            found = anomalies(listed, _known(spark, folder, batch_id), project)
            found.write.mode("overwrite").parquet(f"{folder}/verdicts/batch={batch_id}")
            mine = spark.read.parquet(f"{folder}/verdicts/batch={batch_id}").where("blocked").select("dbnum")
            stopped = mine if stopped is None else stopped.union(mine)
            seen = listed.groupBy("dbnum").agg(F.max("db_type").alias("db_type"), F.max("path").alias("path"))
        gated = gate(batch, control(spark, folder, before=batch_id), kinds, stopped).persist()
        try:
            gated.where("reason is not null").write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch_id}")
            good = gated.where("reason is null")
            folded = fold_maps(good.withColumn("refno", F.struct("dbnum", "refno"))).select("refno.dbnum", "refno.refno", "map", "n_ops", "last_sesno")
            folded.write.mode("overwrite").parquet(f"{folder}/net/batch={batch_id}")
            done = good.groupBy("dbnum").agg(F.max("sesno").alias("applied_sesno"))
            none = F.lit(None).cast("string")
            done = done.select("dbnum", "applied_sesno", none.alias("db_type"), none.alias("path")) if seen is None else done.join(seen, "dbnum", "left")
            done.write.mode("overwrite").parquet(f"{folder}/control/batch={batch_id}")
            if publish is not None:
                publish(spark.read.parquet(f"{folder}/control/batch={batch_id}").select("dbnum", "applied_sesno"), batch_id)
        finally:
            gated.unpersist()

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
