"""Deliveries to the stream: doubled, re-ordered, replayed, and of files that are not in order."""

from verdigris.streaming import updates

ROWS = [(1, 10, 1, 1, "A"), (1, 10, 1, 2, "D"), (1, 11, 1, 3, "A"), (2, 20, 5, 1, "M")]
LATER = [(1, 10, 2, 1, "A"), (2, 20, 6, 1, "D")]


def _put(spark, rows, folder):
    spark.createDataFrame(rows, updates.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _state(spark, folder):
    return sorted(tuple(r) for r in updates.net(spark, folder).collect())


def test_doubled_within_a_batch(spark, tmp_path):
    once, twice = (f"{tmp_path}/{n}" for n in ("once", "twice"))
    _put(spark, ROWS, f"{once}/in")
    _put(spark, ROWS, f"{twice}/in")
    _put(spark, ROWS[::-1], f"{twice}/in")
    for f in (once, twice):
        updates.start(spark, f"{f}/in", f"{f}/out").awaitTermination()
    assert _state(spark, f"{once}/out") == _state(spark, f"{twice}/out")
    assert {(r["refno"], r["n_ops"]) for r in updates.net(spark, f"{twice}/out").collect()} == {(10, 2), (11, 1), (20, 1)}
    assert [r["reason"] for r in updates.rejected(spark, f"{twice}/out").collect()] == ["repeated"] * 4
    # again in another batch, beside what is new
    for rows in (ROWS, LATER):
        _put(spark, rows, f"{twice}/in")
    _put(spark, LATER, f"{once}/in")
    for f in (once, twice):
        updates.start(spark, f"{f}/in", f"{f}/out").awaitTermination()
    assert _state(spark, f"{once}/out") == _state(spark, f"{twice}/out")
    assert sorted(r["reason"] for r in updates.rejected(spark, f"{twice}/out").collect()) == ["late"] * 4 + ["repeated"] * 4


def test_verdicts_stop_databases(spark, tmp_path):
    listed = "dbnum int, db_type string, path string, latest bigint"
    f, now = str(tmp_path), {}

    def run(rows, files):
        now["files"] = files
        _put(spark, rows, f"{f}/in")
        updates.start(spark, f"{f}/in", f"{f}/out", files=lambda: spark.createDataFrame(now["files"], listed)).awaitTermination()
        return {r["dbnum"]: r["verdict"] for r in updates.verdicts(spark, f"{f}/out").where(f"batch = {run.batch}").collect()}

    run.batch = 0
    assert run(ROWS, [(1, "DESI", "a", 1), (2, "DESI", "b", 5)]) == {1: "new", 2: "new"}
    before = _state(spark, f"{f}/out")
    run.batch = 1
    assert run(LATER, [(1, "DESI", "a", 0), (2, "DESI", "b", 6), (2, "DESI", "c", 6)]) == {1: "rollback", 2: "duplicate"}
    assert _state(spark, f"{f}/out") == before
    assert [r["reason"] for r in updates.rejected(spark, f"{f}/out").collect()] == ["blocked"] * 2
    run.batch = 2
    assert run(LATER, [(1, "CATA", "a", 2), (2, "DESI", "moved", 6)]) == {1: "type_changed", 2: "migrated"}
    assert {r["dbnum"]: r["applied_sesno"] for r in updates.control(spark, f"{f}/out").collect()} == {1: 1, 2: 6}
    run.batch = 3
    assert run([(2, 21, 7, 1, "A")], [(2, "DESI", "moved", 7)]) == {1: "missing", 2: "ok"}
