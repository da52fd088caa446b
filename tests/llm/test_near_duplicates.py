"""The pipeline keeps one row of each group of near copies, whatever the ids are."""

import corpus_pipeline
from verdigris.plans.scratch import Scratch

WORDS = " ".join(f"w{i}" for i in range(60))
NEAR = WORDS.replace("w59", "x59")
OTHER = " ".join(f"v{i}" for i in range(60))
THIRD = " ".join(f"u{i}" for i in range(60))
NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_group(spark):
    rows = [(5, WORDS), (5, WORDS), (None, WORDS), (None, NEAR), (3, NEAR), (3, NEAR), (9, NEAR), (None, OTHER), (None, OTHER), (None, OTHER.replace("v0 ", "y0 ")), (7, THIRD), (7, WORDS), (8, ""), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], NAMES).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    # the group of OTHER has null ids only; which of its two texts stays is free
    assert len([t for i, t in got if i is None and t.endswith("v59")]) == 1
    assert [x for x in got if x[0] is not None] == sorted([(3, NEAR), (7, THIRD), (8, ""), (11, None)], key=str)
    assert len(got) == 5


def test_no_rows(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], NAMES), "").collect() == []


def test_columns_of_the_same_names(spark):
    rows = [(i, t, "en", "s", len(t), f"row{i}", f"doc{i}") for i, t in enumerate([WORDS, NEAR, OTHER])]
    docs = spark.createDataFrame(rows, NAMES + ", row string, doc string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_numbers_of_rows(spark, tmp_path):
    """Every read of a table finds the same numbers, all different, over several files and with clashing names."""
    rows = [(i % 7, f"t{i}", i, "mine", "file") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, row long, _metadata string, file string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.numbered(docs, Scratch(spark))
    first = {r["row"]: tuple(r["doc"]) for r in out.collect()}
    assert sorted(first.values()) == sorted(rows) and len(first) == 100
    assert {r["row"]: r["text"] for r in out.select("row", "doc.text").repartition(3).collect()} == {k: v[1] for k, v in first.items()}
    # a table that is no Parquet table as read is written first
    again = corpus_pipeline.numbered(docs.union(docs), Scratch(spark))
    assert again.select("row").distinct().count() == again.count() == 200
