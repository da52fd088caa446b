"""The corpus pipeline: from raw documents to packed sequences, a stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from verdigris.plans.scratch import Scratch, bounded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    return quality_rules.keep_documents(docs, "v1")


def _placed(docs: DataFrame) -> DataFrame | None:
    """(file, at, doc) of a table as it was read from Parquet; None of any other."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return None
    # the columns of docs stand apart, whatever they are called
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(place.getField("file_path").alias("file"), place.getField("row_index").alias("at"), whole)
    except AnalysisException:
        return None


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc): every row of docs, as a struct, under a number of its own that each read finds again: its file's number
    (below 2^23) and its place in the file (below 2^40).  The table is not copied, unless docs is no Parquet table as
    read.  The window has one row for each file."""
    placed = _placed(docs)
    if placed is None:
        placed = _placed(scratch.keep(docs, "documents"))
    files = scratch.keep(placed.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).alias("no")), "files")
    if bounded(files, jaccard_join.BROADCAST_ROWS):
        files = F.broadcast(files)
    return placed.join(files, "file").select((F.shiftleft(F.col("no").cast("bigint"), 40) + F.col("at")).alias("row"), "doc")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8), one row: the one with the least id, or any of them where that id's
    row is repeated or the group has null ids only.  Groups are of rows, each under a number of its own, so that null ids
    and repeated ids tell no rows apart or together; a row without words is a group of its own."""
    scratch = Scratch(spark)
    rows = numbered(docs, scratch)
    groups = jaccard_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "doc.text"), k=5, percent=80)
    named = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc.doc_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = scratch.keep(named.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti"), "gone")
    return rows.join(F.broadcast(gone) if bounded(gone, jaccard_join.BROADCAST_ROWS) else gone, "row", "left_anti").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by the name of its kind; n_chars, where docs have it, is told anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = secret_scan.Scanner()
        for batch in batches:
            texts = [t and secret_scan.redact(t, scan(t)) for t in batch["text"].to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources as documents."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.0, most=3.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]
#: Byte-pair encoding and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
