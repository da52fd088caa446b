"""Token counts by separator scan over flat, unindexed token streams.

A stream is the ids of documents one after another, each closed by the end-of-document id, cut into blocks of fixed
size wherever they fall.  Each block is scanned alone: a vectorised comparison finds its separators, which give its
head (ids up to the first), its closed documents and its tail (ids after the last).  A prefix scan over the blocks of a
stream then stitches the boundaries: it carries, from block to block, the ids since the last separator and the number of
documents closed so far.

Blocks hold unsigned little-endian ids of 32 bits.  A stream that doesn't end with a separator closes with an open
document, told by closed = false.  An empty block, and a null one, holds nothing.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm import tokens

BLOCK_TOKENS = 1 << 16


def token_streams(docs: DataFrame, path: str | None = None, end: int = 50256, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs: doc_id, text.  Writes every partition as one stream: rows of stream, block, ids (binary).  Rows with
    block = -1 - n are the sidecar: doc_ids are those of the stream's documents from number n * SIDE on."""
    path = path or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream, block, side, names, rest = TaskContext.get().partitionId(), 0, 0, [], np.empty(0, np.uint32)

        def row(no: int, ids: bytes | None, doc_ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([stream], pa.int64()), pa.array([no], pa.int64()), pa.array([ids], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64()))], ["stream", "block", "ids", "doc_ids"])

        held, n = [rest], 0
        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"], strict=True):
                x = np.append(tokens.ids(path, text.as_py()), np.uint32(end))
                names.append(name.as_py())
                held.append(x)
                n += len(x)
                if n >= block_tokens:
                    flat = np.concatenate(held)
                    while len(flat) >= block_tokens:
                        yield row(block, flat[:block_tokens].astype("<u4").tobytes(), None)
                        flat, block = flat[block_tokens:], block + 1
                    held, n = [flat], len(flat)
                if len(names) == SIDE:
                    yield row(-1 - side, None, names)
                    names, side = [], side + 1
        if n:
            yield row(block, np.concatenate(held).astype("<u4").tobytes(), None)
        if names:
            yield row(-1 - side, None, names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "stream bigint, block bigint, ids binary, doc_ids array<bigint>")


#: Documents of one row of the sidecar.
SIDE = 1024


def scan_blocks(blocks: DataFrame, end: int = 50256) -> DataFrame:
    """blocks: stream, block, ids.  Of each block: n (ids), n_ends, head, tail and closed, the sizes of the documents
    that lie wholly within it after its first separator.  A separator isn't counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for x in batch["ids"]:
                ids = np.frombuffer(x.as_buffer() if x.is_valid else b"", "<u4")
                at = np.flatnonzero(ids == end)
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (0, len(ids))
                for column, v in zip(rows, (len(ids), len(at), head, tail, np.diff(at) - 1), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch["stream"], batch["block"], *(pa.array(r, pa.int64()) for r in rows[:4]), pa.array(rows[4], pa.list_(pa.int64()))], ["stream", "block", "n", "n_ends", "head", "tail", "inner"])

    fields = [blocks.schema["stream"], blocks.schema["block"], *(T.StructField(k, T.LongType()) for k in ("n", "n_ends", "head", "tail")), T.StructField("inner", T.ArrayType(T.LongType()))]
    return blocks.select("stream", "block", "ids").mapInArrow(run, T.StructType(fields))


def count_documents(blocks: DataFrame, end: int = 50256) -> DataFrame:
    """blocks: stream, block, ids.  Returns stream, number (of the document in its stream, from 0), n_tokens, closed."""
    s = scan_blocks(blocks, end)
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # ids so far, at the latest separator and now: their difference is what is open when a block begins
    s = s.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("number", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    s = s.withColumn("closed_at", F.when(F.col("n_ends") > 0, F.col("n_before") + F.col("n") - F.col("tail")))
    s = s.withColumn("open", F.col("n_before") - F.coalesce(F.max("closed_at").over(before), F.lit(0)))
    last = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("block"))) == 1
    s = s.withColumn("left", F.when(last, F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("n"))).otherwise(F.lit(0)))
    one = lambda n, closed: F.struct(n.cast("bigint").alias("n_tokens"), F.lit(closed).alias("closed"))
    ended = F.when(F.col("n_ends") > 0, F.concat(F.array(one(F.col("open") + F.col("head"), True)), F.transform("inner", lambda n: one(n, True)))).otherwise(F.array().cast("array<struct<n_tokens:bigint,closed:boolean>>"))
    rest = F.when(F.col("left") > 0, F.array(one(F.col("left"), False))).otherwise(F.array().cast("array<struct<n_tokens:bigint,closed:boolean>>"))
    out = s.select("stream", "number", F.posexplode(F.concat(ended, rest)).alias("i", "doc"))
    return out.select("stream", (F.col("number") + F.col("i")).alias("number"), "doc.n_tokens", "doc.closed")


def count_tokens(docs: DataFrame, **options) -> DataFrame:
    """docs: doc_id, text.  Writes the documents as flat streams in the shared folder, scans these, and returns doc_id and
    n_tokens (without the separator)."""
    from verdigris.plans.scratch import Scratch

    table = Scratch(docs.sparkSession).keep(token_streams(docs, **options), "streams")
    counts = count_documents(table.where("block >= 0").select("stream", "block", "ids"), options.get("end", 50256))
    side = table.where("block < 0").select("stream", F.posexplode("doc_ids").alias("i", "doc_id"), "block").select(F.col("stream").alias("of"), ((-1 - F.col("block")) * SIDE + F.col("i")).alias("at"), "doc_id")
    return counts.join(side, (F.col("stream") == F.col("of")) & (F.col("number") == F.col("at"))).select("doc_id", "n_tokens")
