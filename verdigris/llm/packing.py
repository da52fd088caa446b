"""Best-fit packing, bound-certified.

Documents are tokenised and cut into pieces of at most `capacity` tokens.  Full pieces are sequences of their own; the
others are dealt by hash to partitions of about PART pieces, each of which is packed best-fit decreasing.  A lower
bound from dual feasible functions tells whether a partition's count is certainly least.  Partitions with a gap
exchange documents: the pieces of their looser sequences are dealt anew, among each other, and packed again; the new
packing of a pool is taken where it needs fewer sequences.  Full and certified sequences stay as they are.

A null text is an empty one: its only token is the separator.  Strings of the tokenizer file's added tokens in a text
are these tokens, as by the `tokenizers` library's defaults.  Repeated rows are packed as often as they come.  An
empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm import tokens
from verdigris.plans.scratch import Scratch

#: Pieces of a partition.
PART = 10_000
#: Rounds of exchange.
ROUNDS = 2


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Least number of bins that the dual feasible functions allow: of Martello and Toth (sizes above c - k become c,
    those below k nothing) for every k up to c / 2, and of Fekete and Schepers (x -> floor((d + 1) x / c) / d, x itself
    where (d + 1) x / c is whole) for d up to 20."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    n_up, weight_up = np.cumsum(count), np.cumsum(count * x)
    k = np.arange(0, capacity // 2 + 1)
    big = n_up[-1] - n_up[capacity - k]
    middle = weight_up[capacity - k] - np.where(k > 0, weight_up[np.maximum(k - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for d in range(1, 21):
        y = (d + 1) * x
        # in units of 1 / (c d)
        f = np.where(y % capacity == 0, x * d, y // capacity * capacity)
        best = max(best, int(-(-(f * count).sum() // (capacity * d))))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, best-fit decreasing.  Bins stand by their room; a bit mask of the rooms that there
    are finds the least that is enough."""
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    where, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = bins = 0
    for i in order:
        s = size[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        left = room - s
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return where, offset


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, piece, start, length, ids_crc32, and ids if asked for.  Only a document
    that is longer is cut; its first piece may be shorter than the others."""
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch["doc_id"], [[] for _ in range(6)]
            for i, text in enumerate(batch["text"]):
                x = np.append(tokens.ids(path, text.as_py(), added=True), np.uint32(0))
                head = len(x) % capacity or capacity
                at = 0
                for p, end in enumerate(range(head, len(x) + 1, capacity)):
                    raw = x[at:end].astype("<u4").tobytes()
                    for column, v in zip(rows, (i, p, at, end - at, zlib.crc32(raw), raw if with_ids else None), strict=True):
                        column.append(v)
                    at = end
                if len(rows[0]) >= 20_000 or with_ids and len(rows[0]) >= 1000:
                    yield _batch(names, rows, with_ids)
                    rows = [[] for _ in range(6)]
            yield _batch(names, rows, with_ids)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


def _batch(names: pa.Array, rows: list[list], with_ids: bool) -> pa.RecordBatch:
    columns = [names.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
    return pa.RecordBatch.from_arrays([*columns, *([pa.array(rows[5], pa.binary())] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])


def _pack(capacity: int):
    """Packs a partition; tells its lower bound, and which sequences are loose: all but the full ones, where the count
    is above the bound."""

    def run(part: pa.Table) -> pa.Table:
        sizes = part["length"].to_numpy()
        where, offset = best_fit(sizes, capacity)
        n = int(where.max()) + 1
        filled = np.bincount(where, weights=sizes, minlength=n)
        bound = lower_bound(sizes, capacity)
        loose = (filled < capacity) & (n > bound)
        out = part.select([c for c in part.column_names if c not in ("bin", "offset", "loose", "bins")])
        for name, x in (("bin", where), ("offset", offset), ("loose", loose[where]), ("bins", np.full(len(sizes), n))):
            out = out.append_column(name, pa.array(x))
        return out

    return run


def _names(table: DataFrame, round_no: int) -> DataFrame:
    """Numbers the sequences apart from those of other partitions and rounds."""
    return table.withColumn("sequence_id", ((F.lit(round_no).cast("bigint") * (1 << 40) + F.col("part")) * (1 << 20)) + F.col("bin"))


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids, little-
    endian unsigned 32-bit, if asked for)."""
    scratch = Scratch(docs.sparkSession)
    p = scratch.keep(pieces(docs, capacity, path or tokens.vocabulary(), with_ids), "pieces")
    columns = p.columns
    # a row's name: pieces of repeated rows are dealt evenly too
    p = p.withColumn("row", F.monotonically_increasing_id())
    whole = p.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    open_ = p.where(F.col("length") < capacity)
    done = [whole]
    carried = T.StructType([*open_.schema.fields, T.StructField("part", T.LongType())])
    packed_schema = T.StructType([*carried.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("loose", T.BooleanType()), T.StructField("bins", T.LongType())])

    def deal(table: DataFrame, round_no: int) -> DataFrame:
        parts = max(1, -(-table.count() // PART))
        dealt = table.withColumn("part", F.pmod(F.xxhash64(F.lit(round_no), "row"), F.lit(parts)).cast("bigint"))
        return scratch.keep(_names(dealt.groupBy("part").applyInArrow(_pack(capacity), packed_schema), round_no), f"round{round_no}")

    now = deal(open_.select(*open_.columns), 0)
    for round_no in range(1, ROUNDS + 1):
        loose = now.where("loose")
        n = loose.count()
        if n == 0 or now.where("loose").select("part").distinct().limit(2).count() < 2:
            break
        before = loose.select("sequence_id").distinct().count()
        again = deal(loose.select(*carried.names[:-1]), round_no)
        after = again.select("sequence_id").distinct().count()
        if after >= before:
            break
        done.append(now.where("not loose").select(*columns, "sequence_id", "offset"))
        now = again
    out = now.select(*columns, "sequence_id", "offset")
    for t in done:
        out = out.unionByName(t)
    return out
