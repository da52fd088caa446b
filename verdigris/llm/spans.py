"""Spans found in texts: (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def find_spans(docs: DataFrame, finder: Callable[[], Callable[[str], Sequence[tuple[str, int, int, float]]]], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds spans, an array of (kind, start, end, score), to the columns `keep` of docs.  finder() is called once in
    each task and gives the function that reads one whole text; a null text is an empty one."""
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in find(t.as_py() or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*keep, "spans"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("spans", FOUND)]))


def told(spans: str, kinds: Sequence[str], by_start: bool) -> Column:
    """Spans of the given kinds as 'kind:start:end', comma-joined, ordered by kind as listed, then
    start, or by start first."""
    order = F.array(*map(F.lit, kinds))

    def item(s: Column) -> Column:
        place = [s["start"], F.array_position(order, s["kind"])]
        return F.struct(*(place if by_start else place[::-1]), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("said"))

    mine = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(F.array_sort(F.transform(mine, item)), lambda s: s["said"]), ",")



def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
