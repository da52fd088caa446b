"""Media columns in Spark: texts as transport streams, and the index of a stream's units."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm import transport_stream as ts

#: Streams of one Arrow batch: about so many bytes, or a single one.
BATCH_BYTES = 4 << 20
UNIT = T.StructType([*(T.StructField(k, T.LongType()) for k in ("pts", "pcr", "bytes")), T.StructField("random_access", T.BooleanType()), T.StructField("whole", T.BooleanType())])


def text_streams(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, n_bytes and media, the stored transport stream of the text's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = ([], [], []), 0
            for i, text in enumerate(batch["text"]):
                n, payload = ts.text_payload(text.as_py())
                media = ts.write_stream(payload)
                for column, v in zip(rows, (i, n, media), strict=True):
                    column.append(v)
                size += len(media)
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["doc_id", "n_bytes", "media"])
                    rows, size = ([], [], []), 0

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def read_streams(media: DataFrame) -> DataFrame:
    """media: doc_id, n_bytes, media.  Parses each stream and returns, of what was read back, payload_bytes,
    payload_sha256, tail_crc32 (last 64 bytes), the stored form's media_bytes and media_sha256, feature, and units: time
    stamp, clock, size, random access point and wholeness of each elementary packet.  A null stream has no payload."""
    unit = pa.struct([("pts", pa.int64()), ("pcr", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_())])
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(unit)]
    sql = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.ArrayType(UNIT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for x in batch["media"]:
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                s = ts.read_stream(data)
                units = [{"pts": u.pts, "pcr": u.pcr, "bytes": u.size, "random_access": u.random_access, "whole": u.whole} for u in s.units]
                found = (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), ts.feature(s), units)
                for column, v in zip(rows, found, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    fields = [media.schema["doc_id"], media.schema["n_bytes"], *(T.StructField(n, k) for n, k in zip(names, sql, strict=True))]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, T.StructType(fields))
