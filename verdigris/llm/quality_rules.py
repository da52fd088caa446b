"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each whole text; the ledger keeps the measurements and one bit for each rule that a
text fails.  A policy is a version with a mask of rules: it keeps a text if no failed rule is in its mask.  So new
policies, and the ablation of one rule or another, read the ledger alone.

A null text is an empty one: no words, so `few_words` fails.  Rows are returned as they come, repeated ones too; other
columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.byte_text import measures
from verdigris.llm.jaccard_join import steps

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules by bit: name and failing condition over the measurements, given as m(name).
RULES = (
    ("few_words", lambda m: m("n_words") < 50),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("symbols", lambda m: 100 * m("n_symbols") > 30 * m("n_words")),
    ("long_words", lambda m: m("word_chars") > 40 * m("n_words")),
    ("duplicate_lines", lambda m: 10 * m("n_dup_lines") > m("n_words")),
)
#: Before the names of measurements, so that they don't meet a table's own columns.
_PREFIX = "__measure_"
#: Policies by version: names of the rules that reject.
POLICIES = {"base": ("few_words", "repeated_words"), "v1": ("few_words", "repeated_words", "symbols"), "v2": tuple(name for name, _ in RULES)}


def mask(policy: str) -> int:
    return sum(1 << bit for bit, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in steps(batch["text"]):
            part = batch.slice(lo, hi - lo)
            m = measures(part["text"])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m[k], pa.int64()) for k in MEASURES)], [*part.schema.names, *(_PREFIX + k for k in MEASURES)])


def _with_measures(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_measured, T.StructType([*docs.schema.fields, *(T.StructField(_PREFIX + k, T.LongType()) for k in MEASURES)]))


def _failed() -> Column:
    bits = [F.when(test(lambda k: F.col(_PREFIX + k)), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, test) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, the measurements and failed, the bits of the rules it fails."""
    m = _with_measures(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return m.select("doc_id", *(F.col(_PREFIX + k).alias(k) for k in MEASURES), _failed().alias("failed"))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds kept: no failed rule is in the policy's mask."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of the policy: texts that fail it, texts that only it rejects, texts kept without it."""
    whole = mask(policy)
    used = [(bit, name) for bit, (name, _) in enumerate(RULES) if whole >> bit & 1]
    failed = F.col("failed").bitwiseAND(F.lit(whole).cast("bigint"))
    counts = rows.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    sums = []
    for bit, name in used:
        one = F.lit(1 << bit).cast("bigint")
        fails, alone = F.col("bits").bitwiseAND(one) != 0, F.col("bits") == one
        pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        sums.append(counts.agg(F.lit(name).alias("rule"), pick(fails).alias("n_fail"), pick(alone).alias("n_only"), pick(alone | (F.col("bits") == 0)).alias("n_kept_without")))
    out = sums[0]
    for s in sums[1:]:
        out = out.union(s)
    return out


def keep_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their columns and rows as they are."""
    passed = _failed().bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0
    return _with_measures(docs).where(passed).select(*docs.columns)
