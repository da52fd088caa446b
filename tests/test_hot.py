"""Joins with hot keys equal plain ones."""

import pytest
from pyspark.sql import functions as F

from verdigris.plans import hot
from verdigris.plans.components import components
from verdigris.plans.scratch import Scratch


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("small", [1000, 0])
def test_join_unique(spark, monkeypatch, how, small):
    monkeypatch.setattr(hot, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(None if i % 11 == 0 else 1 if i % 2 else i % 7, i) for i in range(500)], "k int, v int")
    lookup = Scratch(spark).keep(rows.where("k is not null and k <> 4").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")))
    got = hot.join_unique(rows, lookup, ["k"], "n", how, small)
    want = rows.join(lookup.drop("n"), ["k"], how)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_components_with_a_hub(spark, monkeypatch):
    from verdigris.plans import components as module

    monkeypatch.setattr(module, "FEW", 0)
    monkeypatch.setattr(hot, "HOT_KEYS", 2)
    monkeypatch.setattr(hot, "SMALL", 0)
    edges = [(500, i) for i in range(400)] + [(i, i + 1) for i in range(1000, 1010)] + [(399, 1010)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in [*range(400), 500, *range(1000, 1011)]}
