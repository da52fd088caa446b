"""Running sums equal those of one pass."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from verdigris.plans import running, scratch


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_before(spark, n):
    rng = random.Random(n)
    rows = [(i if i else None, rng.choice([None, 1, 2, 30]), rng.random() < 0.3) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, x long, other boolean").repartition(5)
    out = running.before(df, [F.col("k").asc_nulls_last()], ["x"], scratch.Scratch(spark))
    assert out.columns == ["k", "x", "other", "before_x"]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sums = [0, *itertools.accumulate(r[1] or 0 for r in ordered)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((*r, s) for r, s in zip(ordered, sums)), key=str)


def test_no_shared_folder(spark):
    class Elsewhere:
        class sparkContext:
            master = "spark://there:7077"
            getConf = staticmethod(dict)

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="shares"):
        scratch.shared_folder(Elsewhere)
    assert scratch.shared_folder(spark)
