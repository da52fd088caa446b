import pytest

from verdigris.operators import tree

#: A chain, an owner that is not in the table, a cycle and a way into it, an element that owns itself.
ROWS = [(1, None), (2, 1), (3, 2), (5, 99), (6, 5), (7, 8), (8, 7), (9, 8), (10, 10)]


def _paths(rows, most):
    up, out = dict(rows), []
    for r in up:
        path = [r]
        while up.get(path[-1]) is not None and up[path[-1]] not in path:
            path.append(up[path[-1]])
        out += [(r, a, d) for d, a in enumerate(path) if most is None or d <= most]
    return sorted(out)


@pytest.mark.parametrize("most", [None, 0, 1, 2])
@pytest.mark.parametrize("rows", [ROWS, ROWS[1:], ROWS[:3], []])
def test_closure(spark, rows, most):
    df = spark.createDataFrame(rows, "refno bigint, owner bigint")
    assert sorted(tuple(r) for r in tree.closure(df, most).collect()) == _paths(rows, most)
