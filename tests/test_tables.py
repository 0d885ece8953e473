import random

import pandas as pd
import pytest

from plumbline.functions import ordered
from plumbline.records.tables import tables_match

NAN = float("nan")


def one(spark, a, kind_a, b, kind_b, tolerance=0.1):
    return tables_match(spark.createDataFrame(a, kind_a), spark.createDataFrame(b, kind_b), tolerance).first()


CASES = [
    ([(1, 3), (2, 4)], "a int, b int", [(4, 2), (3, 1)], "b int, a int", "match"),
    ([(1.0,), (2.0,)], "a double", [(1.95,), (1.05,)], "a double", "match"),
    ([(1.0,), (2.0,)], "a double", [(1.5,), (2.0,)], "a double", "other values"),
    ([(1,), (2,)], "a int", [(2.0,), (1.0,)], "a double", "match"),
    ([(1,), (1,), (2,)], "a int", [(1,), (2,), (2,)], "a int", "other values"),
    ([(1,)], "a int", [(1,), (1,)], "a int", "other number of rows"),
    ([(1,)], "a int", [(1,)], "b int", "other columns"),
    ([], "a int, b string", [], "b string, a int", "match"),
    ([(None, "x"), (NAN, "y")], "a double, b string", [(NAN, "x"), (None, "y")], "a double, b string", "match"),
    ([(None,)], "a double", [(0.0,)], "a double", "other values"),
    ([("x", [1])], "s string, `a.b` array<int>", [("x", [1])], "s string, `a.b` array<int>", "match"),
    ([("1",)], "a string", [(1,)], "a int", "match"),
    ([(True,)], "a boolean", [(1,)], "a int", "match"),
    ([(float("inf"),)], "a double", [(1e300,)], "a double", "other values"),
    ([(float("inf"),)], "a double", [(float("inf"),)], "a double", "match"),
    ([(100.0,)], "a double", [(109.0,)], "a double", "match"),  # relative, too
]


@pytest.mark.parametrize("a,kind_a,b,kind_b,reason", CASES)
def test_small_tables(spark, a, kind_a, b, kind_b, reason):
    r = one(spark, a, kind_a, b, kind_b)
    assert (r.matched, r.reason) == (reason == "match", reason)


def test_as_pandas_compares_sorted_tables(spark):
    rng = random.Random(7)
    for trial in range(6):
        rows = [(rng.randrange(4), rng.choice("xyz"), round(rng.random() * 3, 2)) for _ in range(300)]
        near = [(a, b, c + rng.choice([0, 0, 0.04, 0.3 if trial % 2 else 0.02])) for a, b, c in rows]
        rng.shuffle(near)
        x, y = (pd.DataFrame(r, columns=["k", "s", "v"]).sort_values(["k", "s", "v"]).reset_index(drop=True) for r in (rows, near))
        bad = (x.k != y.k) | (x.s != y.s) | ((x.v - y.v).abs() > 0.05 + 0.05 * y.v.abs())
        r = one(spark, rows, "k int, s string, v double", near, "k int, s string, v double", 0.05)
        assert (r.matched, r.different_rows, r.rows_a) == (not bad.any(), bad.sum(), 300)
        assert r.different_columns == (["v"] if bad.any() else [])


def test_equal_rows_are_spread_and_no_place_is_missing(spark):
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as s", "id")
    out = ordered.positioned(df.select("s"), ["s"])
    assert out.selectExpr("count(distinct _idx)", "min(_idx)", "max(_idx)").first()[:] == (100_000, 0, 99_999)
    s = [r.s for r in out.orderBy("_idx").collect()]
    assert s == sorted(s)
