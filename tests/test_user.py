import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from plumbline.operators import user

KINDS = "k string, n int, x double, `a.b` double"
LOG = user.Aggregate("double", lambda: (0, 0.0), lambda s, c: (s[0] + len(c["x"]) - c["x"].null_count, s[1] + float(np.log(c["x"].drop_null().to_numpy()).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: math.exp(s[1] / s[0]) if s[0] else None)
SHAPE = user.Aggregate("struct<n: bigint, low: double, seen: array<string>>", lambda: [0, math.inf, set()], lambda s, c: [s[0] + len(c["a.b"]), min([s[1], *c["a.b"].drop_null().to_pylist()]), s[2] | set(c["k"].drop_null().to_pylist())], lambda a, b: [a[0] + b[0], min(a[1], b[1]), a[2] | b[2]], lambda s: {"n": s[0], "low": s[1], "seen": sorted(s[2])})


def table(spark):
    rows = [("a", i % 3, float(i % 7 + 1), float(i)) for i in range(500)] + [(None, 1, 2.0, 1.0), ("b", 0, None, None), ("b", 0, 4.0, float("nan"))]
    return spark.createDataFrame(rows, KINDS), rows


def test_aggregate_equals_plain_python(spark):
    df, rows = table(spark)
    for held in (0, 50_000):
        got = {(r.k, r.n): r for r in user.aggregate(df, ["k", "n"], ["x"], LOG, "g", held).collect()}
        assert got.keys() == {(r[0], r[1]) for r in rows}
        for (k, n), r in got.items():
            own = [x for kk, nn, x, _ in rows if (kk, nn) == (k, n) and x is not None]
            assert r.error is None and math.isclose(r.g, math.exp(sum(map(math.log, own)) / len(own)))
    whole = user.aggregate(df, [], ["a.b", "k"], SHAPE).first()
    assert whole.result.n == 503 and whole.result.low == 0.0 and whole.result.seen == ["a", "b"]
    assert user.aggregate(df.limit(0), ["k"], ["x"], LOG).count() == 0


def test_errors_stay_with_their_group(spark):
    df, _ = table(spark)
    bad = user.Aggregate("double", lambda: 0.0, lambda s, c: s + sum(x for x in c["x"].to_pylist()), lambda a, b: a + b, lambda s: s)
    got = {r.k: r for r in user.aggregate(df, ["k"], ["x"], bad).collect()}
    assert got["b"].result is None and got["b"].error.startswith("TypeError") and got["a"].result > 0 and got["a"].error is None
    wrong = user.Aggregate("double", lambda: 0, lambda s, c: s, lambda a, b: a, lambda s: "text")
    assert all(r.result is None and "Arrow" in r.error for r in user.aggregate(df, ["k"], ["x"], wrong).collect())


def test_a_group_larger_than_a_batch_is_never_held(spark):
    """Three million rows of one group: every call sees one batch, and the state is two numbers."""
    df = spark.range(3_000_000).selectExpr("'hot' as k", "cast(id % 10 + 1 as double) as x")
    widest = user.Aggregate("struct<n: bigint, most: bigint>", lambda: (0, 0), lambda s, c: (s[0] + len(c["x"]), max(s[1], len(c["x"]))), lambda a, b: (a[0] + b[0], max(a[1], b[1])), lambda s: {"n": s[0], "most": s[1]})
    r = user.aggregate(df, ["k"], ["x"], widest).first()
    assert r.result.n == 3_000_000 and r.result.most <= 10_000


def test_registered_names(spark):
    user.register_aggregate("geometric", LOG)
    df, _ = table(spark)
    assert user.aggregate(df, ["k"], ["x"], "geometric").count() == 3
    with pytest.raises(KeyError):
        user.aggregate(df, ["k"], ["x"], "import os")


def _spread(batches, report):
    low, high, n = math.inf, -math.inf, 0
    for b in batches:
        x = b.column("x").drop_null()
        if len(x):
            low, high, n = min(low, pc.min(x).as_py()), max(high, pc.max(x).as_py()), n + len(x)
    report.hook(np.int64(n), "n = count(x)", "n")
    report.hook([low, high], "low, high = range(x)", "range", ["n"], "both ends")
    report.submit({"n": n, "spread": high - low})


def test_function_over_groups(spark):
    df, rows = table(spark)
    user.register_function("spread", "struct<n: bigint, spread: double>", _spread)
    got = {r.k: r for r in user.run_groups(df, ["k"], ["x"], "spread").collect()}
    assert got["a"].answer.spread == 6.0 and got["a"].n_rows == 500 and got["b"].answer.n == 1
    assert [(h.place, h.name, h.value, h.depends_on, h.description) for h in got["a"].hooks] == [(0, "n", "500", [], None), (1, "range", "[1.0, 7.0]", ["n"], "both ends")]
    assert len(got["a"].hooks[0].value_hash) == 16 and got[None].error is None
    assert user.run_groups(df.limit(0), ["k"], ["x"], "spread").count() == 0


def test_functions_that_fail_or_stop_early(spark):
    df, _ = table(spark)

    def early(batches, report):
        report.hook(next(batches).num_rows > 0, "first batch", "some")
        if pa.__version__ == "":
            report.submit(1)

    r = {x.k: x for x in user.run_groups(df, ["k"], ["x", "n"], ("int", early), ["n", "x"]).collect()}
    assert {k: (x.n_rows, x.answer, x.error, len(x.hooks)) for k, x in r.items()} == {k: (n, None, "no answer was submitted", 1) for k, n in (("a", 500), ("b", 2), (None, 1))}

    def twice(batches, report):
        report.submit(1)
        report.submit(2)

    assert {x.error for x in user.run_groups(df, ["k"], ["x"], ("int", twice)).collect()} == {"ValueError: an answer was submitted before"}
    ordered = user.run_groups(df, [], ["a.b"], ("array<double>", lambda bs, rep: rep.submit([x for b in bs for x in b.column("a.b").to_pylist()][:4])), ["a.b"]).first()
    assert ordered.answer == [None, 0.0, 1.0, 1.0] and ordered.n_rows == 503
    text = user.run_groups(df, ["k"], ["x"], ("int", lambda bs, rep: rep.submit("no number"))).where(F.col("error").isNull())
    assert text.count() == 0
