import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ordered, tails
from plumbline.operators import catalog
from plumbline.plans import programs
from plumbline.plans.templates import TEMPLATES, applicable, pick, pick_category


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 16)
    rnd = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.arange(200), "x": rnd.integers(0, 40, 200).astype(float)})
    pdf.loc[::13, "x"] = np.nan
    return spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))), pdf


def test_ordered_operations_match_pandas(small):
    df, pdf = small
    n = ordered.numbered(df, "k")
    got = ordered.running_sum(n, F.col("x"), "s").orderBy("k").toPandas().s
    assert np.allclose(got, pdf.x.cumsum(), equal_nan=True)
    got = ordered.trailing(n, 5, lambda w: F.avg("x").over(w), "r").orderBy("k").toPandas()
    assert len(got) == 200
    assert np.allclose(got.r, pdf.x.rolling(5, min_periods=1).mean(), equal_nan=True)
    out = catalog.run(df.withColumnRenamed("x", "v"), [("select_numeric_cols", {}), ("bind_numeric_col", {"column": "v"}), ("percentile_rank", {})], ("k",)).orderBy("k").toPandas()
    assert np.allclose(out.v_percentile, pdf.x.rank(pct=True).round(6), equal_nan=True)


def test_tails_match_known_values():
    assert math.isclose(tails.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.chi2_sf(3.841458821, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.f_sf(4.964602744, 1, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.normal_two_sided(1.959963985), 0.05, rel_tol=1e-6)


def test_shapiro_tells_normal_from_skewed():
    q = [tails.normal_quantile((i + 0.5) / 200) for i in range(200)]
    assert tails.shapiro_wilk(q)[1] > 0.5
    assert tails.shapiro_wilk([math.exp(v) for v in q])[1] < 1e-6


def test_shapiro_looks_at_all_rows(spark):
    values = [float(min(i % 50, i % 7 + 20)) for i in range(12000)]
    for x in (values, values[:40], [3.0, 1.0, 2.5], [1.0, 2.0, 2.0, 9.0], [4.0] * 9, [None, 1.0]):
        r = catalog.shapiro_frame(spark.createDataFrame([(v,) for v in x], "v double"), "v").first()
        want = tails.shapiro_wilk([v for v in x if v is not None])
        assert (r.w, r.p) == (None, None) if want[0] is None else np.allclose((r.w, r.p), want, rtol=1e-6, atol=1e-12)
    some = [r.v for r in catalog.sampled(spark.createDataFrame([(v,) for v in [1.0] * 90000 + [2.0] * 30000], "v double"), "v").collect()]
    assert len(some) == 5000 and abs(some.count(2.0) - 1250) < 150


def test_bootstrap_draws_a_thousand_resamples(spark):
    rnd = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rnd.exponential(10, 3000), "y": rnd.normal(5, 1, 3000)})
    r = TEMPLATES["bootstrap_ci_discovered"](spark.createDataFrame(pdf)).first()
    assert (r.column, r.n_iterations, r["mean"], r.skewness) == ("x", 1000, round(pdf.x.mean(), 2), round(pdf.x.skew(), 2))
    assert r.ci_lower < pdf.x.mean() < r.ci_upper
    assert abs(r.std_error / (pdf.x.std() / 3000**0.5) - 1) < 0.1


def test_quantiles_and_tied_orders(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 20)
    rnd = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": np.arange(900), "v": np.where(rnd.random(900) < 0.7, 5.0, rnd.integers(0, 30, 900)), "g": rnd.integers(0, 3, 900).astype(str)})
    pdf.loc[::11, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(ordered.quantiles(df, "v", shares).first().q, pdf.v.quantile(shares))
    for r in ordered.quantiles(df, "v", shares, "g").collect():
        assert np.allclose(r.q, pdf[pdf.g == r.g].v.quantile(shares))
    assert ordered.quantiles(df.where("false"), "v", [0.5]).first().q is None
    got = ordered.numbered(df, "v", "k").orderBy("_idx").toPandas()
    want = pdf.sort_values(["v", "k"], na_position="first")
    assert got._idx.tolist() == list(range(900)) and got.k.tolist() == want.k.tolist()
    assert ordered.bucketed(df, "k").select("_bucket").distinct().count() > 20


def test_outlier_rounds_one_by_one(spark):
    rnd = np.random.default_rng(9)
    x = np.concatenate([rnd.normal(10, 3, 400), rnd.normal(60, 5, 12), [400.0, 2000.0]])
    r = TEMPLATES["iterative_outlier_removal"](spark.createDataFrame(pd.DataFrame({"x": x}))).first()
    data, before, used = x, x.mean(), 0
    for i in range(10):
        keep = np.abs(data - data.mean()) <= 3 * data.std(ddof=1)
        used = i + 1
        if keep.all():
            break
        data = data[keep]
        if abs(data.mean() - before) < 0.001:
            break
        before = data.mean()
    assert (r.iterations_used, r.total_removed, r.final_mean) == (used, len(x) - len(data), round(data.mean(), 2))


def test_regression_on_three_predictors(spark):
    rnd = np.random.default_rng(10)
    a = rnd.normal(0, 1, (500, 4))
    pdf = pd.DataFrame(a, columns=["a", "b", "c", "d"])
    pdf["y"] = 30 * pdf.a + 10 * pdf.b + 3 * pdf.c + rnd.normal(0, 5, 500)
    r = TEMPLATES["multiple_regression_top_predictors"](spark.createDataFrame(pdf)).first()
    assert (r.target, r.predictors) == ("y", "a,b,c")
    m = np.column_stack([np.ones(500), pdf[["a", "b", "c"]]])
    left = pdf.y - m @ np.linalg.lstsq(m, pdf.y, rcond=None)[0]
    assert abs(r.fit_score - (1 - (left**2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())) < 1e-3 and r.n_influential == 3


def test_every_analysis_on_tables_without_its_columns(spark):
    tables = [
        spark.createDataFrame([], "a double, b double, c string, d string"),
        spark.createDataFrame([(None, None, None, None)] * 3, "a double, b double, c string, d string"),
        spark.createDataFrame([("x",), ("y",)], "c string"),
        spark.createDataFrame([(1.0, "x")] * 20, "a double, c string"),
    ]
    for df in tables:
        for name, f in TEMPLATES.items():
            rows = f(df).collect()
            assert len(rows) <= 3, name
    assert TEMPLATES["max_variance_mean"](tables[0]).columns == ["error"]
    assert applicable(tables[0]).count() == 0


def test_two_groups_are_found_in_numbers_or_made(spark):
    rnd = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rnd.normal(0, 9, 200), "y": rnd.normal(0, 1, 200)})
    assert TEMPLATES["ttest_discovered_groups"](spark.createDataFrame(pdf)).first().grouping_column == "_binary_group"
    pdf["z"] = (pdf.x > 1).astype(float)
    r = TEMPLATES["ttest_discovered_groups"](spark.createDataFrame(pdf)).first()
    assert r.grouping_column == "z" and abs(r.mean2 - pdf[pdf.z == 1].x.mean()) < 0.01


def test_picks(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 50], "b": [100.0, 101, 102, None, 104], "c": list("xxyyz"), "d": list("ppppq")})
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double")))
    assert [pick(df, s) for s in ("max_variance", "max_cv", "max_skew", "min_skew", "max_missing", "min_missing")] == ["a", "a", "a", "b", "b", "a"]
    assert [pick_category(df, s, 3) for s in ("moderate", "high", "low")] == ["c", "c", "d"]
    with pytest.raises(ValueError):
        pick(df, "best")


def test_searched_programs_are_typed_and_live():
    found = list(programs.search(6, 3000))
    assert found
    for chain in found[:200]:
        assert programs.well_typed(chain) and programs.live(chain) and set(programs.reduced(chain)) <= set(chain)
    assert len(catalog.CATALOG) == 55


def test_binding_rejects_unknown_columns(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, g string")
    with pytest.raises(ValueError):
        catalog.run(df, [("select_numeric_cols", {}), ("bind_numeric_col", {"column": "nope"})])


def test_few_groups_and_few_values_of_many_rows_end_in_no_single_task(spark, monkeypatch):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("group"), (F.col("id") % 7).cast("double").alias("value"))
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 50)
    monkeypatch.setattr(ordered, "_cuts", lambda *_: pytest.fail("quantiles of seven values"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        levene = catalog.levene_frame(df)
        plan = levene._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        values = {g: [r.value for r in df.where(F.col("group") == g).collect()] for g in "ab"}
        far = {g: np.abs(np.array(v) - np.median(v)) for g, v in values.items()}
        whole = np.concatenate(list(far.values()))
        between = sum(len(x) * (x.mean() - whole.mean()) ** 2 for x in far.values())
        within = sum(((x - x.mean()) ** 2).sum() for x in far.values())
        assert levene.first().w == pytest.approx(between / (within / (len(whole) - 2)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(catalog, "RANKS", 10)
    blocks = catalog.dealt(df.groupBy("value").agg(F.count("*").alias("k")).select("value", F.explode(F.sequence(F.lit(1).cast("long"), "k", F.lit(10).cast("long"))).alias("i")), "value", "i")
    parts = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < 250
    assert len(catalog.sampled(df, "value", 100).inputFiles()) > 0
