"""NaN, nulls and names with dots and backticks: every analysis and chain gives what it gives on the same table with nulls
for NaN and plain names."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog
from plumbline.operators.profile import column_profile, index_columns, quality_issues, shape, strongest_correlations, top_values, value_summary
from plumbline.plans import templates
from plumbline.plans.templates import TEMPLATES, facts

ODD = {"k": "k.1", "x": "a.b", "y": "y`z", "z": "z.`.z", "g": "g.", "h": "`h`", "two": "t.w.o", "f": "f.x"}


@pytest.fixture(scope="module")
def tables(spark):
    rnd = np.random.default_rng(5)
    n = 240
    pdf = pd.DataFrame({"k": np.arange(n), "x": rnd.exponential(10, n) + 1, "y": rnd.normal(50, 3, n) ** 2, "z": rnd.integers(1, 30, n).astype(float), "g": rnd.choice(list("abcd"), n), "h": rnd.choice(["u", "v", "w"], n), "two": rnd.choice(["p", "q"], n), "f": rnd.normal(5, 1, n) + 3})
    pdf.loc[::17, "x"] = None
    pdf.loc[::23, "z"] = None
    kind = "k long, x double, y double, z double, g string, h string, two string, f double"
    none = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    rows = [tuple(none(v) for v in r) for r in pdf.itertuples(index=False)]
    plain = spark.createDataFrame([(int(r[0]), *r[1:]) for r in rows], kind)
    nan = spark.createDataFrame([(int(r[0]), *(math.nan if v is None and (i + int(r[0])) % 3 else v for i, v in enumerate(r[1:]))) for r in rows], kind)
    return plain, nan.toDF(*ODD.values()), pdf


def told(df, names=()):
    """Rows as text, with names of the odd table told by those of the plain one."""

    def text(v):
        if isinstance(v, str):
            for short, odd in names:
                v = v.replace(odd, short)
            return ",".join(sorted(v.split(",")))
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return [sorted(tuple(map(text, r)) for r in df.collect()), [text(c) for c in df.columns]]


NAMES = sorted(ODD.items(), key=lambda x: -len(x[1]))


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_analysis(tables, name):
    plain, odd, _ = tables
    want = told(TEMPLATES[name](plain))
    assert told(TEMPLATES[name](odd), NAMES) == want
    assert want[1] != ["error"] or name in ("correlation_change_analysis",)


CHAINS = [
    [("select_numeric_cols", {}), ("pick_numeric_by_variance", {}), ("median", {})],
    [("select_numeric_cols", {}), ("pick_numeric_by_skew", {}), ("mean", {})],
    [("select_numeric_cols", {}), ("bind_numeric_col", {"column": "x"}), ("shapiro_p", {})],
    [("select_numeric_cols", {}), ("bind_numeric_col", {"column": "x"}), ("zscore", {}), ("max_series", {})],
    [("select_numeric_cols", {}), ("select_categorical_cols", {}), ("pick_categorical_by_cardinality", {}), ("bind_numeric_col", {"column": "z"}), ("groupby_median", {}), ("argmax_group_median", {})],
    [("select_numeric_cols", {}), ("bind_num_col_1", {"column": "x"}), ("bind_num_col_2", {"column": "y"}), ("correlation", {})],
    [("select_numeric_cols", {}), ("bind_numeric_col", {"column": "x"}), ("bin_into_quartiles", {})],
    [("select_numeric_cols", {}), ("bind_numeric_col", {"column": "x"}), ("percentile_rank", {})],
    [("select_numeric_cols", {}), ("bind_numeric_col", {"column": "x"}), ("cumulative_sum", {})],
]


@pytest.mark.parametrize("i", range(len(CHAINS)))
def test_chains(tables, i):
    plain, odd, _ = tables
    renamed = [(n, {k: ODD.get(v, v) for k, v in p.items()}) for n, p in CHAINS[i]]
    assert told(catalog.run(odd, renamed, ("k.1",)), NAMES) == told(catalog.run(plain, CHAINS[i], ("k",)))


def test_profiles(tables):
    plain, odd, _ = tables
    for f in (column_profile, index_columns, shape, top_values, lambda d: value_summary(d, [d.columns[0]] if "." not in d.columns[0] else ["`k.1`"]).select("n_rows")):
        assert told(f(odd), NAMES) == told(f(plain))
    assert strongest_correlations(odd).count() > 0 and quality_issues(odd).count() >= 0


def test_against_pandas(tables):
    _, odd, pdf = tables
    y = pdf.y  # of the largest variance
    q1, q3 = y.quantile(0.25), y.quantile(0.75)
    r = TEMPLATES["iqr_outlier_analysis"](odd).first()
    assert r.column == "y`z" and r.n_outliers == ((y < q1 - 1.5 * (q3 - q1)) | (y > q3 + 1.5 * (q3 - q1))).sum() and r.q1 == round(q1, 3)
    s = TEMPLATES["descriptive_summary"](odd, strategy="max_missing").first()
    x = pdf.x
    assert s.column == "a.b" and s["count"] == x.count() and np.allclose([s["mean"], s["std"], s["max"], s["median"], s["skewness"], s["kurtosis"]], np.round([x.mean(), x.std(), x.max(), x.median(), x.skew(), x.kurt()], 3), atol=1.1e-3)
    ranks = TEMPLATES["spearman_rank_correlation"](odd).first()
    rho = pdf[["x", "y", "z", "f"]].corr("spearman").abs().where(np.triu(np.ones((4, 4)), 1) > 0).stack()
    assert abs(abs(ranks.association_score) - rho.max()) < 1e-3
    p = {r.column: r for r in column_profile(odd).collect()}["a.b"]
    assert (p.missing_count, p.unique_count, p["median"]) == (x.isna().sum(), x.nunique(), round(x.median(), 3))


def test_nan_is_no_outlier(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(95)] + [(math.nan, 2.0)] * 5, "v double, w double")
    assert TEMPLATES["iqr_outlier_analysis"](df).first().n_outliers == 0
    assert TEMPLATES["strongest_correlation"](df).first() is not None


def test_facts_ask_only_what_is_read(tables, spark):
    plain, _, pdf = tables
    f = facts(plain.select("*"))
    assert "texts" not in f.__dict__ and f.n == 240 and "texts" not in f.__dict__
    assert {c: f.distinct(c) for c in ("g", "h", "two", "z", "x")} == {c: pdf[c].nunique() for c in ("g", "h", "two", "z", "x")}
    big = facts(spark.range(5000).selectExpr("id", "cast(id as string) as s", "id * 2 as w", "id % 4900 as v"))
    assert big.distinct("s") == 5000 and big.distinct("v") == 4900 and not big.between("s", 2, 20)


@pytest.mark.parametrize("limit", [0, 35, 420, 10**6])
def test_ranks_of_few_and_of_many_values_correlate_alike(spark, monkeypatch, limit):
    monkeypatch.setattr(templates, "BROADCAST_VALUES", limit)
    rnd = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rnd.integers(0, 6, 500), "b": rnd.integers(0, 30, 500), "c": rnd.normal(0, 1, 500), "d": rnd.exponential(3, 500)}).astype(float)
    pdf["c"] += pdf["b"] / 9
    for i, c in enumerate("abc"):
        pdf.loc[rnd.random(500) < 0.1 * (i + 1), c] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double")
    pairs = templates.spearman_pairs(df, list("abcd"))
    got = {(r.a, r.b): (r.n, r.rho) for r in pairs.collect()}
    assert len(got) == 6
    for (a, b), (n, rho) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both) and rho == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-9)
    # with one column of many values at most, nothing goes back to the rows
    assert ("monotonically_increasing_id" in pairs._jdf.queryExecution().optimizedPlan().toString()) == (limit < 420)
    still = templates.spearman_pairs(df.withColumn("d", F.when(F.col("a").isNotNull(), 1.0)), list("ad")).first()
    assert (still.n, still.rho) == (int(pdf.a.notna().sum()), None)
