"""Named multi-step analyses. Each takes a table, finds its columns by one row of statistics, and returns one row
(or a short table) as a lazy plan. Groups sort by name; ties go to the first column in the table's order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce, wraps
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered, tails
from ..functions.names import entered
from ..functions.stats import corr
from ..operators.catalog import ID_NAME, NUMERIC, adjusted_skew, anova_frame, group_medians, levene_frame, mwu_frame, r3, sampled, shapiro_frame, ttest_frame
from ..scratch import kept
from ..shipping import ship

TEMPLATES: dict[str, Callable[..., DataFrame]] = {}


class NotApplicable(ValueError):
    """A table without the columns that an analysis needs."""


def template(f):
    """Register f. NaN is missing, columns may have any names. On a table without the columns it needs, an empty one too, the result is one row with why in `error`."""

    @wraps(f)
    def run(df: DataFrame, **params) -> DataFrame:
        ship(df.sparkSession)
        rows, shown = entered(df)
        try:
            return shown(f(rows, **params))
        except NotApplicable as e:
            return df.sparkSession.createDataFrame([(str(e),)], "error string")

    TEMPLATES[f.__name__] = run
    return run


class Facts:
    """What choices of columns look at, asked for when a choice needs it and once a table: n and the statistics of numeric
    columns (count, mean, std, var, min, max, skew) from one aggregate, how many values columns have from sketches, and exact
    numbers of values only for columns whose sketch leaves the choice open."""

    #: Up to so many values (by the sketch) an exact number comes from the set of them.
    FEW = 200

    def __init__(self, df: DataFrame):
        self.df = df
        kinds = {c: t for c, t in df.dtypes if not ID_NAME.match(c)}
        self.kinds = {c: t for c, t in kinds.items() if t in NUMERIC or t == "string"}
        self.exact: dict[str, int] = {}

    def _row(self, cells: dict[str, dict[str, Column]], more: tuple[Column, ...] = ()) -> tuple[dict, dict[str, dict]]:
        place = {c: i for i, c in enumerate(cells)}
        row = self.df.agg(*more, *(v.alias(f"{k}_{place[c]}") for c, stats in cells.items() for k, v in stats.items())).first() if cells or more else {}
        return row, {c: {k: row[f"{k}_{place[c]}"] for k in stats} for c, stats in cells.items()}

    @cached_property
    def _numbers(self) -> tuple[int, dict[str, dict]]:
        cells = {}
        for c, t in self.kinds.items():
            if t in NUMERIC:
                x = F.col(c).cast("double")
                cells[c] = {"count": F.count(c), "mean": F.avg(x), "std": F.stddev_samp(x), "var": F.var_samp(x), "min": F.min(x), "max": F.max(x), "skew": adjusted_skew(c)}
                if t not in ("float", "double"):
                    cells[c]["sketch"] = F.approx_count_distinct(c)
        row, out = self._row(cells, (F.count("*").alias("n"),))
        return row["n"], {c: f | {"kind": self.kinds[c]} for c, f in out.items()}

    @property
    def n(self) -> int:
        return self._numbers[0]

    @property
    def numbers(self) -> dict[str, dict]:
        return self._numbers[1]

    @cached_property
    def texts(self) -> dict[str, int]:
        """Text columns with their numbers of values by sketch."""
        return {c: f["sketch"] for c, f in self._row({c: {"sketch": F.approx_count_distinct(c)} for c, t in self.kinds.items() if t == "string"})[1].items()}

    @cached_property
    def sketches(self) -> dict[str, int]:
        """The same of all columns; those of floating numbers are asked for here alone."""
        floats = self._row({c: {"sketch": F.approx_count_distinct(c)} for c, t in self.kinds.items() if t in ("float", "double")})[1]
        return self.texts | {c: f["sketch"] for c, f in self.numbers.items() if "sketch" in f} | {c: f["sketch"] for c, f in floats.items()}

    def distinct(self, c: str) -> int:
        """The exact number of values of c; columns of few values are counted together, in one aggregate."""
        if c not in self.exact:
            known = self.texts if self.kinds[c] == "string" else self.sketches
            few = [x for x, sketch in known.items() if sketch <= self.FEW]
            if c in few:
                self.exact |= {x: f["d"] for x, f in self._row({x: {"d": F.size(F.collect_set(x)).cast("long")} for x in few})[1].items()}
            else:
                self.exact[c] = self.df.select(c).where(F.col(c).isNotNull()).distinct().count()
        return self.exact[c]

    def between(self, c: str, low: int, high: int) -> bool:
        """Whether c has from low to high values, high being small: a sketch far above settles it."""
        known = self.texts if self.kinds[c] == "string" else self.sketches
        return known[c] <= 2 * high + 20 and low <= self.distinct(c) <= high


def facts(df: DataFrame) -> Facts:
    """The facts of a table, which it remembers."""
    if not hasattr(df, "_plumbline_facts"):
        df._plumbline_facts = Facts(df)
    return df._plumbline_facts


def analysis_columns(df: DataFrame) -> list[str]:
    """Numeric columns, in the table's order, that don't name or identify rows, aren't constant or almost empty.

    Nearly unique whole numbers identify rows; nearly unique measurements do not.
    """
    f = facts(df)
    limit = max(2, int(0.98 * f.n))

    def ok(c: str, x: dict) -> bool:
        if not x["count"] > 0.05 * f.n or x["min"] == x["max"]:
            return False
        return "sketch" not in x or x["sketch"] < 0.8 * limit or f.distinct(c) < limit

    return [c for c, x in f.numbers.items() if ok(c, x)]


def text_columns_between(df: DataFrame, low: int, high: int) -> list[str]:
    """Text columns with so many values, in the table's order."""
    return [c for c in facts(df).texts if facts(df).between(c, low, high)]


def text_column(df: DataFrame, low: int, high: int, skip: int = 0) -> str:
    """The first (or a later) text column with so many values."""
    found = text_columns_between(df, low, high)
    if len(found) <= skip:
        raise NotApplicable(f"no {'further ' * bool(skip)}text column with {low} to {high} values")
    return found[skip]


# What columns are ranked by.
VARIANCE, MEAN, DEVIATION = (lambda f: f["var"]), (lambda f: f["mean"]), (lambda f: f["std"])
CV = lambda f: f["std"] / abs(f["mean"]) if f["mean"] and f["std"] is not None else None
SKEW = lambda f: abs(f["skew"]) if f["skew"] is not None and f["skew"] == f["skew"] else None
RANGE = lambda f: f["max"] - f["min"] if f["max"] is not None else None


def ranked(df: DataFrame, stat: Callable[[dict], float | None], largest: bool = True, columns: list[str] | None = None, without: tuple[str, ...] = ()) -> list[str]:
    """Columns by a statistic, best first, ties in the order of the table; columns without it are left out."""
    of = facts(df).numbers
    known = [(stat(of[c]), c) for c in (columns if columns is not None else analysis_columns(df)) if c not in without]
    known = [(v, c) for v, c in known if v is not None]
    if not known:
        raise NotApplicable("no numeric column with the statistic")
    return [c for _, c in sorted(known, key=lambda x: -x[0] if largest else x[0])]


def pick(df: DataFrame, strategy: str = "max_variance", without: tuple[str, ...] = ()) -> str:
    """The numeric column of a strategy: max_variance, max_std, max_cv, max_skew, min_skew, max_missing or min_missing."""
    n = facts(df).n
    missing = lambda f: n - f["count"]
    stat = {"variance": VARIANCE, "std": DEVIATION, "cv": CV, "skew": SKEW, "missing": missing}
    way, _, name = strategy.partition("_")
    if way not in ("max", "min") or name not in stat:
        raise ValueError(f"unknown strategy {strategy}")
    return ranked(df, stat[name], way == "max", without=without)[0]


def pick_category(df: DataFrame, strategy: str = "moderate", target: int = 10) -> str:
    """The text column with most values ('high'), fewest ('low') or about `target` ('moderate'), of two values or more and
    under 0.8 of the rows; ties in the order of the table."""
    f = facts(df)
    sizes = {c: f.distinct(c) for c, sketch in f.texts.items() if sketch < f.n}
    sizes = {c: d for c, d in sizes.items() if 2 <= d < 0.8 * f.n}
    if not sizes:
        raise NotApplicable("no text column with few values")
    score = {"moderate": lambda c: abs(sizes[c] - target), "high": lambda c: -sizes[c], "low": lambda c: sizes[c]}[strategy]
    return min(sizes, key=score)


def top_variance(df: DataFrame) -> str:
    return ranked(df, VARIANCE)[0]


def pairs_by_correlation(df: DataFrame, largest: bool = True, columns: list[str] | None = None) -> list[tuple[str, str]]:
    pairs = list(combinations(analysis_columns(df) if columns is None else columns, 2))
    if not pairs:
        raise NotApplicable("fewer than two numeric columns")
    row = df.agg(*[F.abs(corr(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    known = [i for i in range(len(pairs)) if row[i] is not None and row[i] == row[i]]
    if not known:
        raise NotApplicable("no defined correlation")
    return [pairs[i] for i in sorted(known, key=lambda i: (-row[i] if largest else row[i], i))]


def predictors(df: DataFrame, y: str) -> list[str]:
    """The other numeric columns by correlation with y."""
    found = [a if b == y else b for a, b in pairs_by_correlation(df) if y in (a, b)]
    if not found:
        raise NotApplicable("no predictor")
    return found


def named(a: str, b: str) -> Column:
    return F.lit(",".join(sorted((a, b)))).alias("columns")


def groups_of(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(F.col(by).alias("group"), F.col(value).cast("double").alias("value"))


@template
def max_variance_mean(df: DataFrame, strategy: str = "max_variance", without_top: bool = False) -> DataFrame:
    """Mean of the column that varies most; by another strategy, or once the column of the largest variance is left out."""
    c = pick(df, strategy, without=(top_variance(df),) if without_top else ())
    return df.agg(r3(F.avg(c)).alias("answer"))


@template
def max_cv_mean(df: DataFrame) -> DataFrame:
    return df.agg(r3(F.avg(pick(df, "max_cv"))).alias("answer"))


@template
def min_mean_column_std(df: DataFrame, leave_out: str = "") -> DataFrame:
    """Deviation of the column with the least mean; leave_out 'top_variance' or 'first' drops that column before."""
    without = {"": (), "top_variance": (top_variance(df),), "first": tuple(analysis_columns(df)[:1])}[leave_out]
    return df.agg(r3(F.stddev_samp(ranked(df, MEAN, False, without=without)[0])).alias("answer"))


def _correlation(name: str, largest: bool):
    def f(df: DataFrame, without_top: bool = False) -> DataFrame:
        columns = [c for c in analysis_columns(df) if not (without_top and c == top_variance(df))]
        a, b = pairs_by_correlation(df, largest, columns)[0]
        return df.agg(named(a, b), F.round(F.abs(corr(a, b)), 2).alias("association_score"))

    f.__name__ = name
    return template(f)


_correlation("strongest_correlation", True)
_correlation("weakest_correlation", False)


@template
def conditional_normality(df: DataFrame) -> DataFrame:
    """A row for each column of the largest variance: mean and std if normal, else median and iqr; the other two are null."""
    best = facts(df).numbers[top_variance(df)]["var"]
    out = []
    for c in (c for c in analysis_columns(df) if facts(df).numbers[c]["var"] == best):
        whole = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).crossJoin(ordered.quantiles(df, c, [0.25, 0.5, 0.75])).crossJoin(shapiro_frame(sampled(df, c), c))  # one row each
        normal = F.coalesce(F.col("p") > 0.05, F.lit(False))
        when = lambda ok, x: F.when(ok, r3(x))
        out.append(whole.select(F.lit(c).alias("column"), F.when(normal, "normal").otherwise("non-normal").alias("distribution"), when(normal, F.col("m")).alias("mean"), when(normal, F.col("s")).alias("std"), when(~normal, F.col("q")[1]).alias("median"), when(~normal, F.col("q")[2] - F.col("q")[0]).alias("iqr")))
    return reduce(DataFrame.unionAll, out)


@template
def count_high_missing_columns(df: DataFrame, threshold: float = 5.0) -> DataFrame:
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in df.columns])
    listed = F.array_sort(F.filter(F.array(*[F.when(F.col(c) > threshold, F.lit(c)) for c in df.columns]), lambda x: x.isNotNull()))
    return one.select(F.size(listed).cast("long").alias("count"), F.array_join(listed, ",").alias("columns"))


@template
def duplicate_rows_summary(df: DataFrame) -> DataFrame:
    per = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    t = per.agg(F.sum(F.col("n") - 1).alias("d"), F.sum("n").alias("n"))
    return t.select(F.col("d").alias("duplicate_rows"), F.round(F.col("d") * 100 / F.col("n"), 2).alias("duplicate_pct"))


@template
def identifier_like_columns(df: DataFrame) -> DataFrame:
    one = df.agg(F.count("*").alias("_n"), *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns])
    listed = F.array_sort(F.filter(F.array(*[F.when(F.col(c) >= 0.98 * F.col("_n"), F.lit(c)) for c in df.columns]), lambda x: x.isNotNull()))
    return one.select(F.size(listed).cast("long").alias("count"), F.array_join(listed, ",").alias("columns"))


@template
def count_outlier_columns(df: DataFrame, z: float = 3.0, rule: str = "beyond") -> DataFrame:
    """Values far from their column's mean by z deviations: 'beyond', 'reaching' (>=), 'population' (deviation of the whole), or
    'quartiles' (outside 1.5 interquartile ranges)."""
    cols = analysis_columns(df)
    if not cols:
        raise NotApplicable("no numeric column")
    if rule == "quartiles":
        cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols))
        long = df.select(F.explode(cells).alias("x")).select("x.*")
        q = ordered.quantiles(long, "v", [0.25, 0.75], "column")
        iqr = F.col("q")[1] - F.col("q")[0]
        far = F.count_if((F.col("v") < F.col("q")[0] - 1.5 * iqr) | (F.col("v") > F.col("q")[1] + 1.5 * iqr))
        per = long.join(F.broadcast(q), "column").groupBy("column").agg(far.alias("k"))  # a row a column
        return per.agg(F.count_if(F.col("k") > 0).alias("columns_with_outliers"), F.sum("k").alias("total_outliers"))
    spread = F.stddev_pop if rule == "population" else F.stddev_samp
    stats = df.agg(*[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", spread))])
    off = lambda c: F.abs(F.col(c) - F.col(f"m_{c}"))
    out = lambda c: off(c) >= z * F.col(f"s_{c}") if rule == "reaching" else off(c) > z * F.col(f"s_{c}")
    far = df.crossJoin(F.broadcast(stats)).agg(*[F.count_if((F.col(f"s_{c}") > 0) & out(c)).alias(c) for c in cols])
    return far.select(reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("long") for c in cols]).alias("columns_with_outliers"), reduce(lambda a, b: a + b, [F.col(c) for c in cols]).alias("total_outliers"))


@template
def category_highest_target_mean(df: DataFrame) -> DataFrame:
    by, c = text_column(df, 2, 20), top_variance(df)
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(c).alias("m"))
    return g.orderBy(F.desc_nulls_last("m"), by).limit(1).select(F.lit(by).alias("category_column"), F.col(by).alias("best_category"), F.lit(c).alias("target_column"), r3(F.col("m")).alias("mean_value"))


@template
def correlation_after_outlier_removal(df: DataFrame) -> DataFrame:
    a, b = pairs_by_correlation(df)[0]
    stats = df.agg(F.avg(a).alias("ma"), F.stddev_samp(a).alias("sa"), F.avg(b).alias("mb"), F.stddev_samp(b).alias("sb"))
    near = F.coalesce((F.abs(F.col(a) - F.col("ma")) <= 3 * F.col("sa")) & (F.abs(F.col(b) - F.col("mb")) <= 3 * F.col("sb")), F.lit(False))
    return df.crossJoin(F.broadcast(stats)).agg(named(a, b), r3(corr(a, b)).alias("original_association"), F.count_if(~near).alias("outliers_removed"), r3(corr(F.when(near, F.col(a)), F.when(near, F.col(b)))).alias("clean_association"))


@template
def regression_most_predictive(df: DataFrame, strategy: str = "max_variance") -> DataFrame:
    y = pick(df, strategy)
    x = predictors(df, y)[0]
    t = df.agg(F.abs(corr(x, y)).alias("r"), F.regr_r2(F.col(y), F.col(x)).alias("r2"), F.regr_slope(F.col(y), F.col(x)).alias("b"), F.regr_count(F.col(y), F.col(x)).alias("n"))
    p = F.udf(tails.t_two_sided, "double")(F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r2"))), F.col("n") - 2)
    return t.select(F.lit(y).alias("target"), F.lit(x).alias("best_predictor"), r3(F.col("r")).alias("association_score"), r3(F.col("r2")).alias("fit_score"), r3(F.col("b")).alias("coefficient"), F.round(p, 4).alias("significance_score"))


def with_two_groups(df: DataFrame, target: str, alphabetical: bool = True) -> tuple[DataFrame, str]:
    """df and a column of two values in it: a text column (the first by name, or in the table's order), else a numeric one
    other than target, else `_binary_group`, low or high by the target's median."""
    f = facts(df)
    names = text_columns_between(df, 2, 2)
    names = sorted(names) if alphabetical else names
    numbers = [] if names else [c for c, x in f.numbers.items() if c != target and x["min"] != x["max"] and f.between(c, 2, 2)]
    if names or numbers:
        return df, (names or numbers)[0]
    middle = ordered.quantiles(df, target, [0.5]).select(F.col("q")[0].alias("_middle"))
    return df.crossJoin(F.broadcast(middle)).withColumn("_binary_group", F.when(F.col(target) > F.col("_middle"), "high").when(F.col(target).isNotNull(), "low")).drop("_middle"), "_binary_group"  # one row of median


def two_groups(per: DataFrame, name: str) -> DataFrame:
    """per(group, v) of two groups as one row."""
    return per.agg(F.min("group").alias("group1"), F.max("group").alias("group2"), r3(F.min_by("v", "group")).alias(f"{name}1"), r3(F.max_by("v", "group")).alias(f"{name}2"))


@template
def ttest_discovered_groups(df: DataFrame, strategy: str = "max_variance", alphabetical: bool = True) -> DataFrame:
    c = pick(df, strategy)
    df, by = with_two_groups(df, c, alphabetical)
    g = groups_of(df, by, c)
    t = ttest_frame(g).withColumn("p", F.udf(tails.t_two_sided, "double")("t", "df"))
    return t.crossJoin(two_groups(g.groupBy("group").agg(F.avg("value").alias("v")), "mean")).select(F.lit(c).alias("target_column"), F.lit(by).alias("grouping_column"), "group1", "group2", "mean1", "mean2", r3(F.col("t")).alias("test_statistic"), F.round("p", 4).alias("significance_score"), (F.col("p") < 0.05).alias("significant"))


def _resampled(resamples: int):
    """Different values with their frequency and a seed -> a task's weighted sum and weight of each resample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            x, k, seed = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "k", "seed"))
            for i in range(len(x)):
                w = np.random.Generator(np.random.Philox(key=int(seed[i]) & (1 << 64) - 1)).poisson(k[i], resamples)
                sums += w * x[i]
                weights += w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(sums), pa.array(weights)], names=["b", "sum", "weight"])

    return run


@template
def bootstrap_ci_discovered(df: DataFrame, resamples: int = 1000) -> DataFrame:
    """Poisson bootstrap: every row gets a Poisson(1) weight a resample, so the k rows of a value get a Poisson(k) one, drawn
    out of the value's hash. A task adds up its weighted sums, one a resample, and only these are shuffled; how rows are
    partitioned does not matter."""
    c = ranked(df, SKEW)[0]
    values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("x")).agg(F.count("*").alias("k"), F.xxhash64(F.col(c).cast("double")).alias("seed"))
    each = values.mapInArrow(_resampled(resamples), "b int, sum double, weight double").groupBy("b").agg((F.sum("sum") / F.sum("weight")).alias("m"))
    whole = df.agg(F.round(F.abs(adjusted_skew(c)), 2).alias("skewness"), F.round(F.avg(c), 2).alias("mean"))
    ends = each.agg(F.percentile("m", 0.025).alias("ci_lower"), F.percentile("m", 0.975).alias("ci_upper"), F.stddev_pop("m").alias("std_error"), F.count("*").alias("n_iterations"))
    return whole.crossJoin(ends).select(F.lit(c).alias("column"), "skewness", "mean", "ci_lower", "ci_upper", "std_error", "n_iterations")  # one row each


@template
def anova_discovered_groups(df: DataFrame) -> DataFrame:
    by, c = text_column(df, 3, 10), top_variance(df)
    g = groups_of(df, by, c)
    per = g.groupBy("group").agg(F.avg("value").alias("m"), F.count("*").alias("n")).where("n >= 10")
    ends = per.agg(F.count("*").alias("n_groups"), F.max_by("group", "m").alias("best_group"), r3(F.max("m")).alias("best_mean"), F.min_by("group", "m").alias("worst_group"), r3(F.min("m")).alias("worst_mean"))
    t = anova_frame(g.join(per.select("group"), "group", "left_semi")).withColumn("p", F.udf(tails.f_sf, "double")("f", "d1", "d2"))
    return t.crossJoin(ends).select(F.lit(c).alias("target_column"), F.lit(by).alias("grouping_column"), "n_groups", r3(F.col("f")).alias("test_statistic"), F.round("p", 4).alias("significance_score"), (F.col("p") < 0.05).alias("significant"), "best_group", "best_mean", "worst_group", "worst_mean", F.round("eta", 4).alias("effect_size"))


@template
def multiple_regression_top_predictors(df: DataFrame) -> DataFrame:
    """Least squares on the three most correlated predictors, from the sums of products of one pass."""
    y = top_variance(df)
    xs = predictors(df, y)[:3]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    cols = [*xs, y]
    row = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]).first()
    n, k = row["n"], len(xs)
    cov = np.array([[row[f"c{i}_{j}"] for j in range(k + 1)] for i in range(k + 1)])
    beta = np.linalg.solve(cov[:k, :k], cov[:k, k])
    r2 = float(beta @ cov[:k, k] / cov[k, k])
    s2 = n * cov[k, k] * (1 - r2) / (n - k - 1)
    t = beta / np.sqrt(s2 * np.diag(np.linalg.inv(cov[:k, :k])) / n)
    tested = [tails.t_two_sided(float(v), n - k - 1) for v in t]
    good = sum(v is not None and v < 0.05 for v in tested)
    out = [(y, ",".join(xs), round(r2, 3), round(1 - (1 - r2) * (n - 1) / (n - k - 1), 3), good)]
    return df.sparkSession.createDataFrame(out, "target string, predictors string, fit_score double, fit_score_adj double, n_influential long")


@template
def chi_squared_independence(df: DataFrame) -> DataFrame:
    a, b = text_column(df, 2, 10), text_column(df, 2, 10, 1)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("na")), cells.groupBy("b").agg(F.sum("o").alias("nb"))
    n = cells.agg(F.sum("o").alias("n"))
    grid = ra.crossJoin(rb).crossJoin(n).join(cells, ["a", "b"], "left").withColumn("e", F.col("na") * F.col("nb") / F.col("n")).withColumn("o", F.coalesce("o", F.lit(0)))  # at most 10 x 10 cells
    dof = (F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)
    t = grid.agg(dof.alias("df"), F.min("e").alias("expected_min"), F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("plain"), F.sum(F.greatest(F.abs(F.col("o") - F.col("e")) - 0.5, F.lit(0.0)) ** 2 / F.col("e")).alias("yates"))
    x = F.when(F.col("df") == 1, F.col("yates")).otherwise(F.col("plain"))
    p = F.udf(tails.chi2_sf, "double")("x", "df")
    return t.withColumn("x", x).withColumn("p", p).select(F.lit(a).alias("column1"), F.lit(b).alias("column2"), r3(F.col("x")).alias("test_statistic"), F.round("p", 4).alias("significance_score"), F.col("df").cast("long").alias("df"), r3(F.col("expected_min")).alias("expected_min"), (F.col("p") >= 0.05).alias("independent"))


@template
def mann_whitney_u_test(df: DataFrame) -> DataFrame:
    c = ranked(df, SKEW)[0]
    df, by = with_two_groups(df, c)
    g = groups_of(df, by, c)
    t = mwu_frame(g).withColumn("p", F.udf(tails.normal_two_sided, "double")("z"))
    return t.crossJoin(two_groups(group_medians(g).withColumnRenamed("med", "v"), "median")).select(F.lit(c).alias("target_column"), F.lit(by).alias("grouping_column"), "group1", "group2", "median1", "median2", r3(F.col("u")).alias("test_statistic"), F.round("p", 4).alias("significance_score"))


#: Values of a column whose ranks are broadcast to the rows.
BROADCAST_VALUES = 20_000


def _partner_ranks(counts: DataFrame, columns: list[str], cuts: list) -> DataFrame:
    """counts(c, v, n0, n1, ...) -> also off, an array: the value's rank among the rows that have the partner, less their mean rank."""
    m = range(len(columns))
    counts = ordered.bucketed(counts, "v", cuts)
    totals = counts.groupBy("c", "_bucket").agg(*(F.sum(f"n{j}").alias(f"t{j}") for j in m))
    before, whole = Window.partitionBy("c").orderBy("_bucket"), Window.partitionBy("c")  # a row a bucket
    carry = totals.select("c", "_bucket", *((F.sum(f"t{j}").over(before) - F.col(f"t{j}")).alias(f"b{j}") for j in m), *(F.sum(f"t{j}").over(whole).alias(f"a{j}") for j in m))
    inside = Window.partitionBy("c", "_bucket").orderBy("v")
    off = lambda j: F.col(f"b{j}") + F.sum(f"n{j}").over(inside) - F.col(f"n{j}") + (F.col(f"n{j}") - F.col(f"a{j}")) / 2
    return counts.join(F.broadcast(carry), ["c", "_bucket"]).withColumn("off", F.array(*map(off, m))).drop("_bucket", *(f"{x}{j}" for x in "ab" for j in m))


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, rho) of every pair of columns over the rows where both are present. Each (column, value) is ranked once, with a
    rank among the rows that have the partner for every partner. Ranks of columns with few values are broadcast to the rows;
    a value of the others gathers the sums of its partners' ranks as it is counted, so that rows with those do not travel
    back. Only if several columns have many values, these go back to the rows by their number, in one more shuffle each way.
    Both tables of ranks are written once to the shared folder."""
    m = range(len(columns))
    sizes = df.agg(*(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns))).first()
    few = [i for i in m if sizes[f"d{i}"] <= BROADCAST_VALUES]
    many = [i for i in m if i not in few]
    have = F.array(*(F.col(c).isNotNull().cast("long") for c in columns))
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    rows = df.select(*([F.monotonically_increasing_id().alias("row")] if len(many) > 1 else []), have.alias("have"), *values)

    def long(rows: DataFrame, which: list[int], *more: str) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in which))
        return rows.select(*more, F.inline(cells)).where("v is not null")

    present = [F.sum(F.col("have")[j]).alias(f"n{j}") for j in m]
    small = kept(_partner_ranks(long(rows, few, "have").groupBy("c", "v").agg(*present), columns, []), "ranks") if few else None
    for i in few:
        rows = rows.join(F.broadcast(small.where(F.col("c") == i).select(F.col("v").alias(f"v{i}"), F.col("off").alias(f"r{i}"))), f"v{i}", "left")
    # a pair's sums: rows, products and squares of both sides' ranks less the mean
    at = lambda i, j: F.col(f"r{i}")[j]
    sums = []
    near = list(combinations(few, 2))
    if near:
        cell = lambda i, j: [F.count(at(i, j) * at(j, i)), F.sum(at(i, j) * at(j, i))]
        one = rows.agg(*(x.alias(f"{k}_{i}_{j}") for i, j in near for k, x in zip(("n", "xy"), cell(i, j), strict=True)))
        sums.append(one.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"n_{i}_{j}").alias("n"), F.col(f"xy_{i}_{j}").alias("xy")) for i, j in near)))))
    squares = lambda ranks: ranks.groupBy("c").agg(*(F.sum(F.col(f"n{j}") * F.col("off")[j] * F.col("off")[j]).alias(f"q{j}") for j in m))
    spreads = [squares(small)] if few else []
    if many:
        # rank of column j among the rows that have column c, summed over a value of c
        partner = lambda j: F.sum(F.element_at(F.col(f"r{j}"), F.col("c") + 1)).alias(f"s{j}")
        cells = long(rows, many, "have", *(f"r{j}" for j in few))
        counts = cells.groupBy("c", "v").agg(*present, *map(partner, few))
        large = kept(_partner_ranks(counts, columns, [cut for _, own in ordered._cuts(long(df.select(*values), many), F.col("v")) for cut in own]), "ranks")
        spreads.append(squares(large))
        if few:
            mixed = large.groupBy("c").agg(*(x for j in few for x in (F.sum(f"n{j}").alias(f"k{j}"), F.sum(F.col("off")[j] * F.col(f"s{j}")).alias(f"p{j}"))))
            sums.append(mixed.select(F.inline(F.array(*(F.struct(F.least("c", F.lit(j)).alias("i"), F.greatest("c", F.lit(j)).alias("j"), F.col(f"k{j}").alias("n"), F.col(f"p{j}").alias("xy")) for j in few)))))
        if len(many) > 1:
            back = long(rows, many, "row").join(large.select("c", "v", "off"), ["c", "v"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("c", "off"))).alias("of"))
            of = lambda i, j: F.try_element_at(F.col("of"), F.lit(i))[j]
            each = back.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (of(i, j) * of(j, i)).alias("xy")) for i, j in combinations(many, 2)))))
            sums.append(each.where("xy is not null").groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("xy").alias("xy")))
    spread = reduce(DataFrame.unionAll, spreads).select("c", F.array(*(f"q{j}" for j in m)).alias("q"))  # a row a column
    pairs = reduce(DataFrame.unionAll, sums).where("n > 0")  # a row a pair
    side = lambda c: F.broadcast(spread.select(F.col("c").alias(c), F.col("q").alias(f"q_{c}")))
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    rho = F.try_divide(F.col("xy"), F.sqrt(F.get("q_i", F.col("j"))) * F.sqrt(F.get("q_j", F.col("i"))))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    return both.select(name("i").alias("a"), name("j").alias("b"), F.col("n"), F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))


@template
def spearman_rank_correlation(df: DataFrame) -> DataFrame:
    columns = analysis_columns(df)
    if len(columns) < 2:
        raise NotApplicable("fewer than two numeric columns")
    every = spearman_pairs(df, columns)
    best = every.orderBy(F.abs("rho").desc(), "a", "b").limit(1)
    p = F.udf(tails.t_two_sided, "double")(F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("rho") ** 2)), F.col("n") - 2)
    size = F.abs("rho")
    return best.select(F.array_join(F.array_sort(F.array("a", "b")), ",").alias("columns"), r3(F.col("rho")).alias("association_score"), F.round(p, 4).alias("significance_score"), F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("negligible").alias("interpretation"))


@template
def coefficient_of_variation(df: DataFrame) -> DataFrame:
    c = ranked(df, CV)[0]
    share = F.stddev_samp(c) / F.nullif(F.abs(F.avg(c)), F.lit(0.0))
    return df.agg(F.lit(c).alias("column"), r3(share * 100).alias("cv"), r3(F.avg(c)).alias("mean"), r3(F.stddev_samp(c)).alias("std"))


def fences(df: DataFrame, c: str) -> DataFrame:
    q = ordered.quantiles(df, c, [0.25, 0.75]).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - 1.5 * iqr).alias("low"), (F.col("q3") + 1.5 * iqr).alias("high"))


@template
def iqr_outlier_analysis(df: DataFrame, strategy: str = "max_variance") -> DataFrame:
    c = pick(df, strategy)
    t = df.crossJoin(F.broadcast(fences(df, c))).groupBy("q1", "q3", "low", "high").agg(F.count_if((F.col(c) < F.col("low")) | (F.col(c) > F.col("high"))).alias("n_outliers"))
    return t.select(F.lit(c).alias("column"), r3(F.col("q1")).alias("q1"), r3(F.col("q3")).alias("q3"), r3(F.col("q3") - F.col("q1")).alias("iqr"), r3(F.col("low")).alias("lower_fence"), r3(F.col("high")).alias("upper_fence"), "n_outliers")


@template
def percentile_ranking(df: DataFrame) -> DataFrame:
    c = ranked(df, RANGE)[0]
    q = ordered.quantiles(df, c, [0.1, 0.25, 0.5, 0.75, 0.9])
    return q.select(F.lit(c).alias("column"), *[r3(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))])


@template
def descriptive_summary(df: DataFrame, strategy: str = "max_variance") -> DataFrame:
    c = pick(df, strategy)
    n = F.count(c)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    one = df.agg(F.lit(c).alias("column"), n.alias("count"), *[r3(f).alias(k) for k, f in (("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("min", F.min(c)), ("max", F.max(c)), ("skewness", adjusted_skew(c)), ("kurtosis", kurt))])
    middle = ordered.quantiles(df, c, [0.5]).select(r3(F.col("q")[0]).alias("median"))
    return one.crossJoin(middle)  # one row each


@template
def levene_variance_test(df: DataFrame) -> DataFrame:
    by, c = text_column(df, 2, 6), top_variance(df)
    g = groups_of(df, by, c)
    per = g.groupBy("group").agg(r3(F.var_samp("value")).alias("v")).agg(F.count("*").alias("n_groups"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "group", F.format_string("%.3f", "v")))), ",").alias("group_variances"))
    t = levene_frame(g).withColumn("p", F.udf(tails.f_sf, "double")("w", "d1", "d2"))
    return t.crossJoin(per).select(F.lit(c).alias("target_column"), F.lit(by).alias("grouping_column"), "n_groups", r3(F.col("w")).alias("test_statistic"), F.round("p", 4).alias("significance_score"), (F.col("p") > 0.05).alias("variances_equal"), "group_variances")


#: A rational approximation of the normal distribution's tail, to 1.5e-7.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / F.sqrt(F.lit(2) * F.pi()) * reduce(lambda acc, k: (acc + k) * t, reversed(_TAIL), F.lit(0.0))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


@template
def ks_normality_test(df: DataFrame) -> DataFrame:
    c = ranked(df, SKEW, False)[0]
    stats = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.count(c).alias("all"))
    r = ordered.average_ranks(df, c).crossJoin(F.broadcast(stats))
    cdf = normal_cdf((F.col(c) - F.col("m")) / F.col("s"))
    t = r.withColumn("f", cdf).groupBy("m", "s", "all").agg(F.max(F.greatest((F.col("below") + F.col("n")) / F.col("all") - F.col("f"), F.col("f") - F.col("below") / F.col("all"))).alias("d"))
    return t.withColumn("p", F.udf(tails.kolmogorov_sf, "double")("d", "all")).select(F.lit(c).alias("column"), F.round("d", 2).alias("test_statistic"), F.round("p", 4).alias("significance_score"), (F.col("p") >= 0.05).alias("is_normal"), F.round("m", 2).alias("sample_mean"), F.round("s", 2).alias("sample_std"))


@template
def correlation_change_analysis(df: DataFrame) -> DataFrame:
    of, n = facts(df).numbers, facts(df).n
    cols = [c for c in analysis_columns(df) if of[c]["min"] > 0 and of[c]["count"] == n]
    if len(cols) < 2:
        raise NotApplicable("fewer than two complete positive columns")
    a, b = ranked(df, SKEW, True, cols)[:2]
    low = df.agg(F.min(a).alias("la"), F.min(b).alias("lb"))
    t = df.crossJoin(F.broadcast(low)).agg(corr(a, b).alias("o"), corr(F.log1p(F.col(a) - F.col("la") + 1), F.log1p(F.col(b) - F.col("lb") + 1)).alias("l"))
    return t.select(named(a, b), r3(F.col("o")).alias("original_association"), r3(F.col("l")).alias("log_association"), r3(F.abs("l") - F.abs("o")).alias("improvement"), (F.abs("l") > F.abs("o")).alias("transformation_helpful"))


@template
def audit_missing_imputation_effect(df: DataFrame) -> DataFrame:
    c = ranked(df, lambda f: -f["count"])[0]
    med = ordered.quantiles(df, c, [0.5]).select(F.col("q")[0].alias("med"))
    t = df.crossJoin(F.broadcast(med)).agg(F.avg(F.col(c).isNull().cast("int")).alias("miss"), F.count_if(F.col(c).isNull()).alias("k"), F.avg(c).alias("o"), F.avg(F.coalesce(F.col(c), F.col("med"))).alias("i"))
    return t.select(F.lit(c).alias("column"), r3(F.col("miss") * 100).alias("missing_pct"), F.col("k").alias("imputed_count"), r3(F.col("o")).alias("original_mean"), r3(F.col("i")).alias("imputed_mean"), r3(F.col("i") - F.col("o")).alias("mean_shift"))


@template
def rank_categories_by_target_mean(df: DataFrame, min_n: int = 10, top_k: int = 3) -> DataFrame:
    by, c = text_column(df, 3, 20), top_variance(df)
    g = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("category")).agg(F.avg(c).alias("m"), F.count(c).alias("n")).where(F.col("n") >= min_n)
    return g.orderBy(F.desc("m"), "category").limit(top_k).select("category", r3(F.col("m")).alias("mean"), "n")


@template
def adaptive_two_sample_test(df: DataFrame) -> DataFrame:
    c, by = ranked(df, SKEW, False)[0], text_column(df, 2, 2)
    g = groups_of(df, by, c)
    names = [r[0] for r in g.select("group").distinct().orderBy("group").collect()]  # two values
    normal = reduce(DataFrame.crossJoin, [shapiro_frame(sampled(g.where(F.col("group") == n), "value"), "value").select(F.col("p").alias(f"p{i}")) for i, n in enumerate(names)])
    equal = levene_frame(g).select(F.udf(tails.f_sf, "double")("w", "d1", "d2").alias("pl"))
    t = ttest_frame(g).select("t", "df", F.udf(tails.t_two_sided, "double")("t", "df").alias("pt"))
    m = mwu_frame(g).select("u", "n1", "n2", F.udf(tails.normal_two_sided, "double")("z").alias("pu"))
    ok = F.coalesce((F.col("p0") >= 0.05) & (F.col("p1") >= 0.05) & (F.col("pl") >= 0.05), F.lit(False))
    d = F.col("t") * F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))
    out = normal.crossJoin(equal).crossJoin(t).crossJoin(m)  # one row each
    p = F.when(ok, F.col("pt")).otherwise(F.col("pu"))
    return out.select(F.lit(c).alias("target_column"), F.lit(by).alias("grouping_column"), F.lit(names[0]).alias("group1"), F.lit(names[1]).alias("group2"), F.when(ok, "parametric").otherwise("rank_based").alias("method_choice"), F.round(p, 4).alias("significance_score"), F.when(ok, "standardized_diff").otherwise("rank_based").alias("effect_size_kind"), F.round(F.when(ok, d).otherwise(1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))), 2).alias("effect_size"), (p < 0.05).alias("significant"), ok.alias("assumptions_passed"))


@template
def quantile_bin_best_mean(df: DataFrame, n_bins: int = 4) -> DataFrame:
    """The bin of the most skewed column with the best mean of another one. Bins are (a, b] between exact quantiles, edges to
    three digits; the first begins a thousandth lower, so that it holds the minimum. bin_means is 'bin: mean' in order."""
    of = facts(df).numbers
    top = max((SKEW(of[c]) or -1.0 for c in analysis_columns(df)), default=-1.0)
    b = min((c for c in analysis_columns(df) if (SKEW(of[c]) or -1.0) == top), default=None)
    if b is None:
        raise NotApplicable("no numeric column with the statistic")
    c = ranked(df, VARIANCE, without=(b,))[0]
    edges = ordered.quantiles(df, b, [i / n_bins for i in range(n_bins + 1)]).select(F.array_distinct("q").alias("e"))
    place = F.greatest(F.size(F.filter("e", lambda x: x < F.col(b))), F.lit(1))
    rows = df.where(F.col(b).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", place)
    shown = lambda x: F.regexp_replace(F.format_string("%.3f", x), r"0{1,2}$", "")
    low = F.get("e", F.col("bin") - 1) - F.when(F.col("bin") == 1, 0.001).otherwise(0.0)
    per = rows.groupBy("bin", "e").agg(F.avg(c).alias("m")).where("m is not null").withColumn("name", F.concat(F.lit("("), shown(low), F.lit(", "), shown(F.get("e", F.col("bin"))), F.lit("]")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bin", "name", F.round("m", 2).alias("m")))), lambda x: F.concat(x["name"], F.lit(": "), x["m"].cast("string")))
    return per.agg(F.lit(b).alias("binning_column"), F.lit(c).alias("target_column"), F.max_by("name", F.struct("m", -F.col("bin"))).alias("best_bin"), F.round(F.max("m"), 2).alias("best_bin_mean"), F.array_join(listed, "; ").alias("bin_means"))


@template
def iterative_outlier_removal(df: DataFrame, z: float = 3.0, rounds: int = 10, eps: float = 0.001) -> DataFrame:
    """Each round keeps an interval, so rounds add up to one filter and no lineage grows; the round that removes nothing counts."""
    columns = analysis_columns(df)
    best = max((CV(facts(df).numbers[c]) or -1.0 for c in columns), default=-1.0)
    c = min((c for c in columns if (CV(facts(df).numbers[c]) or -1.0) == best), default=None)
    if c is None or best < 0:
        raise NotApplicable("no numeric column with the statistic")
    low, high, used = float("-inf"), float("inf"), 0
    stats = lambda a, b: df.where((F.col(c) >= a) & (F.col(c) <= b)).agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
    first = now = df.agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
    while used < rounds and now["s"]:
        low, high, used = max(low, now["m"] - z * now["s"]), min(high, now["m"] + z * now["s"]), used + 1
        before, now = now, stats(low, high)
        if now["n"] == before["n"] or abs(now["m"] - before["m"]) < eps:
            break
    half = lambda x: F.round(F.lit(x), 2)
    return df.sparkSession.range(1).select(F.lit(c).alias("column"), F.lit(used).cast("long").alias("iterations_used"), F.lit(first["n"] - now["n"]).cast("long").alias("total_removed"), half(first["m"]).alias("initial_mean"), half(now["m"]).alias("final_mean"))


@template
def segment_then_analyze_outliers(df: DataFrame) -> DataFrame:
    by, c = text_column(df, 3, 15), top_variance(df)
    best = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("best_category")).agg(F.avg(c).alias("m")).orderBy(F.desc("m"), "best_category").limit(1)
    seg = df.join(F.broadcast(best), F.col(by) == F.col("best_category"))
    far = F.count_if((F.col(c) < F.col("low")) | (F.col(c) > F.col("high")))
    t = seg.crossJoin(F.broadcast(fences(seg, c))).groupBy("best_category").agg(F.count("*").alias("segment_size"), r3(F.avg(c)).alias("segment_mean"), far.alias("segment_outliers"), F.round(far / F.count("*"), 4).alias("outlier_rate"))
    return t.select(F.lit(by).alias("category_column"), F.lit(c).alias("target_column"), "best_category", "segment_size", "segment_mean", "segment_outliers", "outlier_rate")


#: What each analysis needs: numeric columns, ranges of values of text columns, and how many steps it takes.
NEEDS: dict[str, tuple[int, tuple[tuple[int, int], ...], int]] = {
    "max_variance_mean": (1, (), 3),
    "max_cv_mean": (1, (), 3),
    "min_mean_column_std": (1, (), 3),
    "strongest_correlation": (2, (), 4),
    "weakest_correlation": (2, (), 4),
    "conditional_normality": (1, (), 5),
    "count_high_missing_columns": (0, (), 3),
    "duplicate_rows_summary": (0, (), 3),
    "identifier_like_columns": (0, (), 3),
    "count_outlier_columns": (1, (), 4),
    "category_highest_target_mean": (1, ((2, 20),), 5),
    "correlation_after_outlier_removal": (2, (), 5),
    "regression_most_predictive": (2, (), 8),
    "ttest_discovered_groups": (2, (), 8),
    "bootstrap_ci_discovered": (1, (), 9),
    "anova_discovered_groups": (1, ((3, 10),), 9),
    "multiple_regression_top_predictors": (2, (), 9),
    "chi_squared_independence": (0, ((2, 10), (2, 10)), 6),
    "mann_whitney_u_test": (1, (), 6),
    "spearman_rank_correlation": (2, (), 6),
    "coefficient_of_variation": (1, (), 4),
    "iqr_outlier_analysis": (1, (), 5),
    "percentile_ranking": (1, (), 3),
    "descriptive_summary": (1, (), 3),
    "levene_variance_test": (1, ((2, 6),), 7),
    "ks_normality_test": (1, (), 7),
    "correlation_change_analysis": (2, (), 6),
    "audit_missing_imputation_effect": (1, (), 6),
    "rank_categories_by_target_mean": (1, ((3, 20),), 6),
    "adaptive_two_sample_test": (1, ((2, 2),), 9),
    "quantile_bin_best_mean": (2, (), 7),
    "iterative_outlier_removal": (1, (), 9),
    "segment_then_analyze_outliers": (1, ((3, 15),), 7),
}


def traits(df: DataFrame) -> DataFrame:
    """(has_missing_numeric, missing_numeric, moderate_category, many_values, few_values), one row: the numeric columns fit for
    analysis that lack values, by name, and the text columns of pick_category's three strategies (null if there are none)."""
    rows, shown = entered(df)
    lacking = sorted(c for c in analysis_columns(rows) if facts(rows).numbers[c]["count"] < facts(rows).n)

    def category(strategy: str) -> str | None:
        try:
            return pick_category(rows, strategy)
        except NotApplicable:
            return None

    row = (bool(lacking), ",".join(lacking), *map(category, ("moderate", "high", "low")))
    return shown(df.sparkSession.createDataFrame([row], "has_missing_numeric boolean, missing_numeric string, moderate_category string, many_values string, few_values string"))


def applicable(df: DataFrame) -> DataFrame:
    """(place, template, n_steps) of the analyses that the table has the columns for, the longest first; from its facts alone."""
    df, _ = entered(df)
    numbers, f = len(analysis_columns(df)), facts(df)
    sizes = [f.distinct(c) if sketch <= f.FEW else sketch for c, sketch in f.texts.items()]

    def fits(name: str) -> bool:
        least, texts, _ = NEEDS[name]
        free = list(sizes)
        for low, high in texts:
            hit = next((d for d in free if low <= d <= high), None)
            if hit is None:
                return False
            free.remove(hit)
        return numbers >= least and f.n > 0

    order = sorted((n for n in TEMPLATES if fits(n)), key=lambda n: (-NEEDS[n][2], n))
    return df.sparkSession.createDataFrame([(i, n, NEEDS[n][2]) for i, n in enumerate(order)], "place long, template string, n_steps long")
