"""The operators of procedural programs. Each takes a State and parameters and returns the next State.

A State's table is lazy; a result is a one-row DataFrame. Names of columns are plan parameters, chosen on the
driver from the schema or from one row of statistics.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered, tails
from ..functions.names import entered, plain
from ..functions.stats import corr
from ..scratch import kept
from ..shipping import ship

# Column names that identify rows rather than measure them.
ID_NAME = re.compile(r"^(id|index|idx|row_?id|unnamed.*|.*_id)$", re.I)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class State:
    df: DataFrame
    order: tuple[str, ...] = ()
    num_cols: tuple[str, ...] = ()
    cat_cols: tuple[str, ...] = ()
    num: str | None = None
    num1: str | None = None
    num2: str | None = None
    cat: str | None = None
    series: Column | None = None
    per_group: DataFrame | None = None
    p: dict[str, DataFrame] = field(default_factory=dict)
    result: DataFrame | None = None


@dataclass(frozen=True)
class Operator:
    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Callable[..., State]


CATALOG: dict[str, Operator] = {}


def operator(name: str, inputs: str, outputs: str):
    def add(f):
        CATALOG[name] = Operator(name, tuple(inputs.split()), tuple(outputs.split()), f)
        return f

    return add


def r3(c: Column) -> Column:
    return F.round(c, 3)


def numeric_columns(df: DataFrame) -> list[str]:
    return sorted(c for c, t in df.dtypes if t in NUMERIC and not ID_NAME.match(c))


def text_columns(df: DataFrame) -> list[str]:
    return sorted(c for c, t in df.dtypes if t == "string" and not ID_NAME.match(c))


@operator("select_numeric_cols", "Table", "NumCols")
def select_numeric(s: State) -> State:
    return replace(s, num_cols=tuple(numeric_columns(s.df)))


@operator("select_categorical_cols", "Table", "CatCols")
def select_categorical(s: State) -> State:
    return replace(s, cat_cols=tuple(text_columns(s.df)))


@operator("bind_numeric_col", "NumCols", "NumCol")
def bind_numeric(s: State, column: str) -> State:
    return replace(s, num=_among(column, s.num_cols))


@operator("bind_binary_cat_col", "CatCols", "CatCol")
def bind_binary(s: State, column: str) -> State:
    return replace(s, cat=_among(column, s.cat_cols))


@operator("bind_num_col_1", "NumCols", "NumCol1")
def bind_first(s: State, column: str) -> State:
    return replace(s, num1=_among(column, s.num_cols))


@operator("bind_num_col_2", "NumCols", "NumCol2")
def bind_second(s: State, column: str) -> State:
    if column == s.num1:
        raise ValueError("num_col_2 must differ from num_col_1")
    return replace(s, num2=_among(column, s.num_cols))


def _among(column: str, columns: tuple[str, ...]) -> str:
    if column not in columns:
        raise ValueError(f"{column} is not one of {columns}")
    return column


def _best(s: State, columns: tuple[str, ...], stat: Callable[[str], Column], smallest: bool) -> str:
    row = s.df.agg(*[stat(c).alias(c) for c in columns]).first()
    known = [(row[c], c) for c in columns if row[c] is not None]
    if not known:
        raise ValueError("no column has the statistic")
    top = (min if smallest else max)(v for v, _ in known)
    return next(c for v, c in known if v == top)


@operator("pick_numeric_by_variance", "NumCols", "NumCol")
def pick_variance(s: State, strategy: str = "max") -> State:
    return replace(s, num=_best(s, s.num_cols, F.var_samp, strategy == "min"))


def adjusted_skew(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


@operator("pick_numeric_by_skew", "NumCols", "NumCol")
def pick_skew(s: State, strategy: str = "max") -> State:
    return replace(s, num=_best(s, s.num_cols, adjusted_skew, strategy == "min"))


@operator("pick_categorical_by_cardinality", "CatCols", "CatCol")
def pick_cardinality(s: State, strategy: str = "min") -> State:
    return replace(s, cat=_best(s, s.cat_cols, F.count_distinct, strategy == "min"))


@operator("zscore", "NumCol", "NumSeries")
def zscore(s: State) -> State:
    stats = s.df.agg(F.avg(s.num).alias("_mean"), F.stddev_pop(s.num).alias("_std"))
    df = s.df.crossJoin(F.broadcast(stats))  # one row
    return replace(s, df=df, series=(F.col(s.num) - F.col("_mean")) / F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std")))


@operator("log1p", "NumCol", "NumSeries")
def log1p(s: State) -> State:
    return replace(s, series=F.when(F.col(s.num).isNotNull(), F.log1p(F.greatest(F.col(s.num), F.lit(0)))))


@operator("abs", "NumCol", "NumSeries")
def absolute(s: State) -> State:
    return replace(s, series=F.abs(s.num))


# What a group or a column is measured by: the answer's name, and the aggregate.
MEASURES: dict[str, tuple[str, Callable[[str], Column] | None]] = {
    "mean": ("mean", F.avg),
    "var": ("variance", F.var_samp),
    "median": ("median", None),
    "std": ("std", F.stddev_samp),
    "count": ("count", lambda c: F.count("*")),
}


def group_medians(groups: DataFrame) -> DataFrame:
    """(group, med) of groups(group, value), by ranks."""
    return ordered.quantiles(groups, "value", [0.5], "group").select("group", F.col("q")[0].alias("med"))


def _group(kind: str):
    def run(s: State) -> State:
        rows = s.df.where(F.col(s.cat).isNotNull())
        if kind == "median":  # a group without values has a null median
            g = rows.select(F.col(s.cat).alias("group")).distinct().join(group_medians(rows.select(F.col(s.cat).alias("group"), F.col(s.num).alias("value"))), "group", "left").select("group", F.col("med").alias("value"))
        else:
            g = rows.groupBy(F.col(s.cat).alias("group")).agg(MEASURES[kind][1](s.num).alias("value"))
        return replace(s, per_group=g, result=g.select("group", "value" if kind == "count" else r3(F.col("value")).alias("value")))

    return run


def _winner(kind: str, largest: bool):
    def run(s: State) -> State:
        v = F.col("value").desc_nulls_last() if largest else F.col("value").asc_nulls_last()
        out = F.col("value") if kind == "count" else r3(F.col("value"))
        return replace(s, result=s.per_group.orderBy(v, "group").limit(1).select("group", out.alias(MEASURES[kind][0])))

    return run


for _kind in MEASURES:
    operator(f"groupby_{_kind}", "Table CatCol" if _kind == "count" else "Table CatCol NumCol", f"Dict:{_kind}")(_group(_kind))
for _kind in ("mean", "median", "std", "var", "count"):
    _tail = "" if _kind == "mean" else f"_{_kind}"
    operator(f"argmax_group{_tail}", f"Dict:{_kind}", "Answer")(_winner(_kind, True))
    operator(f"argmin_group{_tail}", f"Dict:{_kind}", "Answer")(_winner(_kind, False))


def _scalar(measure: Callable[[str], Column], name: str, bound: str = "num"):
    def run(s: State) -> State:
        c = getattr(s, bound)
        return replace(s, result=s.df.agg(F.lit(c).alias("column"), r3(measure(c)).alias(name)))

    return run


@operator("median", "NumCol", "Answer")
def median(s: State) -> State:
    return replace(s, result=ordered.quantiles(s.df, s.num, [0.5]).select(F.lit(s.num).alias("column"), r3(F.col("q")[0]).alias("median")))


for _name, _f in (("mean", F.avg), ("std", F.stddev_samp), ("variance", F.var_samp), ("sum", lambda c: F.coalesce(F.sum(c), F.lit(0)))):
    operator(_name, "NumCol", "Answer")(_scalar(_f, _name))
operator("min", "NumCol1", "Answer")(_scalar(F.min, "min", "num1"))
operator("max", "NumCol1", "Answer")(_scalar(F.max, "max", "num1"))


def _of_series(name: str, measure: Callable[[Column], Column]):
    def run(s: State) -> State:
        return replace(s, result=s.df.agg(F.lit(name).alias("metric"), r3(measure(s.series)).alias("value")))

    return run


@operator("median_series", "NumSeries", "Answer")
def median_series(s: State) -> State:
    middle = ordered.quantiles(s.df.select(s.series.alias("_s")), "_s", [0.5])
    return replace(s, result=middle.select(F.lit("median").alias("metric"), r3(F.col("q")[0]).alias("value")))


for _name, _f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
    operator(f"{_name}_series", "NumSeries", "Answer")(_of_series(_name, _f))


@operator("groupby_values", "Table CatCol NumCol", "Groups")
def groupby_values(s: State) -> State:
    g = s.df.where(F.col(s.cat).isNotNull() & F.col(s.num).isNotNull()).select(F.col(s.cat).alias("group"), F.col(s.num).cast("double").alias("value"))
    out = g.groupBy("group").agg(F.count("*").alias("n"), r3(F.avg("value")).alias("mean"), r3(F.var_samp("value")).alias("variance"))
    return replace(s, per_group=g, result=out)


#: Ranks whose quantiles one row sums.
RANKS = 1 << 16


def _quantile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranks first..last of n -> the sums of their normal scores and of the squares, all ranks of a slice at once."""
    for b in batches:
        first, last, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "n"))
        size = last - first + 1
        total, squares = np.zeros(len(size)), np.zeros(len(size))
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
            k, own = size[at:to], np.cumsum(size[at:to]) - size[at:to]
            rank = np.repeat(first[at:to] - own, k) + np.arange(k.sum())
            m = tails.normal_quantiles((rank - 0.375) / np.repeat(n[at:to] + 0.25, k))
            total[at:to], squares[at:to] = np.add.reduceat(m, own), np.add.reduceat(m * m, own)
            at = to
        yield pa.RecordBatch.from_arrays([b.column("x"), pa.array(total), pa.array(squares)], names=["x", "m", "mm"])


def dealt(blocks: DataFrame, *keys: str) -> DataFrame:
    """blocks over all tasks, by a hash: few values stand for many rows, and their small shuffles end in one task."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shapiro_frame(values: DataFrame, column: str) -> DataFrame:
    """(w, p) of Shapiro-Wilk over all values that are not null, from distinct values and their ranks."""
    x = values.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    ranks = ordered.average_ranks(x, "x").withColumnRenamed("n", "k").crossJoin(F.broadcast(stats.select("n")))
    first, last = F.col("below") + 1, F.col("below") + F.col("k")
    blocks = dealt(ranks.select("x", "n", last.alias("end"), F.explode(F.sequence(first, last, F.lit(RANKS).cast("long"))).alias("first")), "x", "first")
    sums = blocks.select("x", "n", "first", F.least(F.col("first") + RANKS - 1, "end").alias("last")).mapInArrow(_quantile_sums, "x double, m double, mm double")
    sums = sums.crossJoin(F.broadcast(stats.select("mean"))).agg(F.sum("mm").alias("mm"), F.sum(F.col("m") * (F.col("x") - F.col("mean"))).alias("mx"))
    low = [F.max(F.when(F.col("below") < i, F.col("x"))) for i in (1, 2)]
    high = [F.min(F.when(last > F.col("n") - i, F.col("x"))) for i in (1, 2)]
    ends = ranks.agg(low[0].alias("l1"), low[1].alias("l2"), high[1].alias("h2"), high[0].alias("h1"))
    one = stats.crossJoin(sums).crossJoin(ends)  # one row each
    return one.select(F.udf(tails.shapiro_sums, "w double, p double")("n", "mm", "mx", F.col("v") * F.col("n"), "l1", "l2", "h2", "h1").alias("r")).select("r.*")


#: Rows of the sample that two templates test, as the analyses they stand for do.
SHAPIRO_ROWS = 5000


def sampled(values: DataFrame, column: str, rows: int = SHAPIRO_ROWS) -> DataFrame:
    """(column) of all non-null values, or of a sample of so many rows: the smallest by a hash of the value and the
    number of the row among those with the value, so that every row has the same chance. The sample is written once to
    the shared folder."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k"))
    blocks = dealt(counts.select(column, "k", F.explode(F.sequence(F.lit(1).cast("long"), "k", F.lit(RANKS).cast("long"))).alias("i")), column, "i")
    each = blocks.select(column, F.explode(F.sequence("i", F.least(F.col("i") + RANKS - 1, "k"))).alias("i"))
    return kept(each.orderBy(F.xxhash64(column, "i"), column, "i").limit(rows).select(column), "sample")


@operator("shapiro_p", "NumCol", "NormalityP")
def shapiro_p(s: State) -> State:
    f = shapiro_frame(s.df, s.num)
    return replace(s, p=s.p | {"normality": f.select(F.col("p").alias("normality_p"))}, result=f.select(r3(F.col("w")).alias("statistic"), r3(F.col("p")).alias("p_value")))


#: Groups whose medians are broadcast to the rows; of more, both sides are shuffled.
BROADCAST_GROUPS = 500_000


def levene_frame(groups: DataFrame) -> DataFrame:
    """(w, d1, d2) of the median-centred Levene test of groups(group, value). The medians of few groups go to the rows, so that no
    task holds a group."""
    medians = group_medians(groups)
    if groups.agg(F.approx_count_distinct("group")).first()[0] <= BROADCAST_GROUPS:
        medians = F.broadcast(medians)
    return anova_frame(groups.join(medians, "group").select("group", F.abs(F.col("value") - F.col("med")).alias("value"))).select(F.col("f").alias("w"), "d1", "d2")


def anova_frame(groups: DataFrame) -> DataFrame:
    """(f, d1, d2, eta) of one-way analysis of variance of groups(group, value)."""
    per = groups.groupBy("group").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    t = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("n")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return t.select(F.try_divide(between / d1, F.col("within") / d2).alias("f"), d1.alias("d1"), d2.alias("d2"), F.try_divide(between, between + F.col("within")).alias("eta"))


@operator("levene_p", "Groups", "EqualVarP")
def levene_p(s: State) -> State:
    f = levene_frame(s.per_group).withColumn("p", F.udf(tails.f_sf, "double")("w", "d1", "d2"))
    return replace(s, p=s.p | {"levene": f.select(F.col("p").alias("levene_p"))}, result=f.select(r3(F.col("w")).alias("statistic"), r3(F.col("p")).alias("p_value")))


@operator("choose_test", "NormalityP EqualVarP", "Chosen")
def choose_test(s: State) -> State:
    both = s.p["normality"].crossJoin(s.p["levene"])  # one row each
    c = both.select(F.when((F.col("normality_p") > 0.05) & (F.col("levene_p") > 0.05), "ttest").otherwise("mwu").alias("chosen_test"))
    return replace(s, p=s.p | {"chosen": c}, result=c)


def ttest_frame(groups: DataFrame) -> DataFrame:
    """(t, df) of Student's test of the two smallest group names of groups(group, value)."""
    per = groups.groupBy("group").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).orderBy("group").limit(2)
    two = per.agg(*[f(F.struct("group", "n", "m", "v")).alias(k) for k, f in (("a", F.min), ("b", F.max))])
    n1, n2 = F.col("a.n"), F.col("b.n")
    pooled = ((n1 - 1) * F.col("a.v") + (n2 - 1) * F.col("b.v")) / (n1 + n2 - 2)
    return two.select((F.try_divide(F.col("a.m") - F.col("b.m"), F.sqrt(pooled * (1 / n1 + 1 / n2)))).alias("t"), (n1 + n2 - 2).alias("df"))


def mwu_frame(groups: DataFrame) -> DataFrame:
    """(u, z, n1, n2) of the Mann-Whitney test of the first group by name against the second, with ties and continuity."""
    first = groups.agg(F.min("group").alias("g1"))
    ranks = ordered.average_ranks(groups, "value")
    per = groups.crossJoin(F.broadcast(first)).groupBy("value").agg(F.count_if(F.col("group") == F.col("g1")).alias("k"), F.count("*").alias("kk"))
    t = per.join(ranks, "value").agg(F.sum("k").alias("n1"), F.sum("kk").alias("n"), F.sum(F.col("k") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r1"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - F.col("ties") / ((n1 + n2) * (n1 + n2 - 1))))
    return t.select(u.alias("u"), F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd).alias("z"), n1.alias("n1"), n2.alias("n2"))


@operator("ttest_ind", "Groups Chosen", "Answer")
def two_sample(s: State) -> State:
    t = ttest_frame(s.per_group).select(F.lit("ttest").alias("test"), F.col("t").alias("stat"), F.udf(tails.t_two_sided, "double")("t", "df").alias("p"))
    m = mwu_frame(s.per_group).select(F.lit("mwu").alias("test"), F.col("u").alias("stat"), F.udf(tails.normal_two_sided, "double")("z").alias("p"))
    both = t.unionAll(m).join(F.broadcast(s.p["chosen"]), F.col("test") == F.col("chosen_test"))
    return replace(s, result=both.select("test", r3(F.col("stat")).alias("stat"), r3(F.col("p")).alias("p_value")))


@operator("correlation", "NumCol1 NumCol2", "Answer")
def correlation(s: State) -> State:
    rows = s.df.where(F.col(s.num1).isNotNull() & F.col(s.num2).isNotNull())
    return replace(s, result=rows.agg(F.lit(s.num1).alias("col1"), F.lit(s.num2).alias("col2"), r3(corr(s.num1, s.num2)).alias("correlation")))


@operator("ratio", "NumCol1 NumCol2", "Answer")
def ratio(s: State) -> State:
    q = F.col(s.num1) / F.nullif(F.col(s.num2), F.lit(0).cast(dict(s.df.dtypes)[s.num2]))
    return replace(s, result=s.df.agg(F.lit(s.num1).alias("col1"), F.lit(s.num2).alias("col2"), r3(F.avg(q)).alias("mean_ratio")))


@operator("filter_greater_than", "Table NumCol", "Filtered")
def filter_greater(s: State, threshold: float = 0) -> State:
    return replace(s, result=s.df.where(F.col(s.num) > threshold).agg(F.count("*").alias("n_filtered")))


@operator("filter_by_threshold", "Table NumCol", "Table")
def filter_threshold(s: State, threshold: float = 0) -> State:
    df = s.df.where(F.col(s.num) > threshold)
    return replace(s, df=df, result=df.agg(F.count("*").alias("n_rows")))


@operator("sort_by_column", "Table NumCol", "Table")
def sort_by(s: State, ascending: bool = True) -> State:
    key = F.when(F.col(s.num).isNull(), None).otherwise(F.col(s.num) if ascending else -F.col(s.num))
    return replace(s, df=s.df.withColumn("_sort", key), order=("_sort", *s.order), result=None)


@operator("top_n", "Table", "Table")
def top_n(s: State, n: int = 10) -> State:
    df = s.df.orderBy(*[F.col(c).asc_nulls_last() for c in s.order]).limit(n)
    return replace(s, df=df, result=df)


@operator("cumulative_sum", "Table NumCol", "Table")
def cumulative_sum(s: State) -> State:
    name = f"{s.num}_cumsum"
    df = ordered.running_sum(ordered.numbered(s.df, *s.order), F.col(s.num), name).drop("_idx")
    return replace(s, df=df, result=df.select(*s.order, r3(F.col(name)).alias(name)))


@operator("rolling_mean", "Table NumCol", "Table")
def rolling_mean(s: State, window: int = 3) -> State:
    name = f"{s.num}_rolling_{window}"
    df = ordered.trailing(ordered.numbered(s.df, *s.order), window, lambda w: F.avg(s.num).over(w), name).drop("_idx")
    return replace(s, df=df, result=df.select(*s.order, r3(F.col(name)).alias(name)))


@operator("diff", "Table NumCol", "Table")
def diff(s: State) -> State:
    name = f"{s.num}_diff"
    value = lambda w: F.when(F.count("*").over(w) == 2, F.col(s.num) - F.first(s.num).over(w))
    df = ordered.trailing(ordered.numbered(s.df, *s.order), 2, value, name).withColumn(name, F.coalesce(name, F.lit(0))).drop("_idx")
    return replace(s, df=df, result=df.select(*s.order, r3(F.col(name)).alias(name)))


@operator("percentile_rank", "Table NumCol", "Table")
def percentile_rank(s: State) -> State:
    name = f"{s.num}_percentile"
    ranks = ordered.average_ranks(s.df, s.num)
    share = ranks.select(F.col(s.num).alias("_k"), ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias(name))
    df = s.df.join(share, F.col(s.num) == F.col("_k"), "left").drop("_k")
    return replace(s, df=df, result=df.select(*s.order, F.round(name, 6).alias(name)))


@operator("bin_into_quartiles", "Table NumCol", "Table")
def quartiles(s: State) -> State:
    name = f"{s.num}_quartile"
    cuts = ordered.quantiles(s.df, s.num, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    q = F.when(F.col(s.num) <= F.col("_q")[0], "Q1").when(F.col(s.num) <= F.col("_q")[1], "Q2").when(F.col(s.num) <= F.col("_q")[2], "Q3").when(F.col(s.num).isNotNull(), "Q4")
    df = s.df.crossJoin(F.broadcast(cuts)).withColumn(name, q).drop("_q")  # one row of cuts
    return replace(s, df=df, result=df.groupBy(name).agg(F.count("*").alias("n")))


def run(df: DataFrame, chain: list[tuple[str, dict]], order: tuple[str, ...] = ()) -> DataFrame:
    """Fold a chain of (operator, parameters) over df; the last operator's result. NaN is missing; columns may have any names."""
    ship(df.sparkSession)
    rows, shown = entered(df)
    s = State(rows, tuple(map(plain, order)))
    for name, params in chain:
        s = CATALOG[name].run(s, **{k: plain(v) if k == "column" else v for k, v in params.items()})
    return shown(s.result if s.result is not None else s.df)
