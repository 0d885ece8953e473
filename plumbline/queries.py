"""Queries over the given tables, one an operator, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import record_queries, statistic_queries, user_queries
from .operators import catalog
from .operators.profile import column_profile, head, index_columns, quality_issues, shape, strongest_correlations, time_ranges, top_values, value_summary
from .plans.templates import TEMPLATES, applicable, traits
from .records.context import prune_context
from .records.splits import stratified_split
from .records.summaries import pass_rates, timings
from .scratch import shared_dir
from .streaming import rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem without its keys; quantities of 13 count as missing, so that missing values occur."""
    df = table(spark, sf_dir, "lineitem").select(*LINE)
    return df.withColumn("l_quantity", F.nullif("l_quantity", F.lit(13.0)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.nullif("value", F.lit(0.0)).alias("value"), "event_type")


SOURCES = {"line": line, "events": events}
WITH = """with line as (select nullif(l_quantity, 13.0) as l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus from lineitem),
ev as (select event_id, nullif(value, 0.0) as value, event_type from events) """


def program(name: str, source: str, chain: list, sql: str | None, order: tuple[str, ...] = ()) -> None:
    steps = [(c, {}) if isinstance(c, str) else c for c in chain]
    QUERIES[f"proc_{name}"] = lambda spark, d: catalog.run(SOURCES[source](spark, d), steps, order)
    if sql:
        ORACLE_SQL[f"proc_{name}"] = WITH + sql


NUM, CAT = "select_numeric_cols", "select_categorical_cols"
PRICE, QTY = ("bind_numeric_col", {"column": "l_extendedprice"}), ("bind_numeric_col", {"column": "l_quantity"})
ONE, TWO = ("bind_num_col_1", {"column": "l_quantity"}), ("bind_num_col_2", {"column": "l_extendedprice"})
BINARY = ("bind_binary_cat_col", {"column": "l_linestatus"})
FLAG = ("bind_binary_cat_col", {"column": "l_returnflag"})
AGG = {"mean": "avg({})", "var": "var_samp({})", "median": "median({})", "std": "stddev_samp({})", "count": "count(*)"}
OUT = {"mean": "mean", "var": "variance", "median": "median", "std": "std", "count": "count"}

for _k, _a in AGG.items():
    _v = _a.format("l_quantity")
    _r = _v if _k == "count" else f"round({_v}, 3)"
    _by = [CAT, FLAG, NUM, QTY, f"groupby_{_k}"]
    program(f"groupby_{_k}", "line", _by, f'select l_returnflag as "group", {_r} as value from line where l_returnflag is not null group by 1')
    for _way in ("max", "min"):
        _d = "desc" if _way == "max" else "asc"
        _n = f"arg{_way}_group" + ("" if _k == "mean" else f"_{_k}")
        program(_n, "line", [*_by, _n], f'select l_returnflag as "group", {_r} as {OUT[_k]} from line where l_returnflag is not null group by 1 order by {_v} {_d} nulls last, 1 limit 1')
for _n, _a in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("variance", "var_samp"), ("sum", "sum")):
    program(_n, "line", [NUM, QTY, _n], f"select 'l_quantity' as \"column\", round({_a}(l_quantity), 3) as {_n} from line")
for _n in ("min", "max"):
    program(_n, "line", [NUM, ONE, _n], f"select 'l_quantity' as \"column\", round({_n}(l_quantity), 3) as {_n} from line")
_SERIES = {"zscore": "(l_quantity - (select avg(l_quantity) from line)) / (select stddev_pop(l_quantity) from line)", "log1p": "ln(1 + greatest(l_quantity, 0))", "abs": "abs(l_quantity)"}
for _op, _e in _SERIES.items():
    for _n, _a in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")):
        if (_op, _n) in (("zscore", "mean"), ("log1p", "median"), ("log1p", "mean"), ("log1p", "std"), ("abs", "max"), ("abs", "min"), ("zscore", "std"), ("zscore", "max")):
            program(f"{_op}_{_n}_series", "line", [NUM, QTY, _op, f"{_n}_series"], f"select '{_n}' as metric, round({_a}(x), 3) + 0.0 as value from (select case when l_quantity is not null then {_e} end as x from line)")
program("select_numeric_cols_variance", "line", [NUM, "pick_numeric_by_variance", "mean"], "select name as \"column\", round(avg(v), 3) as mean from (unpivot (select l_quantity, l_extendedprice, l_discount, l_tax from line) on columns(*) into name name value v) group by 1 order by var_samp(v) desc, 1 limit 1")
program("pick_numeric_by_skew", "line", [NUM, "pick_numeric_by_skew", "mean"], "select name as \"column\", round(avg(v), 3) as mean from (unpivot (select l_quantity, l_extendedprice, l_discount, l_tax from line) on columns(*) into name name value v) group by 1 order by skewness(v) desc, 1 limit 1")
program("pick_categorical_by_cardinality", "line", [CAT, "pick_categorical_by_cardinality", NUM, QTY, "groupby_mean"], 'select l_linestatus as "group", round(avg(l_quantity), 3) as value from line group by 1')
program("correlation", "line", [NUM, ONE, TWO, "correlation"], "select 'l_quantity' as col1, 'l_extendedprice' as col2, round(corr(l_quantity, l_extendedprice), 3) as correlation from line")
program("ratio", "line", [NUM, ONE, ("bind_num_col_2", {"column": "l_discount"}), "ratio"], "select 'l_quantity' as col1, 'l_discount' as col2, round(avg(l_quantity / nullif(l_discount, 0)), 3) as mean_ratio from line")
program("filter_greater_than", "line", [NUM, QTY, ("filter_greater_than", {"threshold": 25})], "select count(*) as n_filtered from line where l_quantity > 25")
program("filter_by_threshold", "line", [NUM, QTY, ("filter_by_threshold", {"threshold": 25}), PRICE, "mean"], "select 'l_extendedprice' as \"column\", round(avg(l_extendedprice), 3) as mean from line where l_quantity > 25")
program("groupby_values", "line", [CAT, FLAG, NUM, QTY, "groupby_values"], 'select l_returnflag as "group", count(l_quantity) as n, round(avg(l_quantity), 3) as mean, round(var_samp(l_quantity), 3) as variance from line where l_quantity is not null group by 1')
program("shapiro_p", "line", [NUM, QTY, "shapiro_p"], None)
program("levene_p", "line", [CAT, FLAG, NUM, QTY, "groupby_values", "levene_p"], None)
_EV = ("bind_numeric_col", {"column": "value"})
program("choose_test", "line", [CAT, BINARY, NUM, QTY, "groupby_values", "shapiro_p", "levene_p", "choose_test"], None)
program("ttest_ind", "line", [CAT, BINARY, NUM, QTY, "groupby_values", "shapiro_p", "levene_p", "choose_test", "ttest_ind"], None)
program("sort_by_column_top_n", "events", [NUM, _EV, ("sort_by_column", {"ascending": False}), ("top_n", {"n": 25}), "mean"], "select 'value' as \"column\", round(avg(value), 3) as mean from (select value from ev order by value desc nulls last, event_id limit 25)", ("event_id",))
program("cumulative_sum", "events", [NUM, _EV, "cumulative_sum"], "select event_id, round(case when value is not null then sum(value) over (order by event_id) end, 3) as value_cumsum from ev", ("event_id",))
program("rolling_mean", "events", [NUM, _EV, ("rolling_mean", {"window": 5})], "select event_id, round(avg(value) over (order by event_id rows between 4 preceding and current row), 3) as value_rolling_5 from ev", ("event_id",))
program("diff", "events", [NUM, _EV, "diff"], "select event_id, round(coalesce(value - lag(value) over (order by event_id), 0), 3) as value_diff from ev", ("event_id",))
program("percentile_rank", "events", [NUM, _EV, "percentile_rank"], "select event_id, case when value is not null then round((rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0) / (select count(value) from ev), 6) end as value_percentile from ev", ("event_id",))
program("bin_into_quartiles", "events", [NUM, _EV, "bin_into_quartiles"], "select case when value <= q[1] then 'Q1' when value <= q[2] then 'Q2' when value <= q[3] then 'Q3' when value is not null then 'Q4' end as value_quartile, count(*) as n from ev, (select quantile_cont(value, [0.25, 0.5, 0.75]) as q from ev) group by 1")

for _n, _f in TEMPLATES.items():
    QUERIES[f"tpl_{_n}"] = lambda spark, d, f=_f: f(line(spark, d))

# Other ways to read a question: the same analysis with other parameters.
ALTERNATES: dict[str, tuple[str, dict]] = {
    "max_std_mean": ("max_variance_mean", {"strategy": "max_std"}),
    "max_variance_mean_without_top": ("max_variance_mean", {"without_top": True}),
    "min_mean_std_without_top": ("min_mean_column_std", {"leave_out": "top_variance"}),
    "min_mean_std_without_first": ("min_mean_column_std", {"leave_out": "first"}),
    "strongest_correlation_without_top": ("strongest_correlation", {"without_top": True}),
    "weakest_correlation_without_top": ("weakest_correlation", {"without_top": True}),
    "outlier_columns_z2": ("count_outlier_columns", {"z": 1.5}),
    "outlier_columns_reaching": ("count_outlier_columns", {"z": 1.5, "rule": "reaching"}),
    "outlier_columns_population": ("count_outlier_columns", {"z": 1.5, "rule": "population"}),
    "outlier_columns_quartiles": ("count_outlier_columns", {"rule": "quartiles"}),
    "high_missing_columns_ten": ("count_high_missing_columns", {"threshold": 1.0}),
    "iqr_outliers_by_cv": ("iqr_outlier_analysis", {"strategy": "max_cv"}),
    "summary_by_cv": ("descriptive_summary", {"strategy": "max_cv"}),
    "regression_by_cv": ("regression_most_predictive", {"strategy": "max_cv"}),
    "ttest_by_cv": ("ttest_discovered_groups", {"strategy": "max_cv"}),
    "ttest_in_table_order": ("ttest_discovered_groups", {"alphabetical": False}),
}
for _n, (_f, _p) in ALTERNATES.items():
    QUERIES[f"tpl_{_n}"] = lambda spark, d, f=_f, p=_p: TEMPLATES[f](line(spark, d), **p)

QUERIES["tpl_correlation_change_analysis"] = lambda spark, d: TEMPLATES["correlation_change_analysis"](table(spark, d, "lineitem").select(*LINE))

_UN = "(unpivot (select l_quantity, l_extendedprice, l_discount, l_tax from line) on columns(*) into name name value v)"
_PAIRS = "(select unnest([{'c': 'l_extendedprice,l_quantity', 'r': corr(l_quantity, l_extendedprice)}, {'c': 'l_discount,l_quantity', 'r': corr(l_quantity, l_discount)}, {'c': 'l_quantity,l_tax', 'r': corr(l_quantity, l_tax)}, {'c': 'l_discount,l_extendedprice', 'r': corr(l_extendedprice, l_discount)}, {'c': 'l_extendedprice,l_tax', 'r': corr(l_extendedprice, l_tax)}, {'c': 'l_discount,l_tax', 'r': corr(l_discount, l_tax)}]) as p from line)"
_TOP = f"(select name from {_UN} group by 1 order by var_samp(v) desc limit 1)"
_CV = f"(select name from {_UN} group by 1 order by stddev_samp(v) / abs(avg(v)) desc limit 1)"
_VALS = f"(select v from {_UN} where name = {_TOP})"
_BIN = "(select 'l_extendedprice' as target)"
for _n, _s in {
    "max_variance_mean": f"select round(avg(v), 3) as answer from {_VALS}",
    "max_cv_mean": f"select round(avg(v), 3) as answer from {_UN} where name = {_CV}",
    "min_mean_column_std": f"select round(stddev_samp(v), 3) as answer from {_UN} where name = (select name from {_UN} group by 1 order by avg(v) limit 1)",
    "strongest_correlation": f"select p.c as columns, round(abs(p.r), 2) as association_score from {_PAIRS} order by abs(p.r) desc limit 1",
    "weakest_correlation": f"select p.c as columns, round(abs(p.r), 2) as association_score from {_PAIRS} order by abs(p.r) limit 1",
    "count_high_missing_columns": "select (count(*) filter (where m > 5))::bigint as count, coalesce(string_agg(c, ',' order by c) filter (where m > 5), '') as columns from (select 'l_quantity' as c, avg((l_quantity is null)::int) * 100 as m from line)",
    "duplicate_rows_summary": "select sum(n - 1)::bigint as duplicate_rows, round(sum(n - 1) * 100 / sum(n), 2) as duplicate_pct from (select count(*) as n from line group by l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)",
    "count_outlier_columns": f"select (count(*) filter (where k > 0))::bigint as columns_with_outliers, sum(k)::bigint as total_outliers from (select name, count(*) filter (where s > 0 and abs(v - m) > 3 * s) as k from {_UN} join (select name, avg(v) as m, stddev_samp(v) as s from {_UN} group by 1) using (name) group by 1)",
    "category_highest_target_mean": "select 'l_returnflag' as category_column, l_returnflag as best_category, 'l_extendedprice' as target_column, round(avg(l_extendedprice), 3) as mean_value from line group by 2 order by avg(l_extendedprice) desc, 2 limit 1",
    "coefficient_of_variation": f"select name as \"column\", round(stddev_samp(v) / abs(avg(v)) * 100, 3) as cv, round(avg(v), 3) as mean, round(stddev_samp(v), 3) as std from {_UN} group by 1 order by stddev_samp(v) / abs(avg(v)) desc limit 1",
    "iqr_outlier_analysis": f"select {_TOP} as \"column\", round(q1, 3) as q1, round(q3, 3) as q3, round(q3 - q1, 3) as iqr, round(q1 - 1.5 * (q3 - q1), 3) as lower_fence, round(q3 + 1.5 * (q3 - q1), 3) as upper_fence, count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers from {_VALS}, (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from {_VALS}) group by q1, q3",
    "percentile_ranking": f"select name as \"column\", round(quantile_cont(v, 0.1), 3) as p10, round(quantile_cont(v, 0.25), 3) as p25, round(quantile_cont(v, 0.5), 3) as p50, round(quantile_cont(v, 0.75), 3) as p75, round(quantile_cont(v, 0.9), 3) as p90 from {_UN} group by 1 order by max(v) - min(v) desc limit 1",
    "descriptive_summary": f"select {_TOP} as \"column\", count(v) as count, round(avg(v), 3) as mean, round(stddev_samp(v), 3) as std, round(min(v), 3) as min, round(max(v), 3) as max, round(median(v), 3) as median, round(skewness(v), 3) as skewness, round(kurtosis(v), 3) as kurtosis from {_VALS}",
    "audit_missing_imputation_effect": "select 'l_quantity' as \"column\", round(avg((l_quantity is null)::int) * 100, 3) as missing_pct, count(*) filter (where l_quantity is null) as imputed_count, round(avg(l_quantity), 3) as original_mean, round(avg(coalesce(l_quantity, (select median(l_quantity) from line))), 3) as imputed_mean, round(avg(coalesce(l_quantity, (select median(l_quantity) from line))) - avg(l_quantity), 3) as mean_shift from line",
    "rank_categories_by_target_mean": "select l_returnflag as category, round(avg(l_extendedprice), 3) as mean, count(l_extendedprice) as n from line group by 1 having count(l_extendedprice) >= 10 order by avg(l_extendedprice) desc, 1 limit 3",
    "identifier_like_columns": "select (count(*) filter (where u >= 0.98 * n))::bigint as count, coalesce(string_agg(c, ',' order by c) filter (where u >= 0.98 * n), '') as columns from (" + " union all ".join(f"select '{c}' as c, count(distinct {c}) + max(({c} is null)::int) as u, count(*) as n from line" for c in LINE) + ")",
}.items():
    ORACLE_SQL[f"tpl_{_n}"] = WITH + _s

QUERIES["profile_columns"] = lambda spark, d: column_profile(line(spark, d))
ORACLE_SQL["profile_columns"] = WITH + " union all ".join(
    f"select '{c}' as \"column\", 'numeric' as kind, count(*) - count({c}) as missing_count, round(avg(({c} is null)::int) * 100, 2) as missing_pct, count(distinct {c}) as unique_count, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std, round(min({c}), 3) as min, round(quantile_cont({c}, 0.25), 3) as q25, round(median({c}), 3) as median, round(quantile_cont({c}, 0.75), 3) as q75, round(max({c}), 3) as max, round(skewness({c}), 3) as skew from line"
    if i < 4
    else f"select '{c}', 'categorical', count(*) - count({c}), round(avg(({c} is null)::int) * 100, 2), count(distinct {c}), null, null, null, null, null, null, null, null from line"
    for i, c in enumerate(LINE)
)

QUERIES["profile_top_values"] = lambda spark, d: top_values(line(spark, d))
ORACLE_SQL["profile_top_values"] = WITH + 'select name as "column", v as value, n as count, place from (select *, row_number() over (partition by name order by n desc, v) as place from (select name, v, count(*) as n from (unpivot (select l_returnflag, l_linestatus from line) on columns(*) into name name value v) group by 1, 2)) where place <= 5'
QUERIES["profile_correlations"] = lambda spark, d: strongest_correlations(line(spark, d))
ORACLE_SQL["profile_correlations"] = WITH + " union all ".join(f"select * from (select '{a}' as col1, '{b}' as col2, round(abs(corr({a}, {b})), 3) as correlation, abs(corr({a}, {b})) as r from line)" for i, a in enumerate(LINE[:4]) for b in LINE[i + 1 : 4])
ORACLE_SQL["profile_correlations"] = WITH + "select col1, col2, correlation from (" + ORACLE_SQL["profile_correlations"].removeprefix(WITH) + ") order by r desc, col1, col2 limit 5"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")


QUERIES["rec_pass_rates"] = lambda spark, d: pass_rates(labelled(spark, d), "lang", "quality")
ORACLE_SQL["rec_pass_rates"] = "with r as (select coalesce(lang, '(null)') as grp, coalesce(quality = 1, false) as ok from documents join labels using (doc_id)) select coalesce(grp, '(all)') as grp, count(*) as total, count(*) filter (where ok) as passed, count(*) filter (where not ok) as failed, round(avg(ok::int), 4) as pass_rate from r group by grouping sets ((grp), ()) having count(*) > 0"
QUERIES["rec_timings"] = lambda spark, d: timings(table(spark, d, "events"), "event_type", "value")
ORACLE_SQL["rec_timings"] = "with r as (select coalesce(event_type, '(null)') as grp, list_sort(list(value)) as l, count(*) as n, avg(value) as m from events where value is not null group by 1), q as (select *, l[n // 2 + 1] as p50 from r) select grp, n, round(m, 3) as mean, round(p50, 3) as p50, round(case when n > 20 then l[floor(n * 0.95::double)::bigint + 1] else l[n] end, 3) as p95, round(l[n], 3) as max, len(list_filter(l, lambda x: x > 3 * p50)) as n_outliers from q"
QUERIES["rec_stratified_split"] = lambda spark, d: stratified_split(labelled(spark, d), "doc_id", "lang")
ORACLE_SQL["rec_stratified_split"] = "with r as (select doc_id, coalesce(lang, 'UNKNOWN') as lang from documents join labels using (doc_id)), p as (select *, row_number() over (partition by lang order by substr(md5(doc_id::varchar), 1, 12), doc_id) - 1 as k, count(*) over (partition by lang) as n from r) select doc_id, lang, case when n <= 2 or k < greatest(1, floor(n * 0.8::double)) then 'train' when k < greatest(1, floor(n * 0.8::double)) + floor(n * 0.1::double) then 'val' else 'test' end as split from p"
QUERIES["rec_prune_context"] = lambda spark, d: prune_context(table(spark, d, "conversations"), 1000, 4).select("conv_id", "turn", "role", "tokens", "kept")
ORACLE_SQL["rec_prune_context"] = "with r as (select *, coalesce(length(text), 0) // 4 as tokens, coalesce(role = 'system', false) as s from conversations), p as (select *, sum(case when s then 0 else 1 end) over w as k, sum(case when s then 0 else tokens end) over w as t, sum(case when s then tokens else 0 end) over (partition by conv_id) as st from r window w as (partition by conv_id order by turn desc, role, text rows unbounded preceding)) select conv_id, turn, role, tokens, s or (k <= 4 and (k <= 2 or st + t <= 1000)) as kept from p"
QUERIES["profile_quality_issues"] = lambda spark, d: quality_issues(table(spark, d, "customer").select("c_name", "c_nationkey", "c_mktsegment"))
ORACLE_SQL["profile_quality_issues"] = "select * from (select 'duplicate_rows' as issue, null::varchar as \"column\", coalesce(sum(n - 1), 0)::bigint as n from (select count(*) as n from customer group by c_name, c_nationkey, c_mktsegment) union all select 'unique_text', 'c_name', case when count(distinct c_name) = count(*) then count(*) else 0 end from customer union all select 'unique_text', 'c_mktsegment', case when count(distinct c_mktsegment) = count(*) then count(*) else 0 end from customer) where n > 0"

for _n, _s in statistic_queries.SQL.items():
    QUERIES[f"stat_{_n}"] = statistic_queries.without_tails(QUERIES[f"tpl_{_n}"])
    ORACLE_SQL[f"stat_{_n}"] = WITH + _s
QUERIES["stat_bootstrap_ci_discovered"] = lambda spark, d: QUERIES["tpl_bootstrap_ci_discovered"](spark, d).drop("ci_lower", "ci_upper", "std_error")
for _n, _s in statistic_queries.TAILED_SQL.items():
    ORACLE_SQL[_n] = WITH + _s
for _n, _s in statistic_queries.WHOLE_SQL.items():
    ORACLE_SQL[f"tpl_{_n}"] = WITH + _s

QUERIES["tpl_applicable"] = lambda spark, d: applicable(line(spark, d))
QUERIES["profile_index_columns"] = lambda spark, d: index_columns(table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("user_id").alias("my_id")))
ORACLE_SQL["profile_index_columns"] = """select unnest(['event_id', 'user_id', 'event_type', 'my_id']) as "column", unnest([true, true, false, true]) as index_like, unnest(['name', 'name', null, 'name']) as why"""
QUERIES["profile_index_sequence"] = lambda spark, d: index_columns(table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), "c_name"))
ORACLE_SQL["profile_index_sequence"] = """select unnest(['c', 'n', 'c_name']) as "column", unnest([q, false, false]) as index_like, unnest([case when q then 'sequence' end, null, null]) as why from (select min(c_custkey) in (0, 1) and max(c_custkey) - min(c_custkey) + 1 = count(*) and count(distinct c_custkey) = count(*) as q from customer)"""
QUERIES["profile_time_ranges"] = lambda spark, d: time_ranges(table(spark, d, "orders"))
ORACLE_SQL["profile_time_ranges"] = """select 'o_orderdate' as "column", min(o_orderdate)::timestamp as first, max(o_orderdate)::timestamp as last, date_diff('microsecond', min(o_orderdate), max(o_orderdate)) // 86400000000 as range_days from orders"""
QUERIES["tpl_traits"] = lambda spark, d: traits(line(spark, d))
ORACLE_SQL["tpl_traits"] = """select n_null > 0 as has_missing_numeric, case when n_null > 0 then 'l_quantity' else '' end as missing_numeric,
  case when abs(flags - 10) <= abs(states - 10) then 'l_returnflag' else 'l_linestatus' end as moderate_category, case when flags >= states then 'l_returnflag' else 'l_linestatus' end as many_values,
  case when flags <= states then 'l_returnflag' else 'l_linestatus' end as few_values
from (select count(*) filter (where l_quantity = 13) as n_null, count(distinct l_returnflag) as flags, count(distinct l_linestatus) as states from lineitem)"""
QUERIES["profile_shape"] = lambda spark, d: shape(table(spark, d, "lineitem"))
ORACLE_SQL["profile_shape"] = "select count(*) as n_rows, 11::bigint as n_columns from lineitem"
QUERIES["profile_head"] = lambda spark, d: head(table(spark, d, "nation"), ["n_nationkey"])
ORACLE_SQL["profile_head"] = """select row_number() over (order by n_nationkey) as place, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as row from nation order by n_nationkey limit 3"""
QUERIES["profile_value_summary"] = lambda spark, d: value_summary(table(spark, d, "nation"), ["n_nationkey"]).select("n_rows", "columns", F.size("head").cast("long").alias("n_head"))
ORACLE_SQL["profile_value_summary"] = "select count(*) as n_rows, 'n_nationkey: int; n_name: string; n_regionkey: int' as columns, 5::bigint as n_head from nation"



def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream into Parquet: the days that the watermark has closed."""
    folder = f"{shared_dir(spark)}/rates-{uuid.uuid4().hex}"
    stream = rates.read_stream(spark, f"{sf_dir}/events.parquet*").withColumn("success", F.col("event_type") != "error")
    rates.write_until_now(rates.windowed_rates(stream, "ts", "event_type"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


QUERIES["strm_event_rates"] = event_rates
ORACLE_SQL["strm_event_rates"] = """select d::timestamp as start, event_type as kind, count(*) as n, count(*) filter (where event_type = 'error') as errors, round(avg(value), 3) as mean
from (select date_trunc('day', ts) as d, * from events) where d + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2"""

QUERIES |= record_queries.QUERIES | user_queries.QUERIES
ORACLE_SQL |= record_queries.ORACLE_SQL | user_queries.ORACLE_SQL
