"""Tests and regressions without the columns that hang on a distribution's tail, so that SQL can ask the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .functions import tails

#: Columns that come from tail probabilities.
TAILS = ("significance_score", "significant", "independent", "variances_equal", "is_normal", "p_value", "interpretation")

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]
_WIDE = "(unpivot line on l_quantity, l_extendedprice, l_discount, l_tax into name name value v)"
_SKEWED = f"(select name from {_WIDE} group by 1 order by abs(skewness(v)) desc, 1 limit 1)"
_EVEN = f"(select name from {_WIDE} group by 1 order by abs(skewness(v)), 1 limit 1)"
_NAMES = lambda a, b: ",".join(sorted((a, b)))


def _two(target: str, stat: str) -> str:
    """One row: name, size, mean and variance of the two line states, and a statistic of each."""
    per = f"(select l_linestatus as g, count(v) as n, avg(v) as m, var_samp(v) as s, {stat} as x from {_WIDE} where name = {target} group by 1)"
    return f"(select min(g) as g1, max(g) as g2, arg_min(n, g) as n1, arg_max(n, g) as n2, arg_min(m, g) as m1, arg_max(m, g) as m2, arg_min(s, g) as s1, arg_max(s, g) as s2, arg_min(x, g) as x1, arg_max(x, g) as x2 from {per})"


def _anova(rows: str) -> str:
    """One row (f, eta) of rows(g, v)."""
    per = f"(select g, count(v) as n, avg(v) as m, coalesce(var_samp(v), 0) as s from {rows} group by 1)"
    sums = f"(select count(*) as k, sum(n) as n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) as b, sum((n - 1) * s) as w from {per})"
    return f"(select (b / (k - 1)) / (w / (n - k)) as f, b / (b + w) as eta from {sums})"


def _u(target: str) -> str:
    ranked = f"(select l_linestatus as g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from {_WIDE} where name = {target} and v is not null)"
    return f"(select sum(r) filter (where g = (select min(l_linestatus) from line)) - count(*) filter (where g = (select min(l_linestatus) from line)) * (count(*) filter (where g = (select min(l_linestatus) from line)) + 1) / 2.0 as u from {ranked})"


def _levene(by: str, target: str) -> str:
    return _anova(f"(select {by} as g, abs({target} - median({target}) over (partition by {by})) as v from line where {target} is not null)")


_PAIR_CORR = " union all ".join(f"select {i} as i, '{a}' as a, '{b}' as b, abs(corr({a}, {b})) as r from line where {a} is not null and {b} is not null" for i, (a, b) in enumerate(PAIRS))
_CLEAN = " union all ".join(
    f"select {i} as i, '{_NAMES(a, b)}' as columns, corr({a}, {b}) as r, count(*) - count(*) filter (where ok) as gone, corr({a}, {b}) filter (where ok) as clean from (select *, coalesce(abs({a} - avg({a}) over ()) <= 3 * stddev_samp({a}) over () and abs({b} - avg({b}) over ()) <= 3 * stddev_samp({b}) over (), false) as ok from line)"
    for i, (a, b) in enumerate(PAIRS)
)
_RANKS = " union all ".join(f"select '{_NAMES(a, b)}' as columns, '{a}' as a, '{b}' as b, corr(x, y) as rho from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as y from line where {a} is not null and {b} is not null)" for a, b in PAIRS)
_FIT = lambda y: " union all ".join(f"select {i} as i, '{y}' as target, '{x}' as best_predictor, abs(corr({x}, {y})) as r, regr_r2({y}, {x}) as r2, regr_slope({y}, {x}) as b from line" for i, x in enumerate(c for c in COLUMNS if c != y))
_FITTED = lambda y: f"select target, best_predictor, round(r, 3) as association_score, round(r2, 3) as fit_score, round(b, 3) as coefficient from ({_FIT(y)}) order by r desc, i limit 1"
_T = "(m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))"
_CDF = "case when z >= 0 then 1 - t * exp(-z * z / 2) / sqrt(2 * pi()) else t * exp(-z * z / 2) / sqrt(2 * pi()) end"
_POLY = "k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))"

TTEST = f"select 'l_extendedprice' as target_column, 'l_linestatus' as grouping_column, g1 as group1, g2 as group2, round(m1, 3) as mean1, round(m2, 3) as mean2, round({_T}, 3) as test_statistic from {_two(chr(39) + 'l_extendedprice' + chr(39), 'avg(v)')}"

SQL: dict[str, str] = {
    "ttest_discovered_groups": TTEST,
    "ttest_in_table_order": TTEST,
    "mann_whitney_u_test": f"select {_SKEWED} as target_column, 'l_linestatus' as grouping_column, g1 as group1, g2 as group2, round(x1, 3) as median1, round(x2, 3) as median2, round(u, 3) as test_statistic from {_two(_SKEWED, 'median(v)')}, {_u(_SKEWED)}",
    "anova_discovered_groups": f"""select 'l_extendedprice' as target_column, 'l_returnflag' as grouping_column, n_groups, round(f, 3) as test_statistic, best_group, round(best, 3) as best_mean, worst_group, round(worst, 3) as worst_mean, round(eta, 4) as effect_size
      from {_anova("(select l_returnflag as g, l_extendedprice as v from line)")}, (select count(*) as n_groups, arg_max(g, m) as best_group, max(m) as best, arg_min(g, m) as worst_group, min(m) as worst from (select l_returnflag as g, avg(l_extendedprice) as m from line group by 1))""",
    "chi_squared_independence": """select 'l_returnflag' as column1, 'l_linestatus' as column2, round(sum((o - e) * (o - e) / e), 3) as test_statistic, 2::bigint as df, round(min(e), 3) as expected_min
      from (select coalesce(o, 0) as o, na * nb / n as e from (select l_returnflag as a, count(*) as na from line group by 1) x cross join (select l_linestatus as b, count(*) as nb from line group by 1) y cross join (select count(*) as n from line) z left join (select l_returnflag as a, l_linestatus as b, count(*) as o from line group by 1, 2) w on w.a = x.a and w.b = y.b)""",
    "levene_variance_test": f"""select 'l_extendedprice' as target_column, 'l_returnflag' as grouping_column, n_groups, round(f, 3) as test_statistic, group_variances from {_levene("l_returnflag", "l_extendedprice")},
      (select count(*) as n_groups, string_agg(g || '=' || format('{{:.3f}}', s), ',' order by g) as group_variances from (select l_returnflag as g, round(var_samp(l_extendedprice), 3) as s from line group by 1))""",
    "spearman_rank_correlation": f"select columns, round(rho, 3) + 0.0 as association_score from ({_RANKS}) order by abs(rho) desc, a, b limit 1",
    "regression_most_predictive": _FITTED("l_extendedprice"),
    "correlation_after_outlier_removal": f"select columns, round(c.r, 3) as original_association, gone as outliers_removed, round(clean, 3) as clean_association from ({_CLEAN}) c join ({_PAIR_CORR}) p using (i) order by p.r desc, i limit 1",
    "bootstrap_ci_discovered": f"select {_SKEWED} as \"column\", round(abs(skewness(v)), 2) as skewness, round(avg(v), 2) as mean, 1000::bigint as n_iterations from {_WIDE} where name = {_SKEWED}",
    "ks_normality_test": f"""select {_EVEN} as "column", round(max(greatest((below + n) / total - f, f - below / total)), 2) as test_statistic, round(any_value(m), 2) as sample_mean, round(any_value(s), 2) as sample_std from (
      select *, {_CDF} as f from (select *, {_POLY} as t from (select *, 1 / (1 + 0.2316419 * abs(z)) as k from (select *, (v - m) / s as z from (
        select v, count(*) as n, sum(count(*)) over (order by v) - count(*) as below, sum(count(*)) over () as total from {_WIDE} where name = {_EVEN} and v is not null group by 1), (select avg(v) as m, stddev_samp(v) as s from {_WIDE} where name = {_EVEN})))))""",
    "adaptive_two_sample_test": f"select {_EVEN} as target_column, 'l_linestatus' as grouping_column, g1 as group1, g2 as group2, 'rank_based' as method_choice, 'rank_based' as effect_size_kind, round(1 - 2 * u / (n1 * n2), 2) + 0.0 as effect_size, false as assumptions_passed from {_two(_EVEN, 'avg(v)')}, {_u(_EVEN)}",
}

#: Analyses without tail columns, whole in SQL.
WHOLE_SQL: dict[str, str] = {
    "conditional_normality": "select 'l_extendedprice' as \"column\", 'non-normal' as distribution, null::double as mean, null::double as std, round(median(l_extendedprice), 3) as median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 3) as iqr from line",
    "correlation_change_analysis": "select 'l_extendedprice,l_quantity' as columns, round(o, 3) as original_association, round(l, 3) as log_association, round(abs(l) - abs(o), 3) as improvement, abs(l) > abs(o) as transformation_helpful from (select corr(l_quantity, l_extendedprice) as o, corr(ln(l_quantity - (select min(l_quantity) from lineitem) + 2), ln(l_extendedprice - (select min(l_extendedprice) from lineitem) + 2)) as l from lineitem)",
    "quantile_bin_best_mean": f"""select b as binning_column, c as target_column, arg_max(nm, struct_pack(m := m, p := -bin)) as best_bin, round(max(m), 2) as best_bin_mean, string_agg(nm || ': ' || round(m, 2)::varchar, '; ' order by bin) as bin_means from (
      select b, c, bin, avg(y) as m, any_value('(' || regexp_replace(format('{{:.3f}}', e[bin] - case when bin = 1 then 0.001 else 0 end), '0{{1,2}}$', '') || ', ' || regexp_replace(format('{{:.3f}}', e[bin + 1]), '0{{1,2}}$', '') || ']') as nm from (
        select *, greatest(len(list_filter(e, lambda q: q < x)), 1) as bin from (
          select b, c, case b {" ".join(f"when '{k}' then {k}" for k in COLUMNS)} end as x, case c {" ".join(f"when '{k}' then {k}" for k in COLUMNS)} end as y, (select list_sort(list_distinct(quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]))) from {_WIDE} where name = b) as e
          from line, (select {_SKEWED} as b, (select name from {_WIDE} where name <> {_SKEWED} group by 1 order by var_samp(v) desc limit 1) as c)) where x is not null) group by 1, 2, 3) group by 1, 2""",
    "segment_then_analyze_outliers": """select 'l_returnflag' as category_column, 'l_extendedprice' as target_column, g as best_category, count(*) as segment_size, round(avg(v), 3) as segment_mean, count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as segment_outliers, round((count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))) / count(*), 4) as outlier_rate
      from (select l_returnflag as g, l_extendedprice as v, quantile_cont(l_extendedprice, 0.25) over (partition by l_returnflag) as q1, quantile_cont(l_extendedprice, 0.75) over (partition by l_returnflag) as q3 from line) where g = (select l_returnflag from line group by 1 order by avg(l_extendedprice) desc, 1 limit 1) group by 1, 2, 3""".replace(" group by 1, 2, 3", " group by g"),
    "max_std_mean": f"select round(avg(v), 3) as answer from {_WIDE} where name = (select name from {_WIDE} group by 1 order by stddev_samp(v) desc limit 1)",
    "max_variance_mean_without_top": f"select round(avg(v), 3) as answer from {_WIDE} where name = (select name from {_WIDE} group by 1 order by var_samp(v) desc limit 1 offset 1)",
    "min_mean_std_without_top": f"select round(stddev_samp(v), 3) as answer from {_WIDE} where name = (select name from {_WIDE} where name <> (select name from {_WIDE} group by 1 order by var_samp(v) desc limit 1) group by 1 order by avg(v) limit 1)",
    "min_mean_std_without_first": f"select round(stddev_samp(v), 3) as answer from {_WIDE} where name = (select name from {_WIDE} where name <> 'l_quantity' group by 1 order by avg(v) limit 1)",
    "outlier_columns_quartiles": f"select (count(*) filter (where k > 0))::bigint as columns_with_outliers, sum(k)::bigint as total_outliers from (select name, count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as k from (select name, v, quantile_cont(v, 0.25) over (partition by name) as q1, quantile_cont(v, 0.75) over (partition by name) as q3 from {_WIDE}) group by 1)",
    "high_missing_columns_ten": "select (count(*) filter (where m > 1))::bigint as count, coalesce(string_agg(c, ',' order by c) filter (where m > 1), '') as columns from (select 'l_quantity' as c, avg((l_quantity is null)::int) * 100 as m from line)",
}
for _n, _s, _o in (("outlier_columns_z2", "stddev_samp", ">"), ("outlier_columns_reaching", "stddev_samp", ">="), ("outlier_columns_population", "stddev_pop", ">")):
    WHOLE_SQL[_n] = f"select (count(*) filter (where k > 0))::bigint as columns_with_outliers, sum(k)::bigint as total_outliers from (select name, count(*) filter (where s > 0 and abs(v - m) {_o} 1.5 * s) as k from (select name, v, avg(v) over (partition by name) as m, {_s}(v) over (partition by name) as s from {_WIDE}) group by 1)"
for _n, _k in (("strongest_correlation_without_top", "desc"), ("weakest_correlation_without_top", "")):
    _left = [(a, b) for a, b in PAIRS if "l_extendedprice" not in (a, b)]
    WHOLE_SQL[_n] = "select columns, round(r, 2) as association_score from (" + " union all ".join(f"select {i} as i, '{_NAMES(a, b)}' as columns, abs(corr({a}, {b})) as r from line" for i, (a, b) in enumerate(_left)) + f") order by r {_k}, i limit 1"


_STEPS = 2000


def _simpson(f: str, x: str) -> str:
    """The integral of f(q) from 0 to |x|, by Simpson's rule; no other name in f may hold a q."""
    weight = f"case when i in (0, {_STEPS}) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(abs({x}) / {3 * _STEPS} * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: ({weight}) * {f.replace('q', f'(i * abs({x}) / {_STEPS})')})))"


def t_tail(t: str, d: str) -> str:
    """The two-sided tail of Student's distribution, by integration."""
    return f"greatest(0, 1 - 2 * exp(lgamma(({d} + 1) / 2.0) - lgamma({d} / 2.0)) / sqrt({d} * pi()) * {_simpson(f'pow(1 + q * q / {d}, -({d} + 1) / 2.0)', t)})"


def normal_tail(z: str) -> str:
    return f"greatest(0, 1 - sqrt(2 / pi()) * {_simpson('exp(-q * q / 2)', z)})"


_CV = f"(select name from {_WIDE} group by 1 order by stddev_samp(v) / abs(avg(v)) desc limit 1)"
_NQ, _NP = "(select count(l_quantity) from line)", "(select count(*) from line)"
_F3 = lambda f, n: f"pow(1 + 2 * {f} / ({n} - 3), -({n} - 3) / 2.0)"  # noqa: E731  three groups: two degrees of freedom


def _ttest(target: str) -> str:
    tested = f"(select *, {_T} as t, (n1 + n2 - 2)::double as d from {_two(target, 'avg(v)')})"
    p = f"(select *, {t_tail('t', 'd')} as p from {tested})"
    return f"select {target} as target_column, 'l_linestatus' as grouping_column, g1 as group1, g2 as group2, round(m1, 3) as mean1, round(m2, 3) as mean2, round(t, 3) as test_statistic, round(p, 4) as significance_score, p < 0.05 as significant from {p}"


def _regression(y: str) -> str:
    fits = " union all ".join(f"select {i} as i, '{b}' as target, '{a}' as best_predictor, abs(corr({a}, {b})) as r, regr_r2({b}, {a}) as r2, regr_slope({b}, {a}) as b, regr_count({b}, {a})::double as n from line" for b in COLUMNS for i, a in enumerate(c for c in COLUMNS if c != b))
    best = f"(select *, r * sqrt(n - 2) / sqrt(1 - r2) as t, n - 2 as d from ({fits}) where target = {y} order by r desc, i limit 1)"
    return f"select target, best_predictor, round(r, 3) as association_score, round(r2, 3) as fit_score, round(b, 3) as coefficient, round({t_tail('t', 'd')}, 4) as significance_score from {best}"


def _mwu(target: str) -> str:
    """One row of _two with u, and the two-sided p of its normal approximation with ties and continuity."""
    ties = f"(select sum(c * c * c - c) from (select count(*)::double as c from {_WIDE} where name = {target} and v is not null group by v))"
    spread = f"sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - {ties} / ((n1 + n2) * (n1 + n2 - 1.0))))"
    scored = f"(select *, greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / {spread} as z from {_two(target, 'median(v)')}, {_u(target)})"
    return f"(select *, {normal_tail('z')} as p from {scored})"


_SPEARMAN = " union all ".join(f"select '{_NAMES(a, b)}' as columns, '{a}' as a, '{b}' as b, corr(x, y) as rho, count(*)::double as n from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as y from line where {a} is not null and {b} is not null)" for a, b in PAIRS)
_QTY_U = _u("'l_quantity'")

#: Analyses with their tails, whole in SQL.
TAILED_SQL: dict[str, str] = {
    "tpl_ttest_discovered_groups": _ttest("'l_extendedprice'"),
    "tpl_ttest_in_table_order": _ttest("'l_extendedprice'"),
    "tpl_ttest_by_cv": _ttest(_CV),
    "tpl_regression_most_predictive": _regression("'l_extendedprice'"),
    "tpl_regression_by_cv": _regression(_CV),
    "tpl_anova_discovered_groups": f"select a.* exclude (f), round(p, 4) as significance_score, p < 0.05 as significant from (select *, {_F3('f', _NP)} as p from ({SQL['anova_discovered_groups'].replace('round(f, 3) as test_statistic', 'round(f, 3) as test_statistic, f')})) b, lateral (select b.* exclude (p)) a",
    "tpl_chi_squared_independence": f"select column1, column2, round(x, 3) as test_statistic, round(exp(-x / 2), 4) as significance_score, df, expected_min, exp(-x / 2) >= 0.05 as independent from ({SQL['chi_squared_independence'].replace('round(sum((o - e) * (o - e) / e), 3) as test_statistic', 'sum((o - e) * (o - e) / e) as x')})",
    "tpl_levene_variance_test": f"select target_column, grouping_column, n_groups, round(f, 3) as test_statistic, round(p, 4) as significance_score, p > 0.05 as variances_equal, group_variances from (select *, {_F3('f', _NP)} as p from ({SQL['levene_variance_test'].replace('round(f, 3) as test_statistic', 'f')}))",
    "tpl_mann_whitney_u_test": f"select {_SKEWED} as target_column, 'l_linestatus' as grouping_column, g1 as group1, g2 as group2, round(x1, 3) as median1, round(x2, 3) as median2, round(u, 3) as test_statistic, round(p, 4) as significance_score from {_mwu(_SKEWED)}",
    "tpl_spearman_rank_correlation": f"select columns, round(rho, 3) + 0.0 as association_score, round({t_tail('t', 'd')}, 4) as significance_score, case when abs(rho) >= 0.7 then 'strong' when abs(rho) >= 0.4 then 'moderate' when abs(rho) >= 0.2 then 'weak' else 'negligible' end as interpretation from (select *, rho * sqrt(n - 2) / sqrt(1 - rho * rho) as t, n - 2 as d from ({_SPEARMAN}) order by abs(rho) desc, a, b limit 1)",
    "tpl_correlation_after_outlier_removal": SQL["correlation_after_outlier_removal"],
    "tpl_adaptive_two_sample_test": f"select {_EVEN} as target_column, 'l_linestatus' as grouping_column, g1 as group1, g2 as group2, 'rank_based' as method_choice, round(p, 4) as significance_score, 'rank_based' as effect_size_kind, round(1 - 2 * u / (n1 * n2), 2) + 0.0 as effect_size, p < 0.05 as significant, false as assumptions_passed from {_mwu(_EVEN)}",
    "tpl_ks_normality_test": f"select \"column\", round(d, 2) as test_statistic, round(p, 4) as significance_score, p >= 0.05 as is_normal, sample_mean, sample_std from (select *, least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * d * d * n))))) as p from ({SQL['ks_normality_test'].replace('round(max(greatest((below + n) / total - f, f - below / total)), 2) as test_statistic', 'max(greatest((below + n) / total - f, f - below / total)) as d, any_value(total) as n')}))",
    "tpl_iqr_outliers_by_cv": f"""select name as "column", round(q1, 3) as q1, round(q3, 3) as q3, round(q3 - q1, 3) as iqr, round(q1 - 1.5 * (q3 - q1), 3) as lower_fence, round(q3 + 1.5 * (q3 - q1), 3) as upper_fence, count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers
      from (select *, quantile_cont(v, 0.25) over () as q1, quantile_cont(v, 0.75) over () as q3 from {_WIDE} where name = {_CV}) group by name, q1, q3""",
    "tpl_summary_by_cv": f"""select any_value(name) as "column", count(v) as count, round(avg(v), 3) as mean, round(stddev_samp(v), 3) as std, round(min(v), 3) as min, round(max(v), 3) as max, round(skewness(v), 3) + 0.0 as skewness, round(kurtosis(v), 3) as kurtosis, round(median(v), 3) as median from {_WIDE} where name = {_CV}""",
    "proc_levene_p": f"select round(f, 3) as statistic, round({_F3('f', _NQ)}, 3) as p_value from {_levene('l_returnflag', 'l_quantity')}",
    "proc_ttest_ind": f"select 'mwu' as test, round(u, 3) as stat, round(p, 3) as p_value from {_mwu(chr(39) + 'l_quantity' + chr(39))}",
}


def _ratio(parts: tuple, x: str) -> str:
    top, below = (reduce(lambda acc, k: f"({acc} * ({x}) + {k!r})", c[1:], repr(c[0])) for c in parts)
    return f"({top} / {below})"


def normal_score(p: str) -> str:
    """The standard normal's quantile of p, by the same rational functions as tails.normal_quantiles."""
    far = f"sqrt(-ln(least({p}, 1 - {p})))"
    outer = f"case when {far} <= 5 then {_ratio(tails._TAILS, f'{far} - 1.6')} else {_ratio(tails._FAR, f'{far} - 5')} end"
    return f"(case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {_ratio(tails._MIDDLE, f'0.180625 - ({p} - 0.5) * ({p} - 0.5)')} else sign({p} - 0.5) * ({outer}) end)"


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    return "(" + " + ".join(f"{k!r} * pow({x}, {i})" for i, k in enumerate(coefficients)) + ")"


def _shapiro(target: str) -> str:
    """One row (w, p) of Shapiro-Wilk over more than eleven values that are not all the same."""
    ranked = f"(select {target} as v, row_number() over (order by {target}) as i, count(*) over ()::double as n, avg({target}) over () as mean from line where {target} is not null)"
    scored = f"(select *, {normal_score('c')} as m from (select *, (i - 0.375) / (n + 0.25) as c from {ranked}))"
    sums = f"(select any_value(n) as n, sum(m * m) as mm, sum(m * (v - mean)) as mx, sum((v - mean) * (v - mean)) as xx, max(m) as m1, max(m) filter (where i = n - 1) as m2, max(v) - min(v) as ends, max(v) filter (where i = n - 1) - max(v) filter (where i = 2) as inner_ends, 1 / sqrt(any_value(n)) as u from {scored})"
    weights = f"(select *, m1 / sqrt(mm) + {_poly((0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), 'u')} as a1, m2 / sqrt(mm) + {_poly((0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), 'u')} as a2 from {sums})"
    w = f"(select n, least(1, pow((mx - m1 * ends - m2 * inner_ends) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * ends + a2 * inner_ends, 2) / xx) as w from {weights})"
    z = f"(select w, (ln(greatest(1e-300, 1 - w)) - {_poly((-1.5861, -0.31082, -0.083751, 0.0038915), 'ln(n)')}) / exp({_poly((-0.4803, -0.082676, 0.0030302), 'ln(n)')}) as z from {w})"
    return f"(select w, case when z > 0 then {normal_tail('z')} / 2 else 1 - {normal_tail('z')} / 2 end as p from {z})"


_LEVENE_TWO = f"(select {t_tail('t', 'd')} as pl from (select sqrt(f) as t, ({_NQ} - 2)::double as d from {_levene('l_linestatus', 'l_quantity')}))"
TAILED_SQL |= {
    "proc_shapiro_p": f"select round(w, 3) as statistic, round(p, 3) as p_value from {_shapiro('l_quantity')}",
    "proc_choose_test": f"select case when p > 0.05 and pl > 0.05 then 'ttest' else 'mwu' end as chosen_test from {_shapiro('l_quantity')}, {_LEVENE_TWO}",
}


def without_tails(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.drop(*(c for c in TAILS if c in df.columns))

    return f
