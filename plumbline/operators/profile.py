"""A table's profile: one row a column, from one aggregate over the whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col, missing_nan, quoted
from ..functions.ordered import average_ranks, quantiles_of
from ..functions.stats import corr
from .catalog import ID_NAME, NUMERIC, adjusted_skew


#: How many values a column must have more than to be an index by its sequence.
INDEX_ROWS = 10


def _kind(t: str) -> str:
    return "numeric" if t in NUMERIC else "datetime" if t in ("timestamp", "timestamp_ntz", "date") else "categorical"


def column_profile(df: DataFrame) -> DataFrame:
    """(column, kind, missing_count, missing_pct, unique_count, mean, std, min, q25, median, q75, max, skew).

    Statistics of columns that aren't numeric are null; so are those that too few values leave undefined. NaN is missing.
    One aggregate has what adds up; numbers of values and quarters come from the different values of all columns with their
    frequencies, numeric ones ranked, so nothing is counted distinct column by column.
    """
    df = missing_nan(df)
    fields = []
    for i, (c, t) in enumerate(df.dtypes):
        number = t in NUMERIC
        x = col(c).cast("double") if number else F.lit(None).cast("double")
        skew = F.round(adjusted_skew(quoted(c)), 3) if number else F.lit(None).cast("double")
        stats = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        missing = col(c).isNull()
        counts = [F.count_if(missing).alias("missing_count"), F.round(F.avg(missing.cast("int")) * 100, 2).alias("missing_pct")]
        fields.append(F.struct(F.lit(c).alias("column"), F.lit(_kind(t)).alias("kind"), *counts, *[F.round(f, 3).alias(k) for k, f in stats.items()], skew.alias("skew")).alias(f"c{i}"))
    told = df.agg(*fields).select(F.explode(F.array(*[f"c{i}" for i in range(len(fields))])).alias("p")).select("p.*")

    def each(names: list[str], value: Callable[[str], Column]) -> DataFrame:
        """(c, v): a row a value of these columns."""
        cells = F.array(*(F.struct(F.lit(c).alias("c"), value(c).alias("v")) for c in names))
        return df.select(F.inline(cells)).where("v is not null")

    quarters = ("q25", "median", "q75")
    numbers = [c for c, t in df.dtypes if t in NUMERIC]
    others = [(c, t) for c, t in df.dtypes if t not in NUMERIC]
    parts = []
    if numbers:
        ranks = average_ranks(each(numbers, lambda c: col(c).cast("double")), "v", "c")
        q = quantiles_of(ranks, "v", [0.25, 0.5, 0.75], "c", F.count("*").alias("unique_count"))
        parts.append(q.select("c", "unique_count", *(F.round(F.col("q")[i], 3).alias(k) for i, k in enumerate(quarters))))
    if others:
        simple = ("string", "date", "timestamp", "timestamp_ntz", "boolean")
        kinds = dict(others)
        text = lambda c: col(c).cast("string") if kinds[c] in simple else F.when(col(c).isNotNull(), F.to_json(F.struct(col(c).alias("v"))))
        found = each(list(kinds), text).distinct().groupBy("c").agg(F.count("*").alias("unique_count"))
        parts.append(found.select("c", "unique_count", *(F.lit(None).cast("double").alias(k) for k in quarters)))
    more = reduce(DataFrame.unionAll, parts)  # a row a column
    out = told.join(F.broadcast(more), F.col("column") == F.col("c"), "left")
    names = ("column", "kind", "missing_count", "missing_pct", "unique_count", "mean", "std", "min", *quarters, "max", "skew")
    return out.withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("long"))).select(*names)


def index_columns(df: DataFrame) -> DataFrame:
    """(column, index_like, why): by name ('name'), or as whole numbers 0 or 1 to n, each once, over more than INDEX_ROWS rows
    ('sequence'); why is null for the others."""
    cells = []
    for i, (c, t) in enumerate(df.dtypes):
        x = col(c)
        whole = t in NUMERIC
        steps = F.coalesce((F.count("*") > INDEX_ROWS) & (F.count(x) == F.count("*")) & F.min(x).isin(0, 1) & (F.max(x) - F.min(x) + 1 == F.count(x)) & (F.count_distinct(x) == F.count(x)), F.lit(False)) if whole else F.lit(False)
        why = F.when(F.lit(bool(ID_NAME.match(c))), "name").when(steps, "sequence")
        cells.append(F.struct(F.lit(c).alias("column"), why.isNotNull().alias("index_like"), why.alias("why")).alias(f"c{i}"))
    return df.agg(*cells).select(F.explode(F.array(*[f"c{i}" for i in range(len(cells))])).alias("p")).select("p.*")


def time_ranges(df: DataFrame) -> DataFrame:
    """(column, first, last, range_days) of timestamp and date columns; whole days, null without values."""
    names = [c for c, t in df.dtypes if _kind(t) == "datetime"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, first timestamp, last timestamp, range_days long")
    cells = [F.struct(F.lit(c).alias("column"), F.min(col(c).cast("timestamp")).alias("first"), F.max(col(c).cast("timestamp")).alias("last")).alias(f"c{i}") for i, c in enumerate(names)]
    rows = df.agg(*cells).select(F.explode(F.array(*[f"c{i}" for i in range(len(names))])).alias("p")).select("p.*")
    return rows.withColumn("range_days", F.floor((F.unix_micros("last") - F.unix_micros("first")) / 86_400_000_000))


def shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"))


def head(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows by `order` as JSON: (place, row)."""
    rows = df.orderBy(*order).limit(n)
    return rows.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), F.to_json(F.struct(*(col(c).alias(c) for c in df.columns))).alias("row"))  # n rows


def value_summary(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """One row that says what a table holds without holding it: n_rows, columns ('name: type'), the first n rows as JSON, and
    mean, min and max of its first five numeric columns as JSON."""
    numbers = [c for c, t in df.dtypes if t in NUMERIC][:5]
    stats = F.to_json(F.struct(*(F.struct(F.round(F.avg(col(c)), 3).alias("mean"), F.min(col(c)).alias("min"), F.max(col(c)).alias("max")).alias(c) for c in numbers))) if numbers else F.lit("{}")
    one = df.agg(F.count("*").alias("n_rows"), stats.alias("numbers"))
    first = head(df, order, n).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("head"))
    return one.crossJoin(first).select("n_rows", F.lit("; ".join(f"{c}: {t}" for c, t in df.dtypes)).alias("columns"), "head", "numbers")  # one row each


def overview(df: DataFrame, order: list[str]) -> str:
    """A table in words: shape, types, first rows, statistics, missing values, frequent values. As long as it has columns."""
    s, sums = value_summary(df, order).first(), column_profile(df).collect()
    lines = [f"{s['n_rows']} rows, {len(df.columns)} columns", *(f"  {c}" for c in s["columns"].split("; ")), "First rows:", *(f"  {r}" for r in s["head"]), "Numbers:"]
    lines += [f"  {r['column']}: mean {r['mean']}, std {r['std']}, min {r['min']}, quarters {r['q25']} {r['median']} {r['q75']}, max {r['max']}" for r in sums if r["kind"] == "numeric"]
    lines += ["Missing:", *(f"  {r['column']}: {r['missing_count']} ({r['missing_pct']} %)" for r in sums if r["missing_count"])]
    lines += ["Frequent values:", *(f"  {r['column']}: {r['value']} ({r['count']})" for r in top_values(df, 10).orderBy("column", "place").collect())]
    return "\n".join(lines)


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, value, count, place): the k most frequent values of each text column, nulls left out; ties go by value."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, place long")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in names])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null").groupBy("column", "value").count()
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def strongest_correlations(df: DataFrame, k: int = 5) -> DataFrame:
    """(col1, col2, correlation): the k pairs of numeric columns with the largest absolute Pearson correlation, from one
    aggregate over the table. A pair counts the rows where both are present; undefined correlations are left out."""
    names = [c for c, t in df.dtypes if t in NUMERIC]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, correlation double")
    cells = [F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.abs(corr(a, b)).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    rows = df.agg(*cells).select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    return rows.where("r is not null and not isnan(r)").orderBy(F.desc("r"), "col1", "col2").limit(k).select("col1", "col2", F.round("r", 3).alias("correlation"))


def quality_issues(df: DataFrame) -> DataFrame:
    """(issue, column, n): 'duplicate_rows' with the rows that repeat an earlier one, 'empty_column' with its nulls,
    'unique_text' for text columns whose values all differ, with their number. Issues that don't occur have no row."""
    whole = df.groupBy(*map(col, df.columns)).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_rows").alias("issue"), F.lit(None).cast("string").alias("column"), "n")
    cells = []
    for i, (c, t) in enumerate(df.dtypes):
        unique = F.count_distinct(col(c)) if t == "string" else F.lit(-1).cast("long")
        cells.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(col(c)).alias("present"), unique.alias("distinct")).alias(f"c{i}"))
    told = df.agg(*cells).select(F.explode(F.array(*[f"c{i}" for i in range(len(cells))])).alias("x")).select("x.*").where("rows > 0")
    empty = told.where("present = 0").select(F.lit("empty_column").alias("issue"), "column", F.col("rows").alias("n"))
    unique = told.where("distinct = rows").select(F.lit("unique_text").alias("issue"), "column", F.col("rows").alias("n"))
    return whole.where("n > 0").unionAll(empty).unionAll(unique)
