"""Summaries of records: pass rates, timing distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import average_ranks


def pass_rates(df: DataFrame, by: str, passed: str) -> DataFrame:
    """(grp, total, passed, failed, pass_rate) for each value of `by` and, as '(all)', for the whole table.

    A null in `passed` counts as failed; a null in `by` is the group '(null)'. An empty table has no groups.
    """
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("(null)")).alias("grp"), F.coalesce(F.col(passed).cast("boolean"), F.lit(False)).alias("ok"))
    sums = rows.rollup("grp").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed")).where("total > 0")
    return sums.select(F.coalesce("grp", F.lit("(all)")).alias("grp"), "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.round(F.col("passed") / F.col("total"), 4).alias("pass_rate"))


def timings(df: DataFrame, by: str, value: str) -> DataFrame:
    """(grp, n, mean, p50, p95, max, n_outliers) of the values that are not null; a null key is the group '(null)'.

    Percentiles are elements of the sorted values: number n // 2 and number int(0.95 n), counted from 0; with 20
    values or fewer the latter is the largest. Outliers exceed three times p50. Works on distinct values with counts,
    so that a frequent key is never sorted in one task.
    """
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("(null)")).alias("grp"), F.col(value).cast("double").alias("v"))
    ranks = average_ranks(rows, "v", "grp")
    def element(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("v")))

    middle, high = F.floor(F.col("total") / 2), F.when(F.col("total") > 20, F.floor(F.col("total") * 0.95)).otherwise(F.col("total") - 1)
    marks = ranks.groupBy("grp", "total").agg(element(middle).alias("p50"), element(high).alias("p95"), F.sum(F.col("v") * F.col("n")).alias("s"), F.max("v").alias("top"))
    beyond = ranks.join(marks.select("grp", "p50"), "grp").where("v > 3 * p50").groupBy("grp").agg(F.sum("n").alias("n_outliers"))
    return marks.join(beyond, "grp", "left").select(
        "grp", F.col("total").alias("n"), F.round(F.col("s") / F.col("total"), 3).alias("mean"), F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), F.round("top", 3).alias("max"), F.coalesce("n_outliers", F.lit(0)).alias("n_outliers")
    )
