"""Whether two result tables say the same: columns and rows in any order, numbers within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType

from ..functions.names import quoted
from ..functions.ordered import positioned
from .answers import FLOAT_TOLERANCE


def _is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType | BooleanType)


def _near(a: Column, b: Column, tolerance: float) -> Column:
    """Equal, both missing (null or NaN), or apart by tolerance and that share of b at most."""
    x, y = F.nanvl(a.cast("double"), F.lit(None).cast("double")), F.nanvl(b.cast("double"), F.lit(None).cast("double"))
    return x.eqNullSafe(y) | F.coalesce((F.abs(x - y) <= tolerance + tolerance * F.abs(y)) & (F.abs(y) < float("inf")), F.lit(False))


def tables_match(a: DataFrame, b: DataFrame, tolerance: float = FLOAT_TOLERANCE) -> DataFrame:
    """(matched, reason, rows_a, rows_b, different_rows, different_columns), always one row.

    Both tables take the order of their column names; rows are sorted by all columns and compared place by place, numbers
    (and truth values) with tolerance both absolute and relative to b, everything else exactly. Null and NaN are
    alike and stand first. reason is 'match', 'other columns', 'other number of rows' or 'other values';
    different_columns, sorted, are those with a value too far away. Rows are numbered by ranges and joined by place, so neither
    table meets in one task, and nothing but counts comes together. Two empty tables with equal columns match.

    Columns that hold maps cannot be ordered and are refused.
    """
    names = sorted(a.columns)
    if names != sorted(b.columns) or len(set(names)) < len(names):
        one = a.sparkSession.range(1)
        return one.select(F.lit(False).alias("matched"), F.lit("other columns").alias("reason"), *(F.lit(None).cast("long").alias(c) for c in ("rows_a", "rows_b", "different_rows")), F.lit(None).cast("array<string>").alias("different_columns"))
    numbers = [_is_number(a.schema[c].dataType) and _is_number(b.schema[c].dataType) for c in names]

    def side(df: DataFrame, mark: str) -> DataFrame:
        values = []
        for i, (c, number) in enumerate(zip(names, numbers, strict=True)):
            x = df[quoted(c)]
            values.append((F.nanvl(x.cast("double"), F.lit(None).cast("double")) if number else x).alias(f"{mark}{i}"))
        rows = df.select(*values)
        return positioned(rows, [F.col(f"{mark}{i}") for i in range(len(names))], "_idx").withColumn(f"_{mark}", F.lit(1))

    both = side(a, "a").join(side(b, "b"), "_idx", "full")
    same = [_near(F.col(f"a{i}"), F.col(f"b{i}"), tolerance) if number else F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) if a.schema[c].dataType == b.schema[c].dataType else F.col(f"a{i}").cast("string").eqNullSafe(F.col(f"b{i}").cast("string")) for i, (c, number) in enumerate(zip(names, numbers, strict=True))]
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    all_same = F.forall(F.array(*same), lambda x: x) if same else F.lit(True)
    counts = both.agg(
        F.count("_a").alias("rows_a"),
        F.count("_b").alias("rows_b"),
        F.count_if(~(whole & all_same)).alias("different_rows"),
        *(F.count_if(whole & ~ok).alias(f"n{i}") for i, ok in enumerate(same)),
    )
    other = F.filter(F.array(*(F.when(F.col(f"n{i}") > 0, F.lit(c)) for i, c in enumerate(names))), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    reason = F.when(F.col("rows_a") != F.col("rows_b"), "other number of rows").when(F.col("different_rows") > 0, "other values").otherwise("match")
    return counts.select((reason == "match").alias("matched"), reason.alias("reason"), "rows_a", "rows_b", "different_rows", other.alias("different_columns"))
