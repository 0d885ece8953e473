"""CSV tables with missing-value markers and all-or-nothing coercion of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col, quoted
from .csv_blocks import records

# Texts that stand for a missing value.
MISSING = ("", "?", "NA", "N/A", "na", "n/a", "nan", "NaN", "null", "NULL", "None")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A CSV with header; MISSING becomes null, and text columns are coerced.

    Fields may hold quotes (doubled), commas and line breaks inside quotes. Without a given encoding it is UTF-8, or
    Latin-1 if some line is no valid UTF-8. Files are cut into blocks whatever they hold (see csv_blocks); each file's
    header is left out, and the first file's names the columns. Rows with too few fields are filled with nulls, fields too
    many go.
    """
    found, broken_lines, encoding = records(spark, path, encoding)
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if not broken_lines:
        return coerce(spark.read.options(**options, header=True, encoding=encoding).csv(path))
    schema = spark.read.options(**options, header=True, encoding=encoding, multiLine=True).csv(path).schema  # reads one record
    row = F.from_csv("value", ", ".join(f"{quoted(c)} string" for c in schema.names), options)
    return coerce(found.where(~F.col("header")).select(row.alias("row")).select("row.*"))


def coerce(df: DataFrame) -> DataFrame:
    """Text columns become long, double or timestamp if every value that is not missing does ($ and , are dropped
    from numbers); otherwise they stay text. One aggregate decides for all columns."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df
    clean = df.withColumns({c: F.when(~F.trim(col(c)).isin(*MISSING), col(c)) for c in names})
    tries = {"bigint": lambda c: F.regexp_replace(col(c), "[$,]", "").try_cast("bigint"), "double": lambda c: F.regexp_replace(col(c), "[$,]", "").try_cast("double"), "timestamp": lambda c: col(c).try_cast("timestamp")}
    row = clean.agg(*[F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(names)], *[F.count(f(c)).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in tries.items()]).first()
    change = {}
    for i, c in enumerate(names):
        kind = next((k for k in tries if row[f"n_{i}"] and row[f"{k}_{i}"] == row[f"n_{i}"]), None)
        if kind:
            change[c] = tries[kind](c)
    return clean.withColumns(change) if change else clean
