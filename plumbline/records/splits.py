"""Stratified train, validation and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import bucketed


def hash_places(df: DataFrame, key: str, stratum: str) -> DataFrame:
    """df with _at, each row's place in its stratum by the md5 of its key (from 0), and _all, the stratum's rows.

    Places come from hash ranges and counts before them, so that a large stratum is spread over tasks.
    """
    rows = bucketed(df.withColumn("_h", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("long")), "_h")
    sizes = rows.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(stratum)  # a row a hash range
    places = sizes.select(F.col(stratum).alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_n").over(by.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("_all"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_h", key)) - 1
    placed = rows.join(places, F.col(stratum).eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return placed.withColumn("_at", at).drop("_s", "_b", "_before", "_bucket", "_h")


def stratified_split(df: DataFrame, key: str, stratum: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(key, stratum, split): each stratum in the order of its keys' md5 is cut into train, val and test.

    Of n rows max(1, int(n * train)) go to train, int(n * val) to val, the rest to test; up to two rows all go to
    train. A null stratum is the stratum 'UNKNOWN'.
    """
    if not 0 < train <= 1 or not 0 <= val <= 1 or train + val > 1 + 1e-6:
        raise ValueError("shares must be between 0 and 1 and come to 1 at most")
    rows = df.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("UNKNOWN")).alias(stratum))
    n_train = F.greatest(F.lit(1), F.floor(F.col("_all") * train))
    last_val = n_train + F.floor(F.col("_all") * val)
    split = F.when((F.col("_all") <= 2) | (F.col("_at") < n_train), "train").when(F.col("_at") < last_val, "val").otherwise("test")
    return hash_places(rows, key, stratum).select(key, stratum, split.alias("split"))
