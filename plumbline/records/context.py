"""Conversations cut to what fits a context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import bucketed


def prune_context(messages: DataFrame, max_tokens: int = 80_000, max_messages: int = 10) -> DataFrame:
    """messages(conv_id, turn, role, text) -> the same rows with `tokens` and `kept`.

    A message has length // 4 tokens (null text: none). System messages are kept and count against max_tokens. Of the
    others the newest stay: max_messages at most, and as many as fit max_tokens, but not fewer than two for its sake.
    Sums run over ranges of turns and their totals, so that a long conversation is spread over tasks.
    """
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("tokens", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4))
    rows = bucketed(rows.withColumn("_system", F.coalesce(F.col("role") == "system", F.lit(False))), "turn")
    live = F.when(F.col("_system"), 0).otherwise(F.col("tokens"))
    one = F.when(F.col("_system"), 0).otherwise(1)
    sizes = rows.groupBy("conv_id", "_bucket").agg(F.sum(live).alias("_t"), F.sum(one).alias("_k"), F.sum(F.when(F.col("_system"), F.col("tokens")).otherwise(0)).alias("_s"))
    by = Window.partitionBy("conv_id")  # a row a range of turns
    later = by.orderBy(F.desc("_bucket"))
    carried = sizes.select(F.col("conv_id").alias("_conv"), F.col("_bucket").alias("_b"), (F.sum("_t").over(later) - F.col("_t")).alias("_t"), (F.sum("_k").over(later) - F.col("_k")).alias("_k"), F.sum("_s").over(by).alias("_s"))
    inner = Window.partitionBy("conv_id", "_bucket").orderBy(F.desc("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_bucket") == F.col("_b")))
    placed = joined.withColumns({"_place": F.col("_k") + F.sum(one).over(inner), "_sum": F.col("_t") + F.sum(live).over(inner)})
    kept = F.col("_system") | ((F.col("_place") <= max_messages) & ((F.col("_place") <= 2) | (F.col("_s") + F.col("_sum") <= max_tokens)))
    return placed.select("conv_id", "turn", "role", "text", "tokens", kept.alias("kept"))
