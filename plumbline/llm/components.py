"""Connected components as Spark joins: every node ends with the smallest node that its links reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, keep


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of comparable ids -> (node, component) for every node in an edge.

    Alternates the large-star and the small-star step until nothing changes; a node never gathers its
    neighbours in one task, since both steps are a minimum per node and a join. Repeated edges, loops and
    either direction are fine; no edges give no rows.
    """
    e = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u is tied to u's smallest
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), "m").where("u <> m").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low2 = large.groupBy("u").agg(F.min("m").alias("r"))
        e2 = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("r").alias("a"), F.col("u").alias("b")), F.struct(F.col("r").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a < b").distinct()
        last, e = e, keep(e2, "edges")
        forget(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("h"), F.count_if(F.col("a") != F.col("b")).alias("k")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = keep(e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(e.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct(), "components")
    forget(e)
    return out
