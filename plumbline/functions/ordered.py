"""Operations along a total order that never put all rows into one task.

Rows are cut into buckets at approximate quantiles of the first order column; a bucket's totals are carried over by
a window over the buckets alone, and windows over rows are partitioned by bucket or block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept

#: Rows of a bucket, about, and the most buckets.
BUCKET_ROWS, BUCKETS = 200_000, 4096
BLOCK = 1 << 16


def _number(df: DataFrame, column: str) -> Column:
    return F.unix_micros(column) if dict(df.dtypes)[column] == "timestamp" else F.col(column).cast("double")


def _buckets(n: int) -> int:
    return min(BUCKETS, -(-n // BUCKET_ROWS))


def _cuts(df: DataFrame, value: Column, keys: list[str] | None = None) -> list[tuple[list, list]]:
    """(key values, cut points) of the rows, or of each key's: as many quantiles as the rows need, repeated where a value is
    frequent. Rows are counted first; only if they fill more than one bucket are quantiles asked for."""
    keys = keys or []
    grouped = lambda rows: rows.groupBy(*keys)
    counts = {tuple(r[k] for k in keys): r["n"] for r in grouped(df).agg(F.count(value).alias("n")).collect()}  # one row, or one for each of a few keys
    n = max((_buckets(x) for x in counts.values()), default=0)
    if n <= 1:
        return [(list(k), []) for k in counts]
    points = [i / n for i in range(1, n)]
    out = []
    for r in grouped(df).agg(F.percentile_approx(value, points, 4 * n).alias("q")).collect():
        key = tuple(r[k] for k in keys)
        own = _buckets(counts[key])
        out.append((list(key), [r["q"][i * n // own - 1] for i in range(1, own)] if r["q"] else []))
    return out


def _place(value: Column, cuts: list) -> Column:
    """How many of the different cut points are smaller, looked up in two steps of about their root; null for null."""
    cuts = sorted(set(cuts))
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    count = lambda listed: F.size(F.filter(listed, lambda c: c < value))
    parts = F.array(*(F.array(*map(F.lit, cuts[i : i + step])) for i in range(0, len(cuts), step)))
    part = F.greatest(count(F.array(*map(F.lit, cuts[::step]))) - 1, F.lit(0))
    return F.when(value.isNotNull(), part * step + count(F.element_at(parts, part + 1)))


def bucketed(df: DataFrame, column: str, cuts: list | None = None) -> DataFrame:
    """df with _bucket, ascending in column (nulls first, -1): about one for BUCKET_ROWS rows, and one for equal values; or
    between given cut points."""
    value = _number(df, column)
    if cuts is None:
        ((_, cuts),) = _cuts(df, value)
    return df.withColumn("_v", value).withColumn("_bucket", F.coalesce(_place(F.col("_v"), cuts), F.lit(-1)).cast("long")).drop("_v")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with _idx, 0-based along the order columns (which should be a total order).

    A value of the first column that fills buckets alone is cut by the next column.
    """
    value = _number(df, order[0])
    ((_, cuts),) = _cuts(df, value)
    frequent = sorted({c for i, c in enumerate(cuts) if c in cuts[:i]})
    b = df.withColumn("_v", value).withColumn("_bucket", F.coalesce(_place(F.col("_v"), cuts), F.lit(-1)).cast("long") * (BUCKETS + 1))
    if frequent and len(order) > 1:
        tied = b.where(F.col("_v").isin(*frequent))
        cells = [(F.lit(v), F.array(*map(F.lit, sorted(set(own)))).cast("array<double>")) for (v,), own in _cuts(tied, _number(df, order[1]), ["_v"])]  # BUCKETS cut points in all
        own = F.element_at(F.create_map(*(x for cell in cells for x in cell)), F.col("_v"))
        second = _number(df, order[1])
        inner = F.when(second.isNull(), 0).otherwise(F.size(F.filter(own, lambda c: c < second)) + 1)
        # rows below a frequent value share its bucket: they come before it
        b = b.withColumn("_bucket", F.col("_bucket") + F.when(F.col("_v").isin(*frequent), inner + 1).otherwise(0))
    b = b.drop("_v")
    sizes = b.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # a row a bucket
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return b.withColumn("_inner", inner).join(before, "_bucket").withColumn("_idx", F.col("_before") + F.col("_inner")).drop("_bucket", "_inner", "_before")


def positioned(df: DataFrame, order: list[Column], name: str = "_idx") -> DataFrame:
    """df with its 0-based place along order, of any types: rows are dealt by ranges, sorted there and counted on. Equal rows
    stand in any order and are spread over partitions. The table is written once to the shared folder."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    ranged = marked.repartitionByRange(n, *order, "_spread").sortWithinPartitions(*order, "_spread").drop("_spread")
    rows = kept(ranged.withColumn("_at", F.monotonically_increasing_id()), "positioned").withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(before), "_part").withColumn(name, place).drop("_part", "_at", "_before")


def top_with_ties(df: DataFrame, column: str, n: int, largest: bool = True) -> DataFrame:
    """The rows of the n largest (or smallest) values of a column, and every row that ties with the last of them; nulls are left
    out. Only n values are gathered."""
    sort = F.desc(column) if largest else F.asc(column)
    edge = df.select(column).where(F.col(column).isNotNull()).orderBy(sort).limit(n).agg((F.min if largest else F.max)(column).alias("_edge"))
    inside = F.col(column) >= F.col("_edge") if largest else F.col(column) <= F.col("_edge")
    return df.join(F.broadcast(edge), inside).drop("_edge")  # one row


def running_sum(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A sum over _idx up to each row; null values add nothing and stay null."""
    b = df.withColumn("_block", F.floor(F.col("_idx") / BLOCK)).withColumn("_x", value)
    totals = b.groupBy("_block").agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("_t"))
    before = totals.select("_block", (F.sum("_t").over(Window.orderBy("_block")) - F.col("_t")).alias("_carry"))  # a row a block
    w = Window.partitionBy("_block").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(before, "_block").withColumn(name, F.when(F.col("_x").isNotNull(), F.sum("_x").over(w) + F.col("_carry")))
    return out.drop("_block", "_x", "_carry")


def trailing(df: DataFrame, width: int, make, name: str) -> DataFrame:
    """name = make(window of the row and the width - 1 before it); a block borrows its predecessor's last rows."""
    block = F.floor(F.col("_idx") / BLOCK)
    borrowed = F.when(F.col("_idx") % BLOCK >= BLOCK - (width - 1), F.array(block, block + 1)).otherwise(F.array(block))
    rows = df.withColumn("_own", block).withColumn("_block", F.explode(borrowed))
    w = Window.partitionBy("_block").orderBy("_idx").rowsBetween(-(width - 1), 0)
    return rows.withColumn(name, make(w)).where("_block = _own").drop("_block", "_own")


def average_ranks(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """(by, column, n, below, total) a distinct value: how often it stands, how many values are smaller, how many the group has.
    Nulls are left out. Values that fit one bucket, however many rows have them, are ranked by one window a group; more are cut
    into buckets first."""
    keys = [by] if by else []
    rows = df.where(F.col(column).isNotNull())
    value = _number(rows, column)
    few = rows.agg(F.approx_count_distinct(value)).first()[0] <= BUCKET_ROWS
    cuts = [] if few else _cuts(rows, value)[0][1]
    counts = bucketed(rows.groupBy(*keys, column).agg(F.count("*").alias("n")), column, cuts)
    w = Window.partitionBy(*keys, "_bucket").orderBy(column)
    if not cuts:  # one bucket: about BUCKET_ROWS values in all
        whole = Window.partitionBy(*keys, "_bucket")
        return counts.select(*keys, column, "n", (F.sum("n").over(w) - F.col("n")).alias("below"), F.sum("n").over(whole).alias("total"))
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_t"))
    group = Window.partitionBy(*keys)  # a row a bucket
    carry = totals.select(*keys, "_bucket", (F.sum("_t").over(group.orderBy("_bucket")) - F.col("_t")).alias("_c"), F.sum("_t").over(group).alias("total"))
    return counts.join(carry, [*keys, "_bucket"]).withColumn("below", F.col("_c") + F.sum("n").over(w) - F.col("n")).select(*keys, column, "n", "below", "total")


def quantiles(df: DataFrame, column: str, shares: list[float], by: str | None = None) -> DataFrame:
    """(by, q array<double>) of a group's exact quantiles, interpolated between neighbours; nulls are left out. Works on distinct
    values with counts and ranks, so no task holds a column. Without `by` always one row (q null if there are no values)."""
    x = df.select(*([by] if by else []), F.col(column).cast("double").alias("_x")).where(~F.isnan("_x"))
    return quantiles_of(average_ranks(x, "_x", by), "_x", shares, by)


def quantiles_of(ranks: DataFrame, column: str, shares: list[float], by: str | None = None, *more: Column) -> DataFrame:
    """quantiles out of average_ranks, and more aggregates over its rows."""

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col(column)))

    cells = []
    for p in shares:
        place = (F.col("total") - 1) * F.lit(float(p))
        low, high = at(F.floor(place)), at(F.ceil(place))
        cells.append((low + (high - low) * F.max(place - F.floor(place))))
    found = F.array(*cells)
    return ranks.groupBy(*[by] if by else []).agg(F.when(F.count("*") > 0, found).alias("q"), *more)
