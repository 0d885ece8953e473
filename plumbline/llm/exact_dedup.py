"""Exact duplicates by deterministic block naming, in DataFrame expressions only.

A text without white space is cut into blocks of BLOCK bytes. Equal blocks get one integer name: blocks are dealt to
classes by a hash, sorted inside their class, and named by class and place in that order, so that different blocks
never share a name whatever the hash does. Then adjacent pairs of names are named in the same way, level by level, until
a text is one name. Number of blocks and last name are the text's identity; no hash decides about equality.

A block or pair that very many texts share is named first and broadcast; its rows are dealt out evenly instead of
meeting in one class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import BROADCAST_IDS, forget, keep, partitions

#: Bytes of a block.
BLOCK = 4096
#: A key with more rows than this is named apart if it is among the most frequent ones (two for each partition at most).
HOT_ROWS = 1000
#: Keys named apart that a join may broadcast (32 MB of blocks); beyond, both sides are shuffled.
BROADCAST_KEYS = 8192

# The characters that do not count, \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
_NONE = -(1 << 63)


def squeezed(text: Column) -> Column:
    """text without BLANKS; null is empty."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rid, idx, m, block, doc_id, points, text_sha256): a row a block of a row of docs, m of them; an empty text is one
    empty block. What tells about the row itself stands on its first block."""
    raw = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), squeezed(F.col("text")).alias("s"))
    rows = raw.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "points", F.sha2("s", 256).alias("text_sha256"), F.col("s").cast("binary").alias("s"))
    m = F.greatest(F.lit(1), F.ceil(F.length("s") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.substring(F.col("s"), i * size + 1, F.lit(size)))
    each = rows.select("rid", "doc_id", "points", "text_sha256", m.cast("long").alias("m"), F.posexplode(cut).alias("idx", "block"))
    own = lambda c: F.when(F.col("idx") == 0, F.col(c)).alias(c)
    return each.select("rid", F.col("idx").cast("long").alias("idx"), "m", "block", own("doc_id"), own("points"), own("text_sha256"))


def named(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows(rid, idx, ..., keys without nulls) with `name` instead of keys: equal keys, and only they, have equal names."""
    spark = rows.sparkSession
    code = F.xxhash64(*keys)
    counts = rows.groupBy(code.alias("code")).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    heavy = [r["code"] for r in counts.orderBy(F.desc("n"), "code").limit(2 * partitions(spark)).collect()]  # bounded by the limit
    known = F.lit(None).cast("long")
    if heavy:
        hot = keep(rows.where(code.isin(heavy)).select(*keys).distinct().orderBy(*keys).select(*keys, (-1 - F.monotonically_increasing_id()).alias("_known")), "names")
        rows = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, keys, "left")
        known = F.col("_known")
    free = known.isNull()
    classes = 16 * partitions(spark)
    dealt = rows.withColumn("_class", F.when(free, F.pmod(code, F.lit(classes))).otherwise(F.pmod(F.xxhash64("rid", "idx"), F.lit(classes))))
    dealt = dealt.withColumns({k: F.when(free, F.col(k)) for k in keys})
    place = F.dense_rank().over(Window.partitionBy("_class").orderBy(*keys))
    rest = [c for c in rows.columns if c not in (*keys, "_known")]
    return dealt.select(*rest, F.coalesce(known, F.shiftleft(F.col("_class"), 40) + place).alias("name"))


def identities(docs: DataFrame, size: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rid, doc_id, points, text_sha256, n_blocks, name): a row a row of docs; texts are equal when n_blocks and name are."""
    level = first = keep(named(blocks(docs, size), ["block"], hot_rows), "level")
    own = first.where("idx = 0").select("rid", "doc_id", "points", "text_sha256", F.col("m").alias("n_blocks"), "name")
    done, tables = [own.where("n_blocks = 1")], [first]
    most = first.agg(F.max("m")).first()[0] or 0
    while most > 1:
        half = level.where("m > 1").groupBy("rid", F.shiftright("idx", 1).alias("idx"), F.ceil(F.col("m") / 2).cast("long").alias("m"))
        pairs = half.agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(_NONE)).alias("b"))
        level = keep(named(pairs, ["a", "b"], hot_rows), "level")
        tables.append(level)
        done.append(level.where("m = 1").join(own.drop("name"), "rid").select(*own.columns))
        most = -(-most // 2)
    out = keep(reduce(DataFrame.unionAll, done), "identities")
    forget(*tables)
    return out


def exact_duplicates(docs: DataFrame, size: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, text_sha256), a row a row.

    Texts are equal when identical without BLANKS; a null text is empty, and all empty ones are equal. The row with the
    most code points in its original text stays, then the smallest doc_id (null last), then any one of the rows that
    agree in both. Texts of any length are taken whole; repeated rows are rows of their own; an empty table gives no
    rows; other columns are ignored.
    """
    rows = identities(docs.select("doc_id", "text"), size, hot_rows)
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("best")
    groups = keep(rows.groupBy("n_blocks", "name").agg(F.count("*").alias("n"), best).where("n > 1"), "groups")
    found = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups, ["n_blocks", "name"], "left")
    shared = F.col("n").isNotNull()
    return found.select(
        "doc_id",
        F.when(shared, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
