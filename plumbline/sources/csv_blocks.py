"""CSV records out of physical lines, so that one file with line breaks inside quotes is still read by many tasks.

Lines are read by block. A first pass counts the quotes of each block; a sum over the blocks before tells whether a block
begins inside quotes. Then every task joins its own lines to records, and only what a record leaves in several blocks,
two pieces a block at most, is put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Blocks whose beginnings a join may broadcast.
BROADCAST_BLOCKS = 500_000
_PIECES = "file string, block long, place long, part string, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, raw): physical lines without their \\n, as bytes; `at` orders them inside a block."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"))


def _quotes(raw: Column) -> Column:
    """How many quotes a line has; they are one byte in UTF-8 and in Latin-1."""
    s = F.decode(raw, "ISO-8859-1")
    return F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, odd, inside, broken): whether a block has lines with an odd number of quotes, begins inside quotes,
    and has bytes that are no UTF-8."""
    each = lines.groupBy("file", "block").agg((F.sum(_quotes(F.col("raw"))) % 2).alias("parity"), F.max(_quotes(F.col("raw")) % 2).alias("odd"), F.max(~F.is_valid_utf8(F.col("raw").cast("string"))).alias("broken"))
    before = F.sum("parity").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    return each.select("file", "block", "odd", "parity", (F.coalesce(before, F.lit(0)) % 2).alias("inside"), "broken")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order -> records that lie within their block (part 'whole'), and a block's first and last piece of a record
    that does not ('head', 'tail'; 'middle' if the block has nothing else)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("part", pa.string()), ("value", pa.string())])
    now: tuple | None = None
    place = 0
    held: list[str] = []
    inside = begun = False
    out: list[tuple] = []

    def close() -> None:
        if held:
            out.append((*now, place, "tail" if begun else "middle", "\n".join(held)))
            held.clear()

    for b in batches:
        for file, block, starts, value, quotes in zip(*(b.column(c).to_pylist() for c in ("file", "block", "inside", "value", "quotes")), strict=True):
            if now != (file, block):
                if now is not None:
                    close()
                now, inside, begun, place = (file, block), bool(starts), not starts, 0
            held.append(value)
            inside ^= quotes % 2
            if not inside:
                if not begun or value.strip() or len(held) > 1:  # blank lines between records are none
                    out.append((file, block, place if begun else -1, "whole" if begun else "head", "\n".join(held)))
                    place += begun
                held.clear()
                begun = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if now is not None:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def records(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[DataFrame, bool, str]:
    """((file, header, value) a CSV record, whether any holds a line break, encoding). Without line breaks header is null.

    Without a given encoding it is UTF-8, or Latin-1 if some line is no valid UTF-8. Records end with \\n or \\r\\n; quotes
    are as RFC 4180 has them, that is fields with quotes are quoted and quotes inside are doubled. A file whose quotes do not come
    out even is an error.
    """
    lines = _lines(spark, path)
    blocks = _blocks(lines)
    odd, broken, n, uneven = blocks.agg(F.max("odd"), F.max("broken"), F.count("*"), F.max(F.struct(F.col("parity"), "file"))).first() or (0, False, 0, None)
    encoding = encoding or ("ISO-8859-1" if broken else "UTF-8")
    text = F.decode("raw", encoding)
    if not odd:
        return lines.select("file", F.lit(None).cast("boolean").alias("header"), F.rtrim(text, F.lit("\r")).alias("value")), False, encoding
    ends = blocks.groupBy("file").agg(F.sum("parity").alias("n")).where("n % 2 = 1").select("file").first()
    if ends is not None:
        raise ValueError(f"a quote of {ends['file']} is never closed")
    ship(spark)
    start = blocks.select("file", "block", "inside")
    read = lines.select("file", "block", "at", text.alias("value"), _quotes(F.col("raw")).alias("quotes"))
    if n <= BROADCAST_BLOCKS:  # the order of lines stays as it was read
        ordered = read.join(F.broadcast(start), ["file", "block"])
    else:
        ordered = read.join(start, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    pieces = ordered.mapInArrow(_joined, _PIECES)
    cut = pieces.where("part <> 'whole'")
    w = Window.partitionBy("file").orderBy("block", F.col("part") == "tail").rowsBetween(Window.unboundedPreceding, 0)
    # a record's pieces: its tail, any blocks that it fills, and the head where it ends
    chained = cut.withColumn("chain", F.sum((F.col("part") == "tail").cast("long")).over(w))
    whole = chained.groupBy("file", "chain").agg(F.min("block").alias("block"), F.max("place").alias("place"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", (F.col("part") == "tail").alias("last"), "value"))), lambda p: p["value"]), "\n").alias("value"))
    every = pieces.where("part = 'whole'").select("file", "block", "place", "value").unionByName(whole.drop("chain"))
    return every.select("file", ((F.col("block") == 0) & (F.col("place") == 0)).alias("header"), F.rtrim("value", F.lit("\r")).alias("value")), True, encoding
