"""What the operators share: tables kept in the cluster's shared folder, code shipping, batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..scratch import shared_dir
from ..shipping import ship  # noqa: F401  the operators take it from here

#: Bytes of text that one pass of the numpy kernels takes at once; a longer document is a pass of its own.
SLICE_BYTES = 400_000


#: Rows of an Arrow batch while a kept table is made: rows here are whole texts or sets, and a task holds a batch twice.
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_CONF, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    if _KEPT:
        _KEPT[-1].append(out)
    return out


_KEPT: list[list[DataFrame]] = []


@contextlib.contextmanager
def kept_tables() -> Iterator[list[DataFrame]]:
    """Collects what keep() writes meanwhile, so that it can be forgotten when nothing reads it any more."""
    _KEPT.append([])
    try:
        yield _KEPT[-1]
    finally:
        made = _KEPT.pop()
        if _KEPT:
            _KEPT[-1].extend(made)


def columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever is in their names."""
    return [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]


def forget(*tables: DataFrame | None) -> None:
    """Delete what keep() wrote for these tables, which nothing that is still to run reads."""
    for df in tables:
        if (path := getattr(df, "_plumbline_path", None) if df is not None else None) is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Ids that a join may broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def free_name(docs: DataFrame) -> str:
    """A column name that docs does not have."""
    return "_" * (1 + max(map(len, docs.columns), default=0))


def row_key(docs: DataFrame) -> Column:
    """A row's own number, out of its doc_id and text: rows that repeat both have one, null ids and texts have theirs."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs with the row's own number for doc_id, so that an operator's decisions are about rows."""
    return docs.select(row_key(docs).alias("doc_id"), "text")


def without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of docs whose row_key is not among keys(doc_id)."""
    own = free_name(docs)
    keys = keep(keys.select(F.col("doc_id").alias(own)).distinct(), name)
    rows = docs.withColumn(own, row_key(docs))
    left = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, own, "left_anti")
    return left.drop(own)


def once(docs: DataFrame, name: str) -> DataFrame:
    """docs with one of the rows that repeat doc_id and text: the first by its JSON text, so that columns of any type may stand
    beside. Only such rows are shuffled; without any it is docs itself, otherwise a kept table."""
    own = free_name(docs)
    rows = docs.withColumn(own, row_key(docs))
    twice = keep(rows.groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own), name)
    n = twice.count()
    if not n:
        return docs
    some = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    row = F.struct(*columns(docs))
    first = docs.select(row_key(docs).alias(own), row.alias("r")).join(some, own, "left_semi").groupBy(own).agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
    return keep(rows.join(some, own, "left_anti").drop(own).unionAll(first), name)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, handing back to the system what it freed: Python workers outlive their tasks, and their memory counts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return f


def schema_with(rows: DataFrame, ddl: str) -> StructType:
    """The schema that ddl writes, its `row` of the type that it has in rows: names in it may be any."""
    kind = DataType.fromDDL(ddl.replace("row row", "row int"))
    return StructType([rows.schema["row"] if f.name == "row" else f for f in kind.fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of one piece stays near limit bytes; null text becomes empty."""
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(column)
        col = b.column(at)
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
            b = pa.RecordBatch.from_arrays([col if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)
        off = offsets(col)
        first = 0
        while first < b.num_rows:
            last = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), b.num_rows)
            yield b.slice(first, last - first)
            first = last


def offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value starts in them (with an end)."""
    off = offsets(col)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]
