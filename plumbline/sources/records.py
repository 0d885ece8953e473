"""JSON records in files: readers that are strict, lenient or count what is malformed, and the sinks that write them.

Lines are read as text and parsed by Spark, so a malformed line is a row that can be counted, dropped or refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.ordered import positioned
from ..records.manifests import latest, upsert


def parse_lines(lines: DataFrame, schema: str, mode: str = "lenient") -> DataFrame:
    """lines(value, ...) -> the fields of `schema`, and the other columns of lines: a row for each line that is not blank.

    lenient: lines that are no JSON object go. counted: they stay, with `_malformed` true and null fields. strict: the
    first one that a task meets ends the query, and the message has the line.
    """
    if mode not in ("lenient", "counted", "strict"):
        raise ValueError(f"unknown mode {mode}")
    others = [c for c in lines.columns if c != "value"]
    rows = lines.where(F.trim("value") != "")
    whole = F.try_parse_json("value")
    bad = whole.isNull() | (F.schema_of_variant(whole).like("OBJECT%") == False)  # noqa: E712
    if mode == "strict":
        rows = rows.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))).otherwise(F.col("value")))
    elif mode == "lenient":
        rows = rows.where(~bad)
    parsed = rows.withColumn("_p", F.when(~bad, F.from_json("value", schema)))
    out = parsed.select(*others, "_p.*", *([bad.alias("_malformed")] if mode == "counted" else []))
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "lenient") -> DataFrame:
    """parse_lines over the files of a path, each row with the `file` it is from."""
    return parse_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), schema, mode)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array of objects each, or one object with a list `questions`; malformed files end the query."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return json_array(texts, schema)


def json_array(texts: DataFrame, schema: str) -> DataFrame:
    """texts(value, ...) of a JSON array each -> a row an element, with `place` from 0; what is no array ends the query."""
    others = [c for c in texts.columns if c != "value"]
    inner = F.coalesce(F.get_json_object("value", "$.questions"), F.col("value"))
    items = F.from_json(inner, f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return texts.select(*others, F.posexplode(items).alias("place", "_p")).select(*others, "place", "_p.*")


def element(rows: DataFrame, place: int) -> DataFrame:
    """The row of a place; a place that is not there ends the query."""
    found = rows.where(F.col("place") == place)
    n = rows.agg(F.count("*").alias("_n"))
    return n.join(found, F.lit(True), "left").withColumn("place", F.when(F.col("place").isNull(), F.raise_error(F.concat(F.lit(f"no element {place} of "), F.col("_n").cast("string")))).otherwise(F.col("place"))).drop("_n")


def chat_json(text: Column) -> Column:
    """The JSON in a chat answer: a fenced block, else the outermost braces, else a dictionary in Python's quotes; null if none parses."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    python = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    valid = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), c)
    return F.coalesce(valid(block), valid(bare), valid(python))


def chat_field(text: Column, field: str) -> Column:
    """A field of a chat answer: of the whole text as JSON, of JSON inside it, or what stands after its name in quotes."""
    loose = F.nullif(F.regexp_extract(text, rf'"{field}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    whole = F.when(F.try_parse_json(text).isNotNull(), F.get_json_object(text, f"$.{field}"))
    return F.coalesce(whole, F.get_json_object(chat_json(text), f"$.{field}"), loose)


def dataset_names(files: DataFrame) -> DataFrame:
    """files(path) -> (path, dataset): a file's name without its ending, for data.csv that of its folder."""
    name, folder = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select("path", F.when(F.col("path").rlike(r"(^|/)data\.csv$") & (folder != ""), folder).otherwise(name).alias("dataset"))


def discover(spark: SparkSession, root: str, pattern: str = "*/data.csv", manifest: DataFrame | None = None) -> DataFrame:
    """(path, dataset, place) of the CSV files under root: in the order of manifest(dataset, place) if given, which then says
    which of them count, else by name."""
    files = spark.read.format("binaryFile").load(f"{root}/{pattern}").select("path")  # paths only: the content is pruned
    named = dataset_names(files)
    if manifest is None:
        return named.withColumn("place", F.lit(None).cast("long"))
    return named.join(manifest.select("dataset", F.col("place").cast("long").alias("place")), "dataset")


def description(meta: Column, overview: Column) -> Column:
    """What describes a data set: the first of description, subtitle and title in its JSON that is not empty, else the first
    three sentences of its overview."""
    told = [F.nullif(F.trim(F.get_json_object(meta, f"$.{k}")), F.lit("")) for k in ("description", "subtitle", "title")]
    short = F.array_join(F.slice(F.split(overview, r"\."), 1, 3), ".")
    return F.coalesce(*told, F.nullif(F.trim(short), F.lit("")))


def read_splits(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """train, val and test JSONL files of a folder as one table with `split`; files that are not there are left out."""
    return read_jsonl(spark, f"{root}/{{train,val,test}}.jsonl*", schema, "strict").withColumn("split", F.regexp_extract("file", r"/(train|val|test)\.jsonl", 1)).drop("file")


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as JSON lines; append adds files and leaves those there alone."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, root: str) -> None:
    """A folder of JSON lines for each value of `split`."""
    df.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", False).json(root)


def compact_manifest(spark: SparkSession, source: str, target: str, schema: str, keys: list[str], order: list[str]) -> None:
    """The latest entry of each key from source's lines into target, which must be another folder: a lost task then costs nothing."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a manifest cannot be compacted onto itself")
    write_jsonl(latest(read_jsonl(spark, source, schema).drop("file"), keys, order), target, "overwrite")


def upsert_jsonl(spark: SparkSession, source: str, new: DataFrame, target: str, schema: str, key: str = "id") -> None:
    """source's records with those of new in place of the ones with their key, into target, another folder."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("records cannot be upserted onto themselves")
    write_jsonl(upsert(read_jsonl(spark, source, schema, "strict").drop("file"), new, key), target, "overwrite")


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """The only part file of folder source in place of the file target, at once where the file system can."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    (part,) = [str(f.getPath()) for f in path(source).getFileSystem(conf).globStatus(path(f"{source}/part-*"))]
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), conf).rename(path(part), path(target), over)
    path(source).getFileSystem(conf).delete(path(source), True)


def write_json_array(df: DataFrame, path: str, order: list[str], indent: bool = True, fields: dict[str, str] | None = None, key: str = "questions") -> None:
    """Rows as one JSON document in the file `path`: an array of objects, sorted by `order`, or an object that holds `fields`
    (JSON texts by name) and the array under `key`. read_json_array reads either back.

    Rows are sorted by ranges on all tasks; one task then streams the lines of the file, since a document is one file. It
    is written beside the target and takes its place when whole: until then, and if a task fails for good, the old file
    stays. Null fields are written, an empty table gives an empty array.
    """
    spark = df.sparkSession
    named = lambda names, prefix: F.struct(*(col(c).alias(prefix.format(i, c)) for i, c in enumerate(names)))
    row = F.to_json(named(df.columns, "{1}"), {"ignoreNullFields": "false", "pretty": str(indent).lower()})
    rows = positioned(df.select(named(order, "o{0}").alias("_order"), row.alias("_json")), [F.col("_order")])
    last = rows.count() - 1
    text = F.regexp_replace("_json", "(?m)^", "  ") if indent else F.col("_json")
    opened, closed = ("[", "]") if fields is None else ("{" + "".join(f"{json.dumps(k)}: {v}, " for k, v in fields.items()) + f"{json.dumps(key)}: [", "]}")
    ends = spark.createDataFrame([(-1, opened), (last + 1, closed)], "_idx long, value string")
    lines = ends.unionByName(rows.select("_idx", F.concat(text, F.when(F.col("_idx") < last, ",").otherwise("")).alias("value")))
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    lines.coalesce(1).sortWithinPartitions("_idx").select("value").write.text(draft)
    _replace(spark, draft, path)


def upsert_json_array(spark: SparkSession, path: str, new: DataFrame, schema: str, key: str = "id", order: list[str] | None = None) -> None:
    """The records of the file `path`, if it is there, with those of new in place of the ones with their key, in one JSON array
    again; records without a key stay. The old file is read whole before the new one takes its place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = upsert(read_json_array(spark, path, schema).drop("file", "place"), new, key)
    write_json_array(new, path, order or [key])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report (see records.evaluation.report) as one text file."""
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)
