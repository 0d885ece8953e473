"""User code over tables: aggregates in two phases, and functions over groups that report steps and an answer.

Only callables that the user's own program passes or registers are run, never text. Both deal rows by a key's JSON
text, so that keys may be of any types, null and NaN included, and both stream: no task holds more than a batch of rows
beside what the user's code keeps.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType, StructField, StructType

from ..functions.names import col
from ..records.answers import digest
from ..shipping import ship

#: Groups whose partial states a task holds before it sends them on.
HELD_GROUPS = 50_000


@dataclass(frozen=True)
class Aggregate:
    """A user aggregate: start() gives an empty state, add(state, columns) takes the rows of one batch as an Arrow array for
    each input and returns the state, merge joins two states, finish makes the result of a state, of type `result`.

    States travel pickled and must not grow with the rows. The order of rows and merges is free.
    """

    result: str
    start: Callable[[], Any]
    add: Callable[[Any, dict[str, pa.Array]], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


_AGGREGATES: dict[str, Aggregate] = {}
_FUNCTIONS: dict[str, tuple[str, Callable]] = {}


def register_aggregate(name: str, aggregate: Aggregate) -> None:
    _AGGREGATES[name] = aggregate


def register_function(name: str, answer: str, run: Callable[[Iterator[pa.RecordBatch], Report], None]) -> None:
    """run(batches, report) reads a group's rows and reports steps and an answer of the DDL type `answer`."""
    _FUNCTIONS[name] = (answer, run)


def _keyed(df: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """(_k, _keys, _row): the keys' text and values, and the other columns asked for."""
    values = F.struct(*(col(k).alias(k) for k in keys)) if keys else F.struct(F.lit(True).alias("all"))
    row = F.struct(*(col(c).alias(c) for c in rest)) if rest else F.struct(F.lit(True).alias("none"))
    return df.select(F.to_json(values, {"ignoreNullFields": "false"}).alias("_k"), values.alias("_keys"), row.alias("_row"))


def _fault(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def aggregate(df: DataFrame, keys: list[str], inputs: list[str], how: Aggregate | str, name: str = "result", held: int = HELD_GROUPS) -> DataFrame:
    """(keys..., name, error): a user aggregate over `inputs` of each group, or over all rows without keys.

    Every task folds its rows into a state a group, batch by batch; the states, one a group and task, are shuffled by
    group and merged. So a group may be larger than any machine's memory and may hold any share of the rows. What
    user code raises for a group is its error, its result then is null. An empty table gives no rows, without keys too.
    """
    how = _AGGREGATES[how] if isinstance(how, str) else how
    spark = df.sparkSession
    ship(spark)
    rows = _keyed(df, keys, inputs)
    partial = StructType([StructField("_k", StringType()), rows.schema["_keys"], StructField("state", BinaryType()), StructField("error", StringType())])
    arrow = to_arrow_schema(partial)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, list] = {}

        def sent() -> pa.RecordBatch:
            out = [(k, keys_of, None if error else pickle.dumps(state), error) for k, (keys_of, state, error) in states.items()]
            states.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            codes = b.column("_k").dictionary_encode()
            names, place = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=len(names))) if len(names) else []
            fields = b.column("_row").type
            columns = {f.name: c for f, c in zip(fields, b.column("_row").flatten(), strict=True)}
            for k, first, last in zip(names, [0, *ends[:-1]], ends, strict=True):
                at = pa.array(order[first:last])
                if k not in states:
                    states[k] = [b.column("_keys")[int(order[first])].as_py(), how.start(), None]
                own = states[k]
                if own[2] is None:
                    try:
                        own[1] = how.add(own[1], {c: x.take(at) for c, x in columns.items()})
                    except Exception as e:  # user code
                        own[1:] = [None, _fault(e)]
            if len(states) > held:
                yield sent()
        if states:
            yield sent()

    out = StructType([rows.schema["_keys"], StructField("value", DataType.fromDDL(how.result)), StructField("error", StringType())])
    out_arrow = to_arrow_schema(out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list | None = None
        ready: list[tuple] = []

        def done() -> None:
            value, error = None, at[3]
            if error is None:
                try:
                    value = how.finish(at[2])
                    pa.array([value], out_arrow.field("value").type)
                except Exception as e:  # user code
                    value, error = None, _fault(e)
            ready.append((at[1], value, error))

        def sent() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*ready, strict=True), out_arrow, strict=True)], schema=out_arrow)
            ready.clear()
            return b

        for b in batches:
            for r in b.to_pylist():
                if at is not None and at[0] != r["_k"]:
                    done()
                    at = None
                state = None if r["error"] else pickle.loads(r["state"])
                if at is None:
                    at = [r["_k"], r["_keys"], state, r["error"]]
                elif at[3] is None and r["error"] is None:
                    try:
                        at[2] = how.merge(at[2], state)
                    except Exception as e:  # user code
                        at[3] = _fault(e)
                else:
                    at[3] = at[3] or r["error"]
            if len(ready) > 5000:
                yield sent()
        if at is not None:
            done()
            yield sent()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = rows.mapInArrow(fold, partial).repartition(n, "_k").sortWithinPartitions("_k").mapInArrow(join, out)
    return merged.select(*(F.col("_keys")[k].alias(k) for k in keys), F.col("value").alias(name), "error")


@dataclass
class Report:
    """What a user function says about a group: named steps, each with the line of code that made it and the steps it rests
    on, and one answer."""

    steps: list[dict] = field(default_factory=list)
    answer: Any = None
    submitted: bool = False

    def hook(self, value: Any, code_line: str, name: str | None = None, depends_on: list[str] | None = None, description: str | None = None) -> Any:
        """Note a step and pass its value through; the hash is of the whole value, rounded as answers are."""
        text = json.dumps(_plain(value), sort_keys=True)
        self.steps.append({"place": len(self.steps), "name": name, "value": text, "value_hash": digest(text), "code_line": code_line, "depends_on": list(depends_on or []), "description": description})
        return value

    def submit(self, answer: Any) -> Any:
        """Give the answer; a second one is an error."""
        if self.submitted:
            raise ValueError("an answer was submitted before")
        self.answer, self.submitted = _plain(answer), True
        return answer


def _plain(x: Any) -> Any:
    """x as JSON can hold it."""
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set):
        return [_plain(v) for v in x]
    if isinstance(x, np.ndarray | pa.Array | pa.Scalar):
        return _plain(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() if isinstance(x, pa.Array) else x.as_py())
    return x.item() if isinstance(x, np.generic) else x if isinstance(x, str | int | float | bool | type(None)) else str(x)


HOOKS = ArrayType(StructType([StructField("place", LongType()), StructField("name", StringType()), StructField("value", StringType()), StructField("value_hash", StringType()), StructField("code_line", StringType()), StructField("depends_on", ArrayType(StringType())), StructField("description", StringType())]))


def run_groups(df: DataFrame, keys: list[str], columns: list[str], function: str | tuple[str, Callable], order: list[str] | None = None) -> DataFrame:
    """(keys..., n_rows, answer, hooks, error): a user function over each group's `columns`, sorted by `order` if given.

    The function gets the group's rows as a stream of Arrow batches, which it need not read to the end, and a Report. answer has
    the type that was registered; a function that submits none, or raises, or submits what does not fit gives a null
    answer, its hooks so far, and why in error. A group goes through one task but is never held there; what can be merged
    should be an Aggregate. An empty table gives no rows.
    """
    answer, run = _FUNCTIONS[function] if isinstance(function, str) else function
    spark = df.sparkSession
    ship(spark)
    rows = _keyed(df, keys, [*dict.fromkeys([*columns, *(order or [])])])
    schema = StructType([rows.schema["_keys"], StructField("n_rows", LongType()), StructField("answer", DataType.fromDDL(answer)), StructField("hooks", HOOKS), StructField("error", StringType())])
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(batches)
        piece = next(runs, None)
        while piece is not None:
            key, keys_of, n = piece[0], piece[1], 0

            def group() -> Iterator[pa.RecordBatch]:
                nonlocal piece, n
                while piece is not None and piece[0] == key:  # noqa: B023
                    n += piece[2].num_rows
                    now, piece = piece[2], next(runs, None)
                    yield now

            report, rest, error, value = Report(), group(), None, None
            try:
                run(rest, report)
                if not report.submitted:
                    error = "no answer was submitted"
                else:
                    value = report.answer
                    pa.array([value], arrow.field("answer").type)
            except Exception as e:  # user code
                value, error = None, _fault(e)
            for _ in group():  # what the function has not read
                pass
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((keys_of, n, value, report.steps, error), arrow, strict=True)], schema=arrow)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col("_k"), *(F.col("_row")[c] for c in order or [])]
    out = rows.repartition(n, "_k").sortWithinPartitions(*sort).mapInArrow(of, schema)
    return out.select(*(F.col("_keys")[k].alias(k) for k in keys), "n_rows", "answer", "hooks", "error")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict, pa.RecordBatch]]:
    """(key, its values, rows) for every run of one key in a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column("_k").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
        body = pa.RecordBatch.from_struct_array(b.column("_row"))
        for first, last in zip(cuts, cuts[1:], strict=False):
            yield b.column("_k")[first].as_py(), b.column("_keys")[first].as_py(), body.slice(first, last - first)
