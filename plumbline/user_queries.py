"""Queries of user aggregates and user functions over the given tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import user

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _logs(state: tuple[int, float], columns: dict[str, pa.Array]) -> tuple[int, float]:
    x = columns["l_extendedprice"].drop_null().to_numpy()
    return state[0] + len(x), state[1] + float(np.log(x).sum())


GEOMETRIC_MEAN = user.Aggregate("double", lambda: (0, 0.0), _logs, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: math.exp(s[1] / s[0]) if s[0] else None)

QUERIES["udaf_geometric_mean"] = lambda s, d: user.aggregate(s.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], ["l_extendedprice"], GEOMETRIC_MEAN, "mean").select("l_returnflag", "l_linestatus", F.round("mean", 4).alias("mean"), "error")
ORACLE_SQL["udaf_geometric_mean"] = "select l_returnflag, l_linestatus, round(exp(avg(ln(l_extendedprice))), 4) as mean, null::varchar as error from lineitem group by 1, 2"


def _moments(state: np.ndarray, columns: dict[str, pa.Array]) -> np.ndarray:
    x, y = (columns[c].to_numpy(zero_copy_only=False).astype(float) for c in ("l_quantity", "l_extendedprice"))
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if not len(x):
        return state
    mx, my = x.mean(), y.mean()
    return _merged(state, np.array([len(x), mx, my, ((x - mx) ** 2).sum(), ((x - mx) * (y - my)).sum(), ((y - my) ** 2).sum()]))


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and centred products of two parts together."""
    n = a[0] + b[0]
    if not n:
        return a
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return np.array([n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dx * dy * w, a[5] + b[5] + dy * dy * w])


def _line(state: np.ndarray) -> dict | None:
    n, mx, my, xx, xy, yy = map(float, state)
    return {"n": int(n), "slope": xy / xx, "intercept": my - mx * xy / xx, "r2": xy * xy / (xx * yy)} if n > 1 and xx and yy else None


REGRESSION = user.Aggregate("struct<n: bigint, slope: double, intercept: double, r2: double>", lambda: np.zeros(6), _moments, _merged, _line)

QUERIES["udaf_regression"] = lambda s, d: user.aggregate(s.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], ["l_quantity", "l_extendedprice"], REGRESSION, "line").select("l_returnflag", "line.n", F.round("line.slope", 4).alias("slope"), F.round("line.intercept", 3).alias("intercept"), F.round("line.r2", 6).alias("r2"))
ORACLE_SQL["udaf_regression"] = "select l_returnflag, regr_count(l_extendedprice, l_quantity)::bigint as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1"


def longest_silence(batches: Iterator[pa.RecordBatch], report: user.Report) -> None:
    """Seconds of a user's longest pause between events in order of time, and the longest run of one kind of event."""
    before, kind, pause, run, longest, n = None, None, 0, 0, 0, 0
    for b in batches:
        for t, k in zip(b.column("ts").cast(pa.int64()).to_pylist(), b.column("event_type").to_pylist(), strict=True):
            pause = max(pause, (t - before) // 1_000_000 if before is not None else 0)
            run = run + 1 if k == kind else 1
            before, kind, longest, n = t, k, max(longest, run), n + 1
    report.hook(n, "n = len(rows)", "n")
    report.hook(pause, "pause = max(diff(ts))", "pause", ["n"])
    report.hook(longest, "longest = max(run lengths of event_type)", "longest", ["n"])
    report.submit({"pause": pause, "longest": longest})


user.register_function("longest_silence", "struct<pause: bigint, longest: bigint>", longest_silence)


def _silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    return user.run_groups(e, ["user_id"], ["ts", "event_type"], "longest_silence", ["ts", "event_id"])


QUERIES["udf_group_answers"] = lambda s, d: _silences(s, d).select("user_id", "n_rows", "answer.pause", "answer.longest", F.size("hooks").cast("long").alias("n_hooks"), "error")
QUERIES["udf_group_hooks"] = lambda s, d: _silences(s, d).select("user_id", F.explode("hooks").alias("h")).select("user_id", F.col("h.name").alias("step"), F.col("h.value").cast("long").alias("value"), F.array_join("h.depends_on", ",").alias("rests_on"))
_SILENCES = """with each as (
  select user_id, ts, event_id, event_type, lag(ts) over w as before, lag(event_type) over w as kind from events window w as (partition by user_id order by ts, event_id)
), runs as (select *, sum(case when kind = event_type then 0 else 1 end) over (partition by user_id order by ts, event_id) as run from each),
lengths as (select user_id, run, count(*) as n from runs group by 1, 2),
answers as (
  select e.user_id, count(*) as n_rows, coalesce(max(date_diff('microsecond', before, ts) // 1000000), 0) as pause, any_value(l.longest) as longest
  from each e join (select user_id, max(n) as longest from lengths group by 1) l on e.user_id = l.user_id group by 1
)"""
ORACLE_SQL["udf_group_answers"] = _SILENCES + " select user_id, n_rows, pause, longest, 3::bigint as n_hooks, null::varchar as error from answers"
ORACLE_SQL["udf_group_hooks"] = _SILENCES + " select user_id, 'n' as step, n_rows as value, '' as rests_on from answers union all select user_id, 'pause', pause, 'n' from answers union all select user_id, 'longest', longest, 'n' from answers"
