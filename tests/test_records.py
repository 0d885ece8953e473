import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.operators.profile import quality_issues
from plumbline.records.context import prune_context
from plumbline.records.splits import stratified_split
from plumbline.records.summaries import pass_rates, timings

SF = "/root/testdata/sf0.001"
NAMES = ["profile_top_values", "profile_quality_issues", "profile_correlations", "rec_pass_rates", "rec_timings", "rec_stratified_split", "rec_prune_context"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "customer", "documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(map(str, rel.fetchall()))
    assert want and sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_small_cases(spark):
    df = spark.createDataFrame([(i, "a" if i < 40 else "b" if i < 42 else None) for i in range(50)], "id long, g string")
    counts = {(r.g, r.split): r["count"] for r in stratified_split(df, "id", "g").groupBy("g", "split").count().collect()}
    assert counts == {("a", "train"): 32, ("a", "val"): 4, ("a", "test"): 4, ("b", "train"): 2, ("UNKNOWN", "train"): 6, ("UNKNOWN", "test"): 2}
    rows = [(1, 0, "system", "s" * 40), (1, 1, "user", "u" * 400), (1, 2, "assistant", "a" * 400), (1, 3, "user", None), (None, 0, "user", "x")]
    kept = {(r.conv_id, r.turn): r.kept for r in prune_context(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 115, 3).collect()}
    assert kept == {(1, 0): True, (1, 1): False, (1, 2): True, (1, 3): True, (None, 0): True}
    empty = spark.createDataFrame([], "g string, v double, ok int")
    assert pass_rates(empty, "g", "ok").count() == 0 and timings(empty, "g", "v").count() == 0


def test_quality_issues(spark):
    df = spark.createDataFrame([("x", None, 1), ("y", None, 2)], "a string, b string, c int")
    assert {tuple(r) for r in quality_issues(df).collect()} == {("empty_column", "b", 2), ("unique_text", "a", 2)}
    assert {tuple(r) for r in quality_issues(df.select("b")).collect()} == {("duplicate_rows", None, 1), ("empty_column", "b", 2)}
    assert quality_issues(df.limit(0)).count() == 0
