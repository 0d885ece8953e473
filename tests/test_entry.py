import glob
import math
import os

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return str(v)


def test_base_queries_match_sql(spark):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{SF}/*.parquet")):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in sql if n.startswith(("proc_", "tpl_", "stat_", "profile_", "rec_", "src_", "udaf_", "udf_"))]
    assert len(names) > 150
    wrong = []
    for name in names:
        df = queries[name](spark, SF)
        rel = con.execute(sql[name])
        cols = [c[0] for c in rel.description]
        want = sorted(tuple(map(str, map(value, r))) for r in rel.fetchall())
        if sorted(cols) != sorted(df.columns) or sorted(tuple(str(value(r[c])) for c in cols) for r in df.collect()) != want:
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    assert entry.entry(spark).count() == 1
