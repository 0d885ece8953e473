import json
import random

import pytest

from plumbline.sources import csv_blocks, records
from plumbline.sources.tables import coerce, read_csv


def test_csv_markers_and_coercion(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c,d\n1,"$1,200.5",x,2024-01-02\n?,NA,3,n/a\n7,3,,2024-02-03\n')
    df = read_csv(spark, f"file://{tmp_path}/a.csv")
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "timestamp"]
    assert [r.b for r in df.collect()] == [1200.5, None, 3.0]


def test_quotes_line_breaks_and_latin_text(spark, tmp_path):
    (tmp_path / "b.csv").write_text('a,b\n1,"x ""y"" z"\n2,"two\nlines, one field"\n')
    rows = read_csv(spark, f"file://{tmp_path}/b.csv").collect()
    assert [tuple(r) for r in rows] == [(1, 'x "y" z'), (2, "two\nlines, one field")]
    (tmp_path / "c.csv").write_bytes("a,b\n1,café\n".encode("latin-1"))
    assert read_csv(spark, f"file://{tmp_path}/c.csv").first().b == "café"
    (tmp_path / "d.csv").write_bytes("a,b\n1,café\n".encode())
    assert read_csv(spark, f"file://{tmp_path}/d.csv").first().b == "café"


def whole_file_reader(spark, path, encoding="UTF-8"):
    """Spark's own reader of quoted line breaks, a file a task."""
    return coerce(spark.read.options(header=True, quote='"', escape='"', multiLine=True, encoding=encoding).csv(path))


def messy(rng, n):
    field = lambda: rng.choice(["a", "b,c", 'say "x"', "two\nlines", "", "é日", "\n", '"', "3", "NA", "x" * rng.randrange(200), 'end"\n"start'])
    rows = [[str(i), *(field() for _ in range(3))] for i in range(n)]
    text = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set('",\n') or rng.random() < 0.2 else v
    return "id,s,t,`u.v`\n" + "".join(",".join(map(text, r)) + "\n" for r in rows)


@pytest.mark.parametrize("size", [97, 300, 1500, 10**8])
def test_one_file_in_many_tasks_equals_the_whole_file_reader(spark, tmp_path, size):
    rng = random.Random(size)
    (tmp_path / "a.csv").write_text(messy(rng, 400))
    (tmp_path / "b.csv").write_text(messy(rng, 30))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    want = sorted(map(str, whole_file_reader(spark, f"file://{tmp_path}/*.csv").collect()))
    spark.conf.set(key, str(size))
    try:
        found, broken, _ = csv_blocks.records(spark, f"file://{tmp_path}/*.csv")
        assert broken and (found.where("not header").count(), found.where("header").count()) == (430, 2)
        assert size > 1500 or csv_blocks._lines(spark, f"file://{tmp_path}/a.csv").rdd.getNumPartitions() > 5
        df = read_csv(spark, f"file://{tmp_path}/*.csv")
        assert sorted(map(str, df.collect())) == want and df.columns == ["id", "s", "t", "`u.v`"]
    finally:
        spark.conf.set(key, before)


def test_csv_edges(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    assert [tuple(r) for r in read_csv(spark, f"file://{tmp_path}/r.csv").collect()] == [(1, "x\r\ny"), (2, "z")]
    (tmp_path / "l.csv").write_bytes('a,b\n1,"caf\u00e9\nx"\n'.encode("latin-1"))
    assert read_csv(spark, f"file://{tmp_path}/l.csv").first().b == "caf\u00e9\nx"
    (tmp_path / "o.csv").write_text('a,b\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="never closed"):
        read_csv(spark, f"file://{tmp_path}/o.csv")
    (tmp_path / "e.csv").write_text("a,b\n")
    assert read_csv(spark, f"file://{tmp_path}/e.csv").count() == 0
    (tmp_path / "h.csv").write_text('"a\nb",c\n"1\n",2\n3\n')
    df = read_csv(spark, f"file://{tmp_path}/h.csv")
    assert df.columns == ["a\nb", "c"] and sorted(map(str, (tuple(r) for r in df.collect()))) == ["(1, 2)", "(3, None)"]


def test_json_array_round_trip(spark, tmp_path):
    kind = "id string, n int, note string, tags array<string>, `a.b` double"
    rows = [(f"q{i:03}", i, None if i % 3 else 'say "x"\nline : two', [str(i)], i / 2) for i in range(50)]
    df, at = spark.createDataFrame(rows, kind), f"file://{tmp_path}/questions.json"
    for options in ({}, {"indent": False}, {"fields": {"dataset": '"d"', "n": "50"}}):
        records.write_json_array(df, at, ["id"], **options)
        held = json.loads((tmp_path / "questions.json").read_text())
        items = held["questions"] if "fields" in options else held
        assert [x["id"] for x in items] == [r[0] for r in rows] and items[1] == {"id": "q001", "n": 1, "note": None, "tags": ["1"], "a.b": 0.5} and items[0]["note"] == 'say "x"\nline : two'
        back = records.read_json_array(spark, at, kind)
        assert sorted(map(tuple, back.select("id", "n", "note", "tags", "`a.b`").collect())) == sorted(rows)
    assert (tmp_path / "questions.json").read_text().startswith('{"dataset": "d", "n": 50, "questions": [\n  {\n    "id"')
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["questions.json"]
    records.write_json_array(df.limit(0), at, ["id"])
    assert json.loads((tmp_path / "questions.json").read_text()) == []


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    at = f"file://{tmp_path}/q.json"
    records.write_json_array(spark.range(3), at, ["id"])
    old = (tmp_path / "q.json").read_text()
    with pytest.raises(Exception, match="broken row"):
        records.write_json_array(spark.range(100).selectExpr("if(id = 77, cast(raise_error('broken row') as bigint), id) as id"), at, ["id"])
    assert (tmp_path / "q.json").read_text() == old


def test_upsert_of_an_array_file(spark, tmp_path):
    at = f"file://{tmp_path}/q.json"
    kind = "id string, v int"
    records.upsert_json_array(spark, at, spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], kind), kind)
    records.upsert_json_array(spark, at, spark.createDataFrame([("b", 3), ("c", 4)], kind), kind)
    assert json.loads((tmp_path / "q.json").read_text()) == [{"id": None, "v": 9}, {"id": "a", "v": 1}, {"id": "b", "v": 3}, {"id": "c", "v": 4}]
