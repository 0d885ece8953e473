import json

import pytest
from pyspark.sql import functions as F

from plumbline.records import evaluation, filters, manifests, traces, training
from plumbline.sources import records


def test_json_lines_modes(spark):
    lines = spark.createDataFrame([('{"id": 1, "x": "a"}',), ("  ",), ('{"id": 2',), ("[1]",), ("null",), ('{"x": "b"}',)], "value string")
    lenient = records.parse_lines(lines, "id long, x string")
    assert sorted((r.id or 0, r.x) for r in lenient.collect()) == [(0, "b"), (1, "a")]
    counted = records.parse_lines(lines, "id long, x string", "counted")
    assert counted.where("_malformed").count() == 3 and counted.count() == 5
    with pytest.raises(Exception, match="malformed line"):
        records.parse_lines(lines, "id long, x string", "strict").collect()
    with pytest.raises(ValueError):
        records.parse_lines(lines, "id long", "other")


def test_files_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, v string, w string")
    b = spark.createDataFrame([(2, "B", "y"), (3, "c", None), (None, "n", None)], "id long, v string, w string")
    records.write_jsonl(a, f"{tmp_path}/q", "overwrite")
    records.upsert_jsonl(spark, f"{tmp_path}/q", b, f"{tmp_path}/r", "id long, v string, w string")
    got = records.read_jsonl(spark, f"{tmp_path}/r", "id long, v string, w string").drop("file").collect()
    assert sorted((r.id or 0, r.v) for r in got) == [(0, "n"), (1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError):
        records.upsert_jsonl(spark, f"{tmp_path}/q", b, f"{tmp_path}/q/", "id long")
    lines = spark.createDataFrame([("f", 1, "old"), ("g", 2, "g"), ("f", 3, "new")], "fingerprint string, line long, status string")
    records.write_jsonl(lines, f"{tmp_path}/m")
    records.compact_manifest(spark, f"{tmp_path}/m", f"{tmp_path}/n", "fingerprint string, line long, status string", ["fingerprint"], ["line"])
    assert sorted(r.status for r in records.read_jsonl(spark, f"{tmp_path}/n", "fingerprint string, status string").collect()) == ["g", "new"]
    for name in ("train", "val"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": name}) + "\n")
    assert {(r.id, r.split) for r in records.read_splits(spark, str(tmp_path), "id string").collect()} == {("train", "train"), ("val", "val")}
    records.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string"), f"{tmp_path}/s")
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=test", "split=train"]
    records.write_text(spark, evaluation.report(spark.createDataFrame([("a|b", 1)], "g string, n long"), "Title"), f"{tmp_path}/t")
    assert "a\\|b" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/t").collect())


def test_json_arrays_and_elements(spark):
    texts = spark.createDataFrame([('[{"id": "a"}, {"id": "b"}]',)], "value string")
    rows = records.json_array(texts, "id string")
    assert records.element(rows, 1).first().id == "b"
    with pytest.raises(Exception, match="no element 5"):
        records.element(rows, 5).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        records.json_array(spark.createDataFrame([("[{",)], "value string"), "id string").collect()


def test_discovery_and_description(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.csv").write_text("a\n1\n")
    found = records.discover(spark, str(tmp_path))
    assert {r.dataset for r in found.collect()} == {"one", "two"}
    listed = spark.createDataFrame([("two", 0)], "dataset string, place int")
    assert [r.dataset for r in records.discover(spark, str(tmp_path), manifest=listed).collect()] == ["two"]
    d = spark.createDataFrame([('{"description": " ", "title": "T"}', "x"), ("{}", "A. B. C. D."), (None, None)], "m string, o string")
    assert [r[0] for r in d.select(records.description(F.col("m"), F.col("o"))).collect()] == ["T", "A. B. C", None]


def test_output_lines(spark):
    hook = '📍 Hook: {"__hook__": true, "variable_name": "x", "value": [1, 2], "value_hash": "h"}'
    out = "\n".join(["noise", hook, '📍 Hook: {"value": 1}', "📍 Hook: {broken", '✓ Submitted: {"__answer__": {"a": 1}}', '✓ Submitted: {"other": 1}', '✓ Submitted: {"__answer__": 2}'])
    other = out.replace("__hook__", "h_1").replace("__answer__", "a_1")
    assert traces.output_records(spark.createDataFrame([(1, other)], "run_id long, stdout string"), "h_1", "a_1").count() == 3
    found = traces.output_records(spark.createDataFrame([(1, out), (2, None), (3, "")], "run_id long, stdout string"))
    (h,) = traces.hooks(found).collect()
    assert (h.run_id, h.variable_name, h.value, h.value_hash, h.code_line) == (1, "x", "[1,2]", "h", "")
    (s,) = traces.submissions(found).collect()
    assert (s.answer, s.n_submissions) == ('{"a":1}', 2)


def test_self_corrections_one_by_one(spark):
    err = "Traceback\nKeyError: 'a'\nValueError: bad  \n"
    rows = [(1, 0, True, "a", ""), (1, 1, False, "b\n c", err), (1, 2, False, "d", "boom"), (1, 3, True, "d\ne", ""), (1, 4, True, "f", ""), (2, 0, False, "x", err), (2, 1, True, " x ", ""), (3, 0, False, "x", "odd"), (3, 1, True, "y", "")]
    got = traces.self_corrections(spark.createDataFrame(rows, "trace_id long, turn_index long, success boolean, code string, stderr string"))
    assert sorted((r.trace_id, r.turn_index, r.corrects_turn, r.error_type, r.error_message, r.attempts, tuple(r.removed), tuple(r.added)) for r in got.collect()) == [(1, 3, 2, "Unknown", "boom", 1, (), ("e",)), (3, 1, 0, "Unknown", "odd", 1, ("x",), ("y",))]
    e = spark.createDataFrame([(err,), ("MyException: x",), ("fine",), (None,)], "s string").select(traces.last_error(F.col("s")).alias("e"))
    assert [(r.e.error_type, r.e.error_message) for r in e.collect()] == [("ValueError", "bad"), ("MyException", "x"), (None, None), (None, None)]


def test_grounding_and_truncation(spark):
    df = spark.createDataFrame([("a  = 1", "x\na = 1\n"), ("a = 1\nb", "a = 1"), ("", "a"), (None, "a")], "l string, c string")
    assert [r[0] for r in df.select(traces.grounded(F.col("l"), F.col("c"))).collect()] == [True, False, False, False]
    long = "x" * 100 + "\n✓ Submitted: {}"
    t = spark.createDataFrame([(long,), ("short",), (None,)], "o string").select(traces.truncated_output(F.col("o"), 20).alias("t")).collect()
    assert t[0].t.endswith("\n✓ Submitted: {}") and t[0].t.startswith("x" * 20 + "\n") and t[1].t == "short" and t[2].t is None


def test_training_formats(spark):
    hooks = [("l", "v", "1", "h")]
    turns = spark.createDataFrame([("e", 1, "r2", "c2", "out2", None, None, "7"), ("e", 0, "r1", "c1", "out1", "err1", hooks, None), ("f", 0, "", "c", "", None, None, None)], "episode_id string, turn_index long, reasoning string, code string, stdout string, stderr string, hooks array<struct<code_line:string,variable_name:string,value:string,value_hash:string>>, submitted string")
    questions = spark.createDataFrame([("e", "Q", "H", True, "hash"), ("f", "Q", None, False, None), ("g", "Q", None, True, None)], "episode_id string, question_text string, hint string, verified boolean, answer_hash string")
    eps = training.episodes(turns, questions)
    chat = {r.episode_id: [(m.role, m.content) for m in r.messages] for r in training.chat(eps).collect()}
    assert set(chat) == {"e", "f"}
    assert chat["e"][1:] == [("user", "Q\n\nHint: H"), ("assistant", "r1\n\n```python\nc1\n```"), ("user", "[stdout]:\nout1\n[stderr]:\nerr1"), ("assistant", "r2\n\n```python\nc2\n```")]
    both = {r.episode_id: [(m.role, m.content) for m in r.messages] for r in training.interleaved_chat(eps).collect()}
    assert both["e"][3:5] == [("user", "Predict the intermediate values:"), ("assistant", "v = 1")] and both["e"][-1] == ("assistant", "7")
    steps = training.scored_steps(eps).orderBy("turn_index").collect()
    assert [(s.step_type, s.value, s.label, len(json.loads(s.prefix))) for s in steps] == [("hook", "1", 1.0, 2), ("submit", "7", 1.0, 4)]
    assert {(r.episode_id, r.n_hooks) for r in training.verification_records(eps).collect()} == {("e", 1), ("g", 0)}
    with pytest.raises(ValueError):
        training.training_rows(eps, "other")


def test_filters(spark):
    q = spark.createDataFrame([("Please calculate it",), ("What about income?",), ("A. B. C. D.",), ("A. B? C! Return as JSON. e. f.",), ("Fine",), (None,)], "t string")
    assert [r[0] for r in q.select(filters.question_reason(F.col("t"), ["income", "age"])).collect()] == ["forbidden_method_terms", "mentions_column_names", "too_many_sentences", None, None, None]
    bare = filters.contract_issues(spark.createDataFrame([("1",)], "id string")).first().issues
    assert "no column source" in bare and "no text" in bare
    s = spark.createDataFrame([("Yes, p = 0.03",), ("no; p<.001",), ("maybe p=0.1",), (None,)], "t string")
    assert [r[0] for r in s.select(filters.statistical_format(F.col("t"))).collect()] == [True, True, False, False]
    none = spark.createDataFrame([], "column string, kind string, missing_pct double, unique_count long, index_like boolean, n_rows long")
    assert filters.table_reason(none).first().reason == "too_few_rows"


def test_manifest_helpers(spark):
    assert manifests.quotas(10, {"a": 0.35, "b": 0.35, "c": 0.3}) == {"a": 4, "b": 3, "c": 3} and manifests.quotas(5, {}) == {}
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "id long, g string")
    assert manifests.quota_selection(rows, "id", "g", {"a": 2, "b": 3}).groupBy("g").count().count() == 2
    assert manifests.quota_selection(rows, "id", "g", {"a": 2, "b": 4}, strict=True).count() == 0
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i long, s string")
    assert manifests.dataset_hash(a).first() == manifests.dataset_hash(b).first() != manifests.dataset_hash(a.where("i = 1")).first()
    assert manifests.dataset_hash(a.where("false")).first().dataset_hash is None
    up = manifests.upsert(spark.createDataFrame([(None, "k"), (1, "o")], "id long, v string"), spark.createDataFrame([(1, "n", 2)], "id long, v string, extra int"))
    assert sorted((r.id or 0, r.v) for r in up.collect()) == [(0, "k"), (1, "n")]


def test_name_parts(spark):
    n = spark.createDataFrame([("procedural_mean_age",), ("procedural_filter_sum",), ("x",), (None,), ("p_sort_first_name_sum",)], "n string")
    assert [(r[0], r[1]) for r in n.select(evaluation.name_prefix(F.col("n")), evaluation.operator_sequence(F.col("n"))).collect()] == [("procedural", "mean"), ("procedural", "filter>sum"), ("x", ""), ("unknown", ""), ("p", "sort>first")]
