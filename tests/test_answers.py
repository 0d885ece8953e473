import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.records import answers
from plumbline.records.answers import Comparison, digest

SAME = [
    (1.0, 1.05),
    ("true", True),
    ("a–b", "a-b"),
    ('{"mean": 4.6}', {"mean": 4.65}),
    ({"mean": 4.6}, 4.65),
    ({"correlation": -0.5}, {"correlation": 0.5}),
    ({"method_choice": "Mann-Whitney U test"}, {"method_choice": "mann_whitney_u"}),
    ({"group1": "f", "mean1": 75, "mean2": 78}, {"group1": "m", "mean1": 78, "mean2": 75}),
    (["a", "b"], ["b", "a"]),
    ({"x": 1, "const": 5}, {"x": 1}),
    ({"answer": "Yes ", "p_value": 0.011}, {"answer": "yes", "p_value": 0.0125}),
]
OTHER = [
    (1.0, 1.2),
    ("a", "b"),
    ([1, 2], [2, 1]),
    ({"x": 1}, {"y": 1}),
    ({"answer": "yes", "p_value": 0.01}, {"answer": "yes", "p_value": 0.02}),
    ({"significance_score": 0.01, "const": 1}, {"significance_score": 0.01}),
    ({"p_value": 0.5, "correlation": -0.5}, {"p_value": 0.5, "correlation": 0.5}),
    ({"mean": 4.6}, 5),
    (None, 1),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert Comparison()(a, b) and Comparison()(b, a)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not Comparison()(a, b) and not Comparison()(b, a)


def test_digest():
    assert digest('{"b": 1.001, "a": [2]}') == digest('{"a": [2], "b": 1.0}') != digest('{"a": [2], "b": 1.1}')
    assert digest(None) is None and len(digest("x")) == 16


def greedy(values):
    clusters = []
    for i, v in values:
        home = next((c for c in clusters if abs(c[0] - v) <= 0.1), None)
        if home is None:
            clusters.append([v, 1, i])
        else:
            home[1] += 1
    return sorted(clusters, key=lambda c: -c[1])


def test_votes_as_one_by_one(spark):
    rnd = random.Random(3)
    rows = [(q, i, rnd.random() < 0.8, str(round(rnd.choice([42.0, 42.06, 42.12, 42.2, 100.0]), 2))) for q in range(40) for i in range(rnd.randrange(1, 14))] + [(99, 0, True, None), (None, 0, True, "1")]
    got = {r.question_id: r for r in answers.answer_distribution(spark.createDataFrame(rows, "question_id long, idx long, success boolean, answer string")).collect()}
    for q in range(40):
        own = [(i, float(a)) for k, i, ok, a in rows if k == q and ok]
        want = greedy(own)
        assert [(float(c.answer), c.votes) for c in got[q].clusters] == [(v, n) for v, n, _ in want]
        assert math.isclose(got[q].entropy, -sum(n / len(own) * math.log2(n / len(own)) for _, n, _ in want) + 0.0, abs_tol=1e-9)
    assert got[99].n_clusters == 0 and got[99].confidence == 0 and got[99].majority is None
    assert got[None].majority == "1"


def test_majority_within_tolerance(spark):
    rows = [(1, i, True, a) for i, a in enumerate(["42.0", "42.05", "42.08", "100.0"])]
    r = answers.answer_distribution(spark.createDataFrame(rows, "question_id long, idx long, success boolean, answer string")).first()
    assert (r.majority, r.majority_votes) == ("42.0", 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "question_id long, idx long, success boolean, answer string")
    d = answers.answer_distribution(none)
    assert d.count() == 0
    assert answers.classify_failures(d, none).count() == 0
    assert answers.verification_by_runs(none, none).count() == 0


def test_normalized(spark):
    one = lambda rows, schema: answers.normalized(spark.createDataFrame(rows, schema)).first().answer
    assert one([], "a int") == "{}" and one([(3,)], "a int") == "3" and json.loads(one([("x",)], "a string")) == "x"
    assert sorted(json.loads(one([(1,), (2,)], "a int"))) == [1, 2]
    assert json.loads(one([("a", 1), ("b", 2)], "a string, b int")) == {"a": 1, "b": 2}
    assert json.loads(one([("a", 1, 2.5)], "a string, b int, c double")) == [{"a": "a", "b": 1, "c": 2.5}]


def test_valid_answers_keep_each_hash_once(spark):
    rows = [(1, 0, "2.0"), (1, 1, "2.001"), (1, 2, "3.0"), (1, 3, None)]
    r = answers.valid_answers(spark.createDataFrame(rows, "question_id long, place int, answer string")).first()
    assert r.ground_truth == "2.0" and r.hashes == [digest("2.0"), digest("3.0")]


def test_scalar_hash_without_python(spark):
    df = spark.createDataFrame([(1.25,), (-2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(answers.number_hash(F.col("x"))).collect()] == [digest("1.25"), digest("-2.0"), None]


NESTED = [
    ({"a": {"mean1": 1, "mean2": 9}, "b": 2}, {"a": {"mean1": 9, "mean2": 1}, "b": 2}, True),
    ({"mean1": 1, "mean2": 9, "n1": 3, "n2": 4}, {"mean1": 9, "mean2": 1, "n1": 3, "n2": 4}, False),  # all pairs turn together
    ({"mean1": 1, "mean2": 9, "x": 2}, {"mean1": 9, "mean2": 1, "x": 3}, False),
    ({"mean1": 1}, {"mean1": 1.05}, True),
    ({"p_value": 0.01, "mean1": 1, "mean2": 9}, {"p_value": 0.01, "mean1": 9, "mean2": 1}, False),
    ({"p_value": "0.0100"}, {"p_value": 0.011}, True),
    ({"p_value": "low"}, {"p_value": "low"}, True),
    ({"p_value": 0.01, "significance_score": 1}, {"p_value": 0.01, "significance_score": 2}, True),
    ({"p_value": 0.01, "significance_score": 1}, {"p_value": 0.01}, False),
    ([["a", "b"], 1], [["b", "a"], 1.05], True),
    ([], {}, False),
    ({}, {}, True),
    ([1], [1, 2], False),
    ({"const": 5, "mean": 1}, 5, True),
    ({"m": {"x": 3}}, {"m": 3.02}, True),
    ({"group1": "a"}, {}, True),
    (None, None, True),
    ({"x": None}, {"x": None}, True),
    (True, "TRUE", True),
    (True, 1, True),
    ("ﬁne – x", "fine - x", True),
    ({"test_used": "Welch (unequal) t-test"}, {"test_used": "welch t"}, True),
]


@pytest.mark.parametrize("a,b,same", NESTED)
def test_nested_answers(a, b, same):
    assert Comparison()(a, b) == same == Comparison()(b, a)


ALIASED = [
    ({"target": "x", "fit_score": 0.5}, {"Target-Column": "x ", "r2": 0.55, "more": 1}, "match"),
    ({"target": "x", "fit_score": 0.5}, {"target": "x"}, "missing keys: fit_score"),
    ({"target": "x"}, {"target": None, "target_col": "y"}, "value mismatch"),
    ({"target": "x"}, {"target": None}, "missing keys: target"),
    ({"target": "x"}, [1], "actual answer is not an object"),
    ({"target": "x"}, None, "actual answer is not an object"),
    ({"significance_score": 0.01}, {"p": 0.0115}, "match"),
    ({"significance_score": 0.01}, {"p": 0.1}, "value mismatch"),
    ({"columns": ["a", 2]}, {"pair": [2, "a"]}, "match"),
    ({"A-b": 1, "a_b": 2}, {"a_b": 2.0}, "match"),
    (3, 3.05, "match"),
    ("x", " x", "match"),
    ("x", {"x": 1}, "value mismatch"),
    ({"significant": "True"}, {"is_significant": True}, "match"),
]


def test_other_names_of_keys(spark):
    rows = [(i, json.dumps(a), None if b is None else json.dumps(b)) for i, (a, b, _) in enumerate(ALIASED)]
    df = spark.createDataFrame([*rows, (98, None, "1"), (99, "not json", "not json")], "i int, want string, have string")
    got = {r.i: (r.matched, r.reason) for r in answers.with_alias_match(df, "want", "have").collect()}
    for i, (a, b, reason) in enumerate(ALIASED):
        assert got[i] == (reason == "match", reason), (a, b)
    assert got[98] == (False, "value mismatch") and got[99] == (True, "match")
    own = {r.i: r.matched for r in answers.with_alias_match(df, "want", "have", {"target": ["more"]}, ()).collect()}
    assert not own[0] and not own[8]


def test_a_text_is_read_once_and_compared_only_where_that_decides(spark):
    rows = [(0, '{"target": 1}', '{"Target": 5, "target": 1}'), (1, '{"target": 1}', '{"other": 1}'), (2, ' {"a-b": 2, "a_b": 1}', '\n{"A_B": 1.05}'), (3, '{"target": 1', '{"target": 1'), (4, "{}", '{"x": 1}')]
    got = answers.with_alias_match(spark.createDataFrame(rows, "i int, want string, have string"), "want", "have")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 2
    asked = plan[plan.index("of(CASE") :].split("\n")[0]
    assert "size(missing" in asked
    assert [(r.i, r.reason) for r in got.orderBy("i").collect()] == [(0, "match"), (1, "missing keys: target"), (2, "match"), (3, "match"), (4, "match")]
