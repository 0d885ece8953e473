import collections
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as H
from plumbline.llm.queries import ORACLE_SQL, QUERIES

KIND = "vec_id long, embedding array<float>, label int, score long, `a.b` string"


def brute(rows):
    """Every anchor against every row, in whole numbers."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda s, i: (-s, i is None, i or 0)
    out = collections.Counter()
    for a, (ai, av, ay) in enumerate(good):
        if ai is None or ai % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, y == ay) for b, (i, v, y) in enumerate(good) if b != a]
        for ps, pi, _ in sorted((x for x in scored if x[2]), key=lambda x: place(x[0], x[1]))[:5]:
            fits = sorted((x for x in scored if not x[2] and 30 * ps <= 100 * x[0] <= 90 * ps), key=lambda x: place(x[0], x[1]))[:10]
            for rank, (ns, ni, _) in enumerate(fits, 1):
                out[(ai, pi, rank, ni, ps, ns)] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], KIND)


@pytest.mark.parametrize("block_rows", [7, 60, None])
def test_equals_brute_force_on_odd_rows(spark, monkeypatch, block_rows):
    monkeypatch.setattr(H, "LEAF", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.3, (6, 5))
    rows = [(int(i), (centres[i % 6] + rng.normal(0, 0.1, 5)).tolist(), int(i % 6 if i % 3 else rng.integers(10))) for i in range(0, 400)]
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(60)]  # one very common vector
    rows += [(200, rows[200][1], rows[200][2]), (100, rows[100][1], rows[100][2]), (None, rows[3][1], 3), (None, rows[3][1], 4)]
    rows += [(300, None, 1), (2000, [None] * 5, 1), (2100, [math.nan] * 5, 1), (2200, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (2300, rows[5][1], None), (2400, [], 2), (2500, [0.0] * 5, 2), (2600, [0.5, 0.5], 3)]
    df = H.usable(table(spark, rows)).selectExpr("vec_id", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label", "embedding")
    got = collections.Counter(map(tuple, H.mine(df, F.col("vec_id") % 100 == 0, block_rows=block_rows).collect()))
    want = brute(rows)
    assert got == want and len(want) > 100


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 3) * 5000000).tolist(), i % 2) for i in range(0, 210, 2)]
    assert collections.Counter(map(tuple, H.digest(table(spark, rows)).collect())) == brute(rows)
    assert H.digest(table(spark, [])).count() == 0 and H.digest(table(spark, [(100, [1.0], 3)])).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    rel = con.execute(ORACLE_SQL["op12_hard_negatives"])
    cols = [c[0] for c in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.01").select(*cols).collect())) == want and want


def test_bounds_hold_for_every_row_below_a_node():
    rng = np.random.default_rng(1)
    x = H.whole_numbers(np.concatenate([rng.normal(0, 1, (300, 8)), rng.normal(2, 0.1, (300, 8))]).astype(np.float32))
    t = H.Tree(np.arange(600), np.repeat([1, 2], 300), x)
    anchors = np.concatenate([t.x[::97], np.zeros((1, 8))])
    low, high = t.bounds(anchors)

    def rows(node):
        own = np.arange(t.first[node], t.first[node] + t.n[node])
        return own if t.leaf[node] else np.concatenate([rows(c) for c in own])

    assert sorted(np.concatenate([rows(r) for r in t.roots]).tolist()) == list(range(600))
    for node in range(len(t.centre)):
        s = anchors @ t.x[rows(node).astype(int)].T
        assert (low[:, node] <= s.min(1)).all() and (s.max(1) <= high[:, node]).all()


def test_ragged_vectors_become_a_matrix():
    assert H.matrix(pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float32()))).tolist() == [[1, 2], [0, 0], [3, 0]]


def sent_to_driver(spark):
    """Bytes of the tasks' results so far, by stage, without 20,000 of metrics a task."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {x.stageId(): max(0, x.resultSize() - 20_000 * x.numTasks()) for x in map(stages.apply, range(stages.size()))}


def test_driver_gets_neither_the_table_nor_copies_of_the_anchors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.2, (4000, 64))
    df = H.usable(table(spark, [(i, v[i].tolist(), i % 5) for i in range(4000)])).repartition(16).localCheckpoint()
    before = sent_to_driver(spark)
    got = H.mine(df, F.col("vec_id") % 50 == 0, block_rows=20)
    got.write.format("noop").mode("overwrite").save()
    after = sent_to_driver(spark)
    # 200 reference points are 51 KB; the table is 1 MB, and 80 anchors once for each of 200 blocks 4 MB
    assert sum(after[k] - before.get(k, 0) for k in after) < 150_000


@pytest.mark.parametrize("rows", [[(7, [1.0, 2.0], 1)] * 900, [(i, [float(i % 3), 1.0], 1) for i in range(900)]])
def test_few_reference_points_come_from_any_table(spark, rows):
    points = H._pivots(H.usable(table(spark, rows)), 4, len(rows))
    assert 1 <= len(points) <= 4 and {tuple(p) for p in points.tolist()} <= {tuple(v) for _, v, _ in rows}


def test_what_was_found_bounds_later_trees():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (900, 6)).astype(np.float32)
    ids, labels = rng.permutation(900), rng.integers(0, 3, 900)
    whole = H.whole_numbers(x)
    asked = ids[:40]
    group = pa.RecordBatch.from_pylist([{"asked": asked.tolist(), "kinds": labels[:40].tolist(), "asked_width": 6, "asked_vectors": x[:40].tobytes(), "windows": [[int(w) for w in (whole[i] @ whole.T)[:2]] for i in range(40)]}])
    for same, k in ((True, 5), (False, 10)):
        state = H._Asked(group, 0)
        for part in np.array_split(np.arange(900), 7):
            t = H.Tree(ids[part], labels[part], whole[part])
            state.meet(t, t.ids, k, same, 30, 90)
        for i in range(40):
            scores = whole[i] @ whole.T
            for w in [None] if same else set(group.column("windows")[0].as_py()[i]):
                fit = (labels == labels[i]) == same
                fit[i] = False
                if not same:
                    fit &= (30 * w <= 100 * scores) & (100 * scores <= 90 * w)
                want = sorted((-int(s), int(y), int(y)) for s, y in zip(scores[fit], ids[fit]))[:k]
                assert state.best.get((i, w), []) == want
