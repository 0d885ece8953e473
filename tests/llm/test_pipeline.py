import os
import random
import zlib

import pytest

import corpus_pipeline
from plumbline.llm import runtime
from plumbline.llm.queries import QUERIES
from plumbline.scratch import shared_dir


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéß") for _ in range(6)) for _ in range(n))


def test_stages_on_planted_cases(spark, tmp_path):
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(300):
        t = words(rnd, 40)
        if i % 10 == 3:
            t += ". " + words(rnd, 5) + " zorgle. " + words(rnd, 5)
        docs.append((i, t))
        labels.append((i, 1, int(i % 10 == 3)))
    copy, item, passage = docs[20][1], words(rnd, 25), words(rnd, 60)
    docs += [(400, copy), (401, copy + " extra"), (402, f"{words(rnd, 20)}. {item}. {words(rnd, 20)}")]
    docs += [(410 + i, f"{words(rnd, 90)} {passage} {words(rnd, 90)}") for i in range(3)]
    docs += [(500, None), (501, "")]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.keep(stage(spark, at, str(tmp_path)), name)
        left[name] = {r.doc_id: r for r in at.collect()} if name != "packing" else at.collect()
    bad = {d for d, _, x in labels if x}
    everything = {d for d, _ in docs}
    assert set(left["toxicity"]) == everything - bad
    assert set(left["near_duplicates"]) == everything - bad - {400, 401}
    texts = left["repeats"]
    assert [passage in texts[410 + i].text for i in range(3)] == [True, False, False]
    assert all(t[1] == texts[t[0]].text for t in docs if t[0] in texts and t[0] < 410 and t[1])
    assert set(left["decontamination"]) == everything - bad - {400, 401, 402}
    assert {r.doc_id for r in left["packing"]} == set(left["decontamination"])


def test_decisions_are_about_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_IDS", 0)  # the shuffled joins
    rnd = random.Random(12)
    clean = [words(rnd, 40) for _ in range(120)]
    foul = lambda t: f"{t}. {words(rnd, 4)} zorgle."
    rows = [(i, foul(t) if i % 4 == 1 else t) for i, t in enumerate(clean)]
    rows += [(200, words(rnd, 40)), (200, foul(words(rnd, 40))), (None, words(rnd, 40)), (None, foul(words(rnd, 40)))]
    twin, item, passage = words(rnd, 50), words(rnd, 25), words(rnd, 60)
    rows += [(300, twin), (300, twin), (300, twin + " more"), (None, twin + " else"), (None, None), (None, ""), (301, None)]
    rows += [(400, f"{words(rnd, 30)} {passage}"), (400, f"{words(rnd, 30)} {passage}"), (None, f"{words(rnd, 20)}. {item}."), (402, words(rnd, 30))]
    rows += [rows[-4]] * 2
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, _row int, n_chars long"
    start = at = spark.createDataFrame([(d, t, "en", 7, 0) for d, t in rows], kind)
    got = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = corpus_pipeline.keep(stage(spark, at, str(tmp_path)), name)
        assert at.dtypes == start.dtypes
        got.append([(r.doc_id, r.text) for r in at.collect()])
    first = [r for r in rows if "zorgle" not in (r[1] or "")]
    assert sorted(map(str, got[0])) == sorted(map(str, first))
    group = {(300, twin), (300, twin + " more"), (None, twin + " else")}
    stays = group & set(got[1])
    assert len(stays) == 1 and next(iter(stays))[0] == 300  # of two texts of that id either
    second = [r for r in dict.fromkeys(first) if r not in group or r in stays]
    assert sorted(map(str, got[1])) == sorted(map(str, second))
    assert sum(passage in (t or "") for _, t in got[2]) == 1 and len(got[2]) == len(second)
    assert len(got[3]) == len(second) - 1 and not any(item in (t or "") for _, t in got[3])
    empty = start.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


DOCS, LABELS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"


def tables(spark, at, docs=(), labels=(), items=(), extra=""):
    for name, rows, kind in (("documents", docs, DOCS + extra), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(list(rows), kind).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("some", ["nothing", "documents", "labels", "held out"])
def test_empty_parquet_tables(spark, tmp_path, some):
    """Without documents, without labels, or with held-out labels alone, nothing fails and nothing is judged toxic."""
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 15 == 10)  # a fold that op6 and op8 both hold out
    docs = [(i, f"some words here {i}. and more of them", "en", "s", 9) for i in (*range(12), held)] if some in ("documents", "held out") else []
    labels = {"nothing": [], "documents": [], "labels": [(i, i % 2, i % 2) for i in range(12)], "held out": [(held, 1, 1)]}[some]
    at = tables(spark, tmp_path, docs, labels)
    for name in ("op6_toxicity", "op8_quality"):
        rows = QUERIES[name](spark, at).collect()
        assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    packed = corpus_pipeline.run(spark, at).select("doc_id").distinct().count()
    assert packed == len({d[0] for d in docs})


def test_odd_columns_go_through_and_tables_go_away(spark, tmp_path):
    docs = [(i, f"{'one two three four five six seven '[i % 7 :] * 3} {i}", "en", "s", 9, 1, {"k": i}, 2) for i in range(9)]
    docs += [docs[0], (*docs[0][:6], {"k": 99}, 3), (None, None, None, None, None, None, None, None)]
    at = tables(spark, tmp_path, docs, [(1, 1, 0)], [(1, "nothing of this")], ", `a.b` int, m map<string,int>, `row` int")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, at).where("doc_id is null").count() == 1
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["packing"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, at)
        assert docs.dtypes == spark.read.parquet(f"{at}/documents.parquet").dtypes
    assert len({r.doc_id for r in docs.collect()}) == docs.count()
