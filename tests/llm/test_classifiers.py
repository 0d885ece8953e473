import math
import random
import re

import numpy as np

from plumbline.llm import language_id, quality, toxicity
from plumbline.llm.kernels import span_hashes


def words(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 8))) for _ in range(n))


def corpus(rnd, n):
    docs, labels, bad = [], [], {}
    for i in range(n):
        parts = [words(rnd, rnd.randrange(4, 12)) for _ in range(rnd.randrange(1, 9))]
        if i % 6 == 0:
            k = rnd.randrange(len(parts))
            parts[k] += " " + rnd.choice(["zorgle", "Zorgling", "qwaxed", "qwaxes", "vuntish"])
            bad[i] = parts[k]
        docs.append((i, ". ".join(parts) + "."))
        labels.append((i, int(i % 6 != 0), int(i % 6 == 0)))
    return docs, labels, bad


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    out = [int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])]
    for k in toxicity.BEGINNINGS:
        out.append(int(span_hashes(data, np.array([0]), np.array([min(k, len(data))]))[0]) ^ (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return [h % toxicity.BUCKETS for h in out]


def test_toxicity_scores_as_sentence_by_sentence(spark):
    rnd = random.Random(4)
    docs, labels, bad = corpus(rnd, 600)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, offending string")
    model = toxicity.train(df.where("doc_id % 5 <> 0"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weights, bias = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True)), float(model["b"][0])
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for i, t in docs[:80]:
        clear = 1.0
        for s in re.split(r"[.!?\n]", t):
            seen = {b for w in re.findall(r"[a-zA-Z0-9]+", s) for b in hashed(w.lower())}
            if seen:
                clear *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(b, 0.0) for b in seen))))
        assert math.isclose(got[i].score, 1 - clear, rel_tol=1e-6, abs_tol=1e-9)
    held = [i for i, _ in docs if i % 5 == 0]
    assert all((got[i].score >= 0.5) == (i in bad) for i in held)
    for i in held:
        spans = [docs[i][1][x.start : x.end] for x in got[i].offending]
        assert spans == ([bad[i]] if i in bad else [])


def test_quality_scores_as_passage_by_passage(spark):
    rnd = random.Random(5)
    docs = [(i, (words(rnd, rnd.randrange(60, 200)) + ". ") if i % 2 else " ".join(["$$ 99 !!"] * rnd.randrange(20, 90))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    m = quality.train(df.where("doc_id % 3 <> 1"), labels)
    got = {r.doc_id: r for r in quality.score(df, m).collect()}
    for i, t in [*docs[:20], (900, ""), (901, "")]:
        data = np.frombuffer(t.encode(), np.uint8)
        x, _ = quality.passages(data, np.array([0, len(data)]))
        h = [np.tanh(((p - m["mean"]) / m["scale"]) @ m["W"] + m["c"]) for p in x]
        e = [float((np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"])))) @ m["a"]) for v in h]
        k = np.exp(np.array(e) - max(e))
        k /= k.sum()
        z = sum(w * v for w, v in zip(k, h, strict=True))
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-(z @ m["o"] + m["d"][0]))), rel_tol=1e-6)
        assert got[i].n_passages == len(x) and math.isclose(got[i].top_weight, k.max(), rel_tol=1e-6)
    held = [i for i, _ in docs if i % 3 == 1]
    assert np.mean([(got[i].score >= 0.5) == (i % 2 == 1) for i in held]) > 0.97


def test_language_is_the_smallest_compression(spark):
    import zstandard as z

    rnd = random.Random(6)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "éàüxyz"}
    vocabulary = {k: words(rnd, 80, x).split() for k, x in letters.items()}
    docs = [(i, " ".join(rnd.choices(vocabulary[k], k=rnd.randrange(3, 400))), k) for i in range(240) for k in [rnd.choice(sorted(letters))]] + [(900, None, "aa"), (901, "12 34", "bb"), (902, words(rnd, 3000, "abcdef"), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id % 4 <> 2"))
    assert set(model) == set(letters)
    got = {r.doc_id: r for r in language_id.classify(df, model).collect()}
    coders = {}
    for k in sorted(model):
        d = z.ZstdCompressionDict(model[k], dict_type=z.DICT_TYPE_RAWCONTENT)
        coders[k] = z.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    for i, t, _ in docs:
        if not t or not re.search("[a-zé]", t):
            assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
            continue
        raw = t.encode()
        size = {k: sum(len(c.compress(raw[a : a + language_id.CHUNK])) for a in range(0, len(raw), language_id.CHUNK)) for k, c in coders.items()}
        assert got[i].lang_pred == min(sorted(size), key=size.get)
    assert np.mean([got[i].lang_pred == k for i, t, k in docs[:240] if i % 4 == 2]) > 0.9


def test_language_pieces_come_from_whole_texts(spark):
    head, tail = "a" * 5000, "b" * 50000
    model = language_id.train(spark.createDataFrame([(i, f"{head}{tail}", "xx") for i in range(60)], "doc_id long, text string, lang string"))
    share = model["xx"].count(b"b") / len(model["xx"])
    assert share > 0.8
