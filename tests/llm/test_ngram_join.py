import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import ngram_join
from plumbline.llm.ngram_join import allocation, band_edges, jaccard_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    ids = sorted(sets)
    at = {d: d for d in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                at[q] = p
    return {(d, len(sets[d]), find(d)) for d in ids}


def corpus(seed, groups, copies):
    rnd = random.Random(seed)
    rows, n = [(0, None), (1, ""), (2, "  \n"), (3, "Hi"), (4, "hi"), (5, "a b c d"), (6, "A b  c\td")], 7
    for _ in range(groups):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([3, 6, 12, 40, 120, 400]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randrange(0, 2 + len(t) // 25)):
                t[rnd.randrange(len(t))] = f"x{rnd.randrange(1000)}"
            rows.append((n, " ".join(t)))
            n += 1
    return rows


def run(spark, rows, k, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r)[:3] for r in jaccard_components(df, k, num, den).collect()}


def test_matches_brute_force(spark):
    rows = corpus(1, 30, 5)
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_large_group_of_near_copies(spark, monkeypatch):
    rows = corpus(5, 2, 90)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)  # the shuffled joins
    assert run(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, set_id string")
    assert jaccard_components(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y")], "doc_id long, text string, set_id string")
    assert {r.component_id for r in jaccard_components(df).collect()} == {1}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 10**7), st.sampled_from([(85, 100), (80, 100), (50, 100)]))
def test_allocation_leaves_a_whole_segment(size, sets, t):
    low, high = next(b for b in band_edges(*t, 5000) if b[0] <= size <= b[1])
    exact, neighbours, spare = allocation(low, high, sets, *t)
    most = max((t[1] - t[0]) * (x + y) // (t[1] + t[0]) for x in (low, high) for y in (x, x * t[1] // t[0]))
    assert exact - spare + 2 * neighbours > most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.data())
def test_a_pair_still_meets_when_each_leaves_out_its_smallest_segments(sizes, data):
    spare = data.draw(st.integers(0, len(sizes) - 1))
    differ = data.draw(st.sets(st.integers(0, len(sizes) - 1), max_size=len(sizes) - spare - 1))  # H at most, with one segment more than H + spare
    other = [data.draw(st.integers(0, 3)) if i in differ else n for i, n in enumerate(sizes)]
    sent = [set(np.argsort(np.array(x), kind="stable")[spare:].tolist()) for x in (sizes, other)]
    assert (sent[0] & sent[1]) - differ


def test_common_segment_among_unlike_documents(spark):
    rnd = random.Random(12)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage, bases = words(30), [words(60) for _ in range(12)]
    rows = [(i, f"{passage} {bases[i % 12] if i % 3 else words(60)} {words(rnd.randrange(4))}") for i in range(120)]
    assert run(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)


def test_words_that_fool_polynomial_hashes(spark):
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    rows = [(1, "".join("ab"[x] for x in word)), (2, "".join("ba"[x] for x in word))]
    assert run(spark, rows, 5, 80, 100) == {(1, 1, 1), (2, 1, 2)}


def test_repeated_ids_and_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (None, a + " x z"), (4, "c d e")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect())
    assert got[0] == (0, 58, 1)  # the null id links like any other
    assert [x for x in got if x[0]] == [(1, 56, 1), (1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (3, 57, 1), (4, 1, 4)]
    assert len(got) == len(rows)
