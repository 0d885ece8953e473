import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import suffix_dedup
from plumbline.llm.suffix_dedup import longest_factors, remove_repeats


def brute(rows, length, keep_first):
    places = defaultdict(list)
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((d, i))
    gone = defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for d, i in at[1:] if keep_first else at:
                gone[d].update(range(i, i + length))
    return {(d, bytes(b for i, b in enumerate((t or "").encode()) if i not in gone[d]), len(gone[d])) for d, t in rows}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "x" * 900), (3, "ab" * 300), (4, "x" * 120)]
    for d in range(5, 60):
        parts = [text(rnd.randrange(1, 60)) for _ in range(3)]
        if rnd.random() < 0.7:
            parts.insert(1, rnd.choice(shared)[rnd.randrange(30) :])
        rows.append((d, " ".join(parts)))
    for d in range(60, 70):
        t = list(rows[rnd.randrange(5, 60)][1])
        if d % 2:
            t[len(t) // 2] = "#"
        rows.append((d, "".join(t)))
    return rows


def got(spark, rows, length, keep_first):
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, mini string")
    return {(r.doc_id, bytes(r.kept), sum(x.end - x.start for x in r.spans)) for r in remove_repeats(df, length, keep_first).collect()}


def test_matches_brute_force(spark):
    rows = corpus(3)
    for keep_first in (True, False):
        assert got(spark, rows, 100, keep_first) == brute(rows, 100, keep_first)


def test_counted_windows_for_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 300)
    rows = corpus(4)
    for keep_first in (True, False):
        assert got(spark, rows, 80, keep_first) == brute(rows, 80, keep_first)


def covered(rows, length, later):
    places = defaultdict(list)
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((d, i))
    out = defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for d, i in at[1:] if later else at:
                out[d].update(range(i, i + length))
    return {d: sorted(out[d]) for d, _ in rows}


def test_shorter_passages_from_the_same_arrays(spark, monkeypatch):
    rows = corpus(6)
    for group_bytes in (8_000_000, 300):
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
        for keep_first in (True, False):
            out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 120, keep_first, passage=50).collect()
            assert {(r.doc_id, bytes(r.kept), sum(x.end - x.start for x in r.spans)) for r in out} == brute(rows, 120, keep_first)
            for name, later in (("repeated", False), ("later", True)):
                assert {r.doc_id: [i for x in r[name] for i in range(x.start, x.end)] for r in out} == covered(rows, 50, later)


def test_passages_of_few_words_do_not_count(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p # " + "x" * 40), (2, "a b c d e f g h i j k l m n o p"), (3, "y " + "x" * 40)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100, False, passage=20, passage_words=5).collect()
    assert {r.doc_id: [(x.start, x.end) for x in r.repeated] for r in out} == {1: [(0, 31)], 2: [(0, 31)], 3: []}


def thue_morse(n):
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_thue_morse_words_are_told_apart(spark):
    rows = list(enumerate(thue_morse(1024)))
    assert got(spark, rows, 1000, False) == brute(rows, 1000, False) == {(d, t.encode(), 0) for d, t in rows}


def test_long_runs_null_ids_and_clashing_names(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcd ") for _ in range(9000))
    rows = [(None, "p" + long, 1, "a"), (4, long + "q", 2, "b"), (4, "z" * 9000, 3, "c"), (None, None, 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, found string")
    for keep_first, want in ((True, {"a": 0, "b": 9000, "c": 8999, "d": 0}), (False, {"a": 9000, "b": 9000, "c": 9000, "d": 0})):
        out = remove_repeats(df, 100, keep_first).collect()
        assert {r.row.found: r.n_bytes - len(r.kept) for r in out} == want
        assert sorted((r.row.kept, r.doc_id) for r in out) == [(1, None), (2, 4), (3, 4), (4, None)]


def test_repeated_rows_count_as_one_first(spark):
    rows = corpus(5)
    again = [r for r in rows if r[0] in (2, 3, 7, 11, 20, 33)]
    df = spark.createDataFrame(rows + again, "doc_id long, text string")
    out = [(r.doc_id, bytes(r.kept)) for r in remove_repeats(df, 100).collect()]
    want = {d: k for d, k, _ in brute(rows, 100, True)}
    assert sorted(out) == sorted((d, want[d]) for d, _ in rows + again)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=20, max_size=200).map(lambda b: bytes(x % 3 for x in b)))
def test_longest_factors(raw):
    data, depth = np.frombuffer(raw, np.uint8), 13
    pos = np.arange(len(data))
    before, after = longest_factors(data, pos, len(data) - pos, depth)

    def match(i, j):
        n = 0
        while n < depth and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
            n += 1
        return n

    assert before.tolist() == [max([match(i, j) for j in range(i)], default=0) for i in range(len(raw))]
    assert after.tolist() == [max([match(i, j) for j in range(i + 1, len(raw))], default=0) for i in range(len(raw))]
