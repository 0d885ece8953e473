import collections
import hashlib
import random
import re

from plumbline.llm.exact_dedup import exact_duplicates, identities


def brute(rows):
    groups = collections.defaultdict(list)
    for i, (_, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append(i)
    out = collections.Counter()
    for s, own in groups.items():
        best = min(own, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        for i in own:
            out[(rows[i][0], rows[best][0], len(own), i == best, hashlib.sha256(s.encode()).hexdigest())] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, name string, `a.b` int")


def test_matches_brute_force_with_small_blocks_and_hot_keys(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab é日\n\t ") for _ in range(rng.choice([0, 1, 5, 20, 200, 900]))) for _ in range(50)]
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, *base]) if rng.random() < 0.7 else rng.choice(base) + " ") for _ in range(200)]
    rows += [(900 + i, base[4] + " ") for i in range(60)] + [(7, "same"), (7, "same"), (7, "s ame")]
    for size, hot_rows in ((4096, 1000), (16, 5), (3, 2)):
        assert collections.Counter(map(tuple, exact_duplicates(table(spark, rows), size, hot_rows).collect())) == brute(rows)


def test_long_texts_and_an_empty_table(spark):
    long = "word " * 400_000
    rows = [(1, long), (2, long.replace(" ", "\n")), (3, long[:-2] + "t"), (4, None), (5, " \t"), (6, "")]
    got = {r.doc_id: r for r in exact_duplicates(table(spark, rows)).collect()}
    assert [got[i].keep_id for i in range(1, 7)] == [1, 1, 3, 5, 5, 5]
    assert [got[i].group_size for i in range(1, 7)] == [2, 2, 1, 3, 3, 3]
    assert exact_duplicates(table(spark, [])).count() == 0


def test_names_tell_all_texts_apart(spark):
    rows = [(i, format(i, "09b")) for i in range(512)] + [(1000 + i, format(i, "09b") + "0") for i in range(64)]
    found = identities(table(spark, rows), 2, 4).select("n_blocks", "name").distinct().count()
    assert found == 576
