import random

from plumbline.llm import decontaminate
from plumbline.llm.decontaminate import contaminated

ITEM = "Then Alice Miller bought 12 kg of rice and 3 liters of milk for Bob, so Alice Miller paid 40 dollars in total"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(d, b).collect()}


def test_plain_and_reparameterised(spark):
    rnd = random.Random(2)
    other = ITEM.replace("Alice Miller", "Carol Stone").replace("12 kg", "7 lbs").replace("40", "95")
    loose = ITEM.replace("Alice Miller paid", "Dora Stone paid").replace("Then Alice", "Then Carol")
    docs = [(1, words(rnd, 50)), (2, f"{words(rnd, 9)}. {ITEM}. {words(rnd, 9)}"), (3, f"{words(rnd, 30)}. {other}."), (4, loose), (5, " ".join(ITEM.split()[:9])), (6, None), (7, ""), (8, ITEM), (8, ITEM), (9, ITEM.upper())]
    got = run(spark, [(d, t, "x") for d, t in docs], [(1, ITEM), (2, None), (3, ""), (4, words(rnd, 30))])
    assert {k[0] for k in got} == {2, 3, 8}
    assert got[2, 1].n_changed == 0 and got[2, 1].coverage == 1
    assert got[3, 1].n_changed >= 4


def test_values_of_other_lengths(spark):
    rnd = random.Random(3)
    changes = [("Alice Miller", "Carol"), ("12 kg", "7.5 kg"), ("12 kg", "1,295.50 lbs"), ("3 liters", "seven liters"), ("40 dollars", "twenty-five euros"), ("Bob", "Jean Luc Godard")]
    docs = []
    for d in range(1 << len(changes)):
        t = ITEM
        for k, (a, b) in enumerate(changes):
            if d >> k & 1:
                t = t.replace(a, b)
        docs.append((d, f"{words(rnd, 9)}. {t}. {words(rnd, 9)}", None))
    got = run(spark, docs, [(1, ITEM)])
    assert {k[0] for k in got} == {d for d, *_ in docs}


def test_items_of_one_template_are_a_class(spark, monkeypatch):
    rnd = random.Random(4)
    make = lambda a, b, n: f"Then {a} bought {n} kg of rice and 3 liters of milk for {b}, so {a} paid 40 dollars in total"
    items = [(i, make(f"Xa{i}", f"Yb{i}", i + 100)) for i in range(30)] + [(99, make("Same", "Same", 5))]
    docs = [(d, f"{words(rnd, 5)}. {make(f'Zc{d}', f'Wd{d}', 200 + d)}. {words(rnd, 5)}", None) for d in range(20)] + [(50, items[7][1], None)]
    for held in (2_000_000, 3):
        monkeypatch.setattr(decontaminate, "HELD_WINDOWS", held)
        got = run(spark, docs, items)
        assert {k: r.n_items for k, r in got.items() if k[1] == 0} == {(d, 0): 30 for d, *_ in docs}
        assert got[50, 0].n_changed == 0 and got[3, 0].n_changed >= 3


def test_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, ITEM), (None, "x"), (1, ITEM), (1, "y")], "doc_id long, text string")
    assert {r.doc_id for r in contaminated(rows, spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")).collect()} == {None, 1}


def test_short_items_and_empty_tables(spark):
    assert set(run(spark, [(1, "so much for all of this", None)], [(9, "much for all of")])) == {(1, 9)}
    assert not run(spark, [], [(1, ITEM)])
    assert not run(spark, [(1, ITEM, None)], [])


def test_matches_plain_search(spark):
    rnd = random.Random(5)
    items = [(i, words(rnd, rnd.randrange(10, 40))) for i in range(20)]
    docs = []
    for d in range(200):
        t = words(rnd, rnd.randrange(1, 80))
        if d % 3 == 0:
            t += ". " + items[rnd.randrange(20)][1]
        docs.append((d, t, None))
    want = {(d, i) for d, t, _ in docs for i, x in items if x in t}
    assert set(run(spark, docs, items)) == want


def test_dense_opened_and_conflicting_items(spark):
    rnd = random.Random(7)
    dense = "Compute 12 + 45 - 7 * 3 + 88 - 16 exactly"
    apples = "Tom has 5 red apples. Jerry has 3 green apples. Who has more apples?"
    pears = "On the way home from the old market she put 2 apples and 2 pears into a basket made of straw and ran"
    docs = [
        (1, f"{words(rnd, 9)}. {dense}. {words(rnd, 9)}"),
        (2, f"{words(rnd, 9)}. {apples.replace('Tom', 'Ann').replace('Jerry', 'Bill')} {words(rnd, 9)}"),
        (3, pears.replace("2 apples and 2", "3 apples and 4")),
        (4, pears.replace("2 pears", "5 pears")),
        (5, words(rnd, 40)),
    ]
    got = run(spark, [(d, t, None) for d, t in docs], [(1, dense), (2, apples), (3, pears)])
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 3)}
    assert got[1, 1].coverage == 1 and got[1, 1].n_changed == 0


def test_names_keep_their_part_in_an_alignment(spark):
    rnd = random.Random(8)
    item = "Tom has 5 red apples in 8 baskets. How many of them are left on the 4 tables after Tom eats 2 apples?"
    swap = lambda a, b: item.replace("Tom has 5", f"{a} has 7").replace("after Tom eats 2", f"after {b} eats 3").replace("8 b", "9 b").replace("4 t", "6 t")
    docs = [(1, f"{words(rnd, 9)}. {swap('Anna', 'Carl')} {words(rnd, 9)}"), (2, f"{words(rnd, 9)}. {swap('Anna', 'Anna')} {words(rnd, 9)}"), (3, swap("Tom", "Tom")), (4, f"{swap('Anna', 'Carl')} {words(rnd, 5)}. {swap('Eve', 'Eve')}")]
    got = run(spark, [(d, t, None) for d, t in docs], [(1, item)])
    assert set(got) == {(2, 1), (3, 1), (4, 1)} and got[2, 1].n_changed == 5


def test_items_of_numbers_are_matched_as_a_whole(spark):
    rnd = random.Random(9)
    short, long = "Compute 12 + 45 - 7 * 3 + 88 - 16 exactly.", "Add up " + ", ".join(map(str, rnd.sample(range(100, 1000), 40))) + " now."
    other = lambda t: "".join(str(rnd.randrange(10)) if c.isdigit() else c for c in t)
    docs = [(1, f"{words(rnd, 9)}. {other(short)} {words(rnd, 9)}"), (2, f"{words(rnd, 9)}. {other(long)}"), (3, other(long).replace(" now", " 7 now")), (4, "Numbers " + other(short)[8:]), (5, " ".join(str(i) for i in range(90))), (6, short)]
    got = run(spark, [(d, t, None) for d, t in docs], [(1, short), (2, long)])
    assert set(got) - {(4, 1)} == {(1, 1), (2, 2), (6, 1)}  # "Numbers", too, opens its sentence
    assert got[1, 1].coverage == 1 and got[1, 1].n_changed >= 5 and got[6, 1].n_changed == 0


def test_recall_on_generated_copies(spark):
    """200 copies with all values changed consistently, 200 documents of the same words without the items."""
    rnd = random.Random(10)
    nouns, verbs, people = ["apples", "books", "stones", "tickets", "lamps"], ["buys", "sells", "loses", "finds", "paints"], ["Tom", "Anna", "Carl", "Eve", "Jim Stone", "Rosa Diaz", "Ivan", "Mary Ann"]

    def sentence(a, b, x, y, z, n, v, w):
        return f"In the morning {a} {v[0]} {x} {n[0]} for {y} dollars each. Later {b} {v[1]} {z} {n[1]} and gives half of them to {a} before {w}. How many {n[0]} does {a} have in the end?"

    items, docs = [], []
    for i in range(200):
        n, v, w = rnd.sample(nouns, 2), rnd.sample(verbs, 2), words(rnd, 3)
        value = lambda: rnd.choice([str(rnd.randrange(2, 99)), f"{rnd.randrange(2, 99)}.5", "twenty-five", "seven", f"1,{rnd.randrange(100, 999)}"])
        items.append((i, sentence(*rnd.sample(people, 2), *rnd.sample(range(2, 40), 3), n, v, w)))
        docs.append((i, f"{words(rnd, 30)}. {sentence(*rnd.sample(people, 2), value(), value(), value(), n, v, w)} {words(rnd, 30)}.", None))
    docs += [(1000 + i, " ".join(rnd.sample(items[i][1].split(), len(items[i][1].split()))), None) for i in range(200)]
    got = run(spark, docs, items)
    assert sum((i, i) in got for i in range(200)) >= 190
    assert not [k for k in got if k[0] >= 1000]
