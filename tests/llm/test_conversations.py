import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversations as C

BLANK = re.compile(r"[\x20\x09-\x0D]+\Z")
PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def judged(own):
    """(rows in order, their faults) of one conversation."""
    own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in own:
        shown = BLANK.sub("", text)
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return own, faults


def cheapest(initials, faults):
    """The least (cost, audit, roles) by a plain search over states, one row after the other."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def insert(front):
        for _ in range(4):
            for state, (cost, audit, roles) in list(front.items()):
                for role in "ua":
                    if (to := step.get((state, role))) is not None:
                        front[to] = min(front.get(to, (1 << 60,)), (cost + 3, audit + "I", roles + role))
        return front

    front = insert({"": (0, "", "")})
    for initial, fault in zip(initials, faults):
        new = {}
        for state, (cost, audit, roles) in front.items():
            ways = [(state, 4, "D", "")]
            if fault not in ("b", "d"):
                extra = 3 * (fault == "t")
                ways += [(step[state, r], extra, "K", r) for r in "sua" if r == initial and (state, r) in step]
                ways += [(step[state, r], 3 + extra, "R", r) for r in "ua" if (state, r) in step]
            for to, more, edit, role in ways:
                new[to] = min(new.get(to, (1 << 60,)), (cost + more, audit + edit, roles + role))
        front = insert(new)
    return min(front[s] for s in ("", "a") if s in front)


def brute(rows):
    after = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own, faults = judged([r for r in after if r[0] == conv])
        initials = [r[2][:1] for r in own]
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, roles = cheapest(initials, faults) if own else (0, "", "")
        kept, i, lines = iter(own), 0, []
        for edit in audit:
            if edit == "I":
                role, text = {"u": "user", "a": "assistant"}[roles[i]], ""
            else:
                _, _, role, text = next(kept)
                if edit == "D":
                    continue
                role = role if edit == "K" else {"u": "user", "a": "assistant"}[roles[i]]
            lines.append(f"{role}:{text}")
            i += 1
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in C.digest(df).collect()}


def parsed(initials, faults):
    spans = C.Spans()
    for x, f in zip(initials, faults, strict=True):
        spans.add(list(C._row(x, f == "t", f in "bd" and f != "", 1)))
    return C.best(spans.whole())


@pytest.mark.parametrize("seed", range(40))
def test_parse_is_the_least_of_all_edits(seed):
    """Every edit of up to three rows with up to two insertions in each gap, read by the pattern itself."""
    rng = random.Random(seed)
    n = rng.randint(0, 3)
    initials, faults = [rng.choice("suax") for _ in range(n)], [rng.choice(["", "", "t", "b", "d"]) for _ in range(n)]
    ways = []
    for x, f in zip(initials, faults, strict=True):
        extra = 3 * (f == "t")
        ways.append([(4, "D", ""), *([] if f in ("b", "d") else [(extra, "K", x), (3 + extra, "R", "u"), (3 + extra, "R", "a")])])
    gaps = [(3 * len(s), "I" * len(s), s) for s in ("", "u", "a", "ua", "au")]
    least = min((sum(p[0] for p in e), "".join(p[1] for p in e)) for e in itertools.product(gaps, *itertools.chain.from_iterable((w, gaps) for w in ways)) if PATTERN.fullmatch("".join(p[2] for p in e)))
    assert parsed(initials, faults) == least


def test_parse_equals_the_plain_search():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 40)
        initials, faults = [rng.choice("ssuuuaaax") for _ in range(n)], [rng.choice(["", "", "", "t", "b", "d"]) for _ in range(n)]
        assert parsed(initials, faults) == cheapest(initials, faults)[:2]


def sample(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    texts = ["Hi.", "Yes!", "no end", "", " \t\n", None, "Why?  ", "é日.", "…", "a. b\x1f", "Hi.  "]
    return [(rng.choice([None, *range(n // 8)]), rng.choice([None, *range(12)]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)) for _ in range(n)]


def test_queries_equal_brute_force(spark):
    rng = random.Random(5)
    rows = sample(rng, 600)
    rows += [(1000, i, ["user", "assistant"][i % 2], rng.choice(["Hi.", f"text {i}.", "open"])) for i in range(700)]  # over all partitions
    rows += [(1001, i // 40, "user", "same!") for i in range(400)] + [(1002, None, "user", f"{i}.") for i in range(50)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, `a.b` string")
    want = brute(rows)
    have = got(df)
    assert {k: (have.get(k), v) for k, v in want.items() if have.get(k) != v} == {}
    assert have.keys() == want.keys()


def test_very_long_text_and_empty_table(spark):
    rows = [(1, 1, "user", "word. " * 300_000), (1, 2, "assistant", "word. " * 300_000), (1, 3, "user", "word. " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(df) == brute(rows)
    assert C.digest(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(9, 1, "assistant", "A.", 1), (9, 2, "user", "U?", 2), (9, 3, "tool", "open", 1)]
    report, repaired = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int"))
    r = report.first()
    assert (r.duplicate, r.truncated, r.illegal, r.cost) == (1, 1, 2, 13)
    out = sorted(map(tuple, repaired.select("seq", "edit", "role", "text").collect()))
    assert "".join(x[2][0] for x in out) in ("ua", "uaua") and "".join(x[1] for x in out) == r.audit.replace("D", "")
