"""Repair of the turn structure of conversations, by weighted interval parsing.

The repaired roles must read `(s?(ua)+)?`. The repair grammar is in Chomsky normal form: a nonterminal (p, q) derives
what takes a reader of that pattern from state p to state q, its rules are (p, q) -> (p, r) (r, q), its terminals are
the edits of one row, and insertions close every span, the empty one included. A cell of a span holds the least
(cost, audit) of each nonterminal. Because nonterminals name the state at both ends, the derivations of a span are all found at
any one split of it, so the chart needs only the spans of a binary tree: one row, two, four and so on.

That also makes it a Spark job: rows are dealt by ranges of (conversation, turn), every partition parses its run of a
conversation, the runs' cells are combined, and the cut audit goes back to the runs, where rows are edited. A
conversation of any length is spread over partitions; only its audit, a character a row, meets in one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .exact_dedup import BLANKS
from .runtime import BROADCAST_IDS, keep, lean, partitions

# The states of `(s?(ua)+)?` (nothing yet, after s, after u, after a) and where a role's initial leads.
STATES = 4
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
# What edits cost; K keeps, R gives another role, D deletes, I inserts.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
END_MARKS = ".!?"

Cell = list[tuple[int, str] | None]


def _join(a: Cell, b: Cell) -> Cell:
    """The cells of a span out of those of its two parts: (p, q) -> (p, r) (r, q)."""
    out: Cell = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            left = a[p * STATES + r]
            if left is None:
                continue
            for q in range(STATES):
                right = b[r * STATES + q]
                if right is not None:
                    at, both = p * STATES + q, (left[0] + right[0], left[1] + right[1])
                    if out[at] is None or both < out[at]:
                        out[at] = both
    return out


def _least(a: Cell, b: Cell) -> Cell:
    return [y if x is None else x if y is None else min(x, y) for x, y in zip(a, b, strict=True)]


@functools.cache
def _inserted() -> tuple:
    """The empty span: any number of insertions, as the closure of one."""
    one: Cell = [None] * (STATES * STATES)
    for p in range(STATES):
        one[p * STATES + p] = (0, "")
    for (p, role), q in MOVES.items():
        if role in "ua":
            one[p * STATES + q] = (INSERT, "I")
    for _ in range(STATES):
        one = _least(one, _join(one, one))
    return tuple(one)


@functools.cache
def _row(initial: str, truncated: bool, goes: bool, times: int) -> tuple:
    """The cells of `times` equal rows: deleted, and unless they must go, kept or given a role that fits."""
    if times > 1:
        half = _row(initial, truncated, goes, times // 2)
        both = _join(list(half), list(half))
        return tuple(_join(both, list(_row(initial, truncated, goes, 1))) if times % 2 else both)
    cell: Cell = [None] * (STATES * STATES)
    for p in range(STATES):
        cell[p * STATES + p] = (DELETE, "D")
    if not goes:
        extra = TRUNCATED * truncated
        for (p, role), q in MOVES.items():
            for ways in [(extra, "K")] * (role == initial) + [(REROLE + extra, "R")] * (role in "ua"):
                cell = _least(cell, [ways if i == p * STATES + q else None for i in range(STATES * STATES)])
    around = list(_inserted())
    return tuple(_join(_join(around, cell), around))


class Spans:
    """Cells of the rows so far, as spans of falling sizes: equal sizes are joined at once, so joining is bottom-up by length."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, size: int = 1) -> None:
        while self.parts and self.parts[-1][0] <= size:
            n, left = self.parts.pop()
            cell, size = _join(left, cell), n + size
        self.parts.append((size, cell))

    def whole(self) -> Cell:
        cell = None
        for _, left in reversed(self.parts):
            cell = left if cell is None else _join(left, cell)
        return list(_inserted()) if cell is None else cell


def best(cell: Cell) -> tuple[int, str]:
    return min(x for x in (cell[q] for q in FINAL) if x is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with the faults that crc32(`conv_id:turn`) % 20 gives: 0 drops the row, 1
    empties its text, 2 takes its end marks away, 3 repeats it (`copies` is 2), 4 makes its role user. Nulls of role, text and
    within the hashed text are one space; turn and conv_id keep theirs."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    fault = F.crc32(F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string")))) % 20
    text = functools.reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit("")), END_MARKS, space(F.col("text")))
    rows = conversations.withColumn("_fault", fault).where("_fault <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(space(F.col("role"))).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, text).otherwise(space(F.col("text"))).alias("text"),
        F.when(F.col("_fault") == 3, 2).otherwise(1).alias("copies"),
    )


def _key(conv_id: Column) -> Column:
    """A conversation's key, never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, fault): different rows with how often they stand and the first one's fault."""
    same = rows.groupBy(_key(F.col("conv_id")).alias("conv"), "turn", "role", "text").agg(F.sum("copies").alias("n"))
    shown = F.rtrim("text", F.lit(BLANKS))
    same = same.withColumn("_code", F.sha2("text", 256)).withColumn("_shown", shown)
    where = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = keep(same.groupBy("conv", "role", "_code").agg(F.count("*").alias("c"), F.min(where).alias("first")).where("c > 1").select("conv", "role", "_code", "first"), "said")
    found = same.join(F.broadcast(said) if said.count() <= BROADCAST_IDS else said, ["conv", "role", "_code"], "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.length("_shown") == 0, "b").when(again, "d").when(~F.right("_shown", F.lit(1)).isin(*END_MARKS), "t").otherwise("")
    return found.select("conv", "turn", "role", "text", "n", fault.alias("fault"))


_RUN = "part long, conv string, first long, n_rows long, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, head string, tail string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slim rows in order -> a row a run of one conversation in a partition."""
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[f.split()[1]]) for f in _RUN.split(", ")])
    out: list[dict] = []
    run: dict | None = None
    spans = Spans()
    last: object = None

    def done() -> None:
        if run is not None:
            cell = spans.whole()
            out.append(run | {"costs": [None if x is None else x[0] for x in cell], "audits": [None if x is None else x[1] for x in cell]})

    for b in batches:
        for part, place, conv, turn, initial, n, fault in zip(*(b.column(c).to_pylist() for c in ("part", "place", "conv", "turn", "initial", "n", "fault")), strict=True):
            if run is None or (part, conv) != (run["part"], run["conv"]):
                done()
                run = {"part": part, "conv": conv, "first": place, "n_rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "low": None, "high": None, "turns": 0, "head": initial, "tail": initial}
                spans, last = Spans(), None
            elif run["tail"] + initial not in ("su", "ua", "au"):
                run["illegal"] += 1
            run["illegal"] += n - 1
            run["n_rows"] += n
            run["tail"] = initial
            run["blank"] += n if fault == "b" else 0
            run["duplicate"] += (fault == "d") + (n - 1) * (fault != "b")
            run["truncated"] += fault == "t"
            if turn is not None:
                run["turns"] += turn != last
                run["low"], run["high"], last = turn if run["low"] is None else run["low"], turn, turn
            goes = fault in ("b", "d")
            spans.add(list(_row(initial, fault == "t", goes, n if goes else 1)), n if goes else 1)
            if n > 1 and not goes:
                spans.add(list(_row(initial, False, True, n - 1)), n - 1)
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_EDITS = "part long, conv string, first long, seq long, audit string, run long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, whole string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order -> the same runs with their part of the conversation's audit; what is about it all stands on the first."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _EDITS.split(", ")])
    own: list[dict] = []

    def done() -> list[dict]:
        spans, total = Spans(), {k: sum(r[k] for r in own) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        for x, y in zip(own, own[1:], strict=False):
            total["illegal"] += x["tail"] + y["head"] not in ("su", "ua", "au")
            total["turns"] -= x["high"] is not None and x["high"] == y["low"]
        for r in own:
            spans.add([None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)], r["n_rows"])
        cost, audit = best(spans.whole())
        known = [r for r in own if r["low"] is not None]
        total["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - total["turns"] if known else 0
        out, at, seq = [], 0, 0
        for i, r in enumerate(own):
            end, left = at, r["n_rows"]
            while end < len(audit) and (left or i == len(own) - 1):
                left -= audit[end] != "I"
                end += 1
            about = {k: total[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")} | {"cost": cost, "whole": audit} if i == 0 else {}
            out.append({"part": r["part"], "conv": r["conv"], "first": r["first"], "seq": seq, "audit": audit[at:end], "run": i} | about)
            seq += end - at - audit.count("D", at, end)
            at = end
        return out

    ready: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if own and own[0]["conv"] != r["conv"]:
                ready += done()
                own = []
            own.append(r)
        if len(ready) > 2000:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)
            ready = []
    if own:
        ready += done()
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


_REPAIRED = "conv string, seq long, edit string, turn long, role string, text string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each run led by its part of the audit -> the repaired rows."""
    schema = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    # `odd` tells whether the repaired roles begin with s, which the parity of their number does: s?(ua)+
    conv, seq, audit, at, odd = "", 0, "", 0, 0
    for b in batches:
        out: list[tuple] = []

        def put(edit: str, turn: int | None, role: str | None, text: str, out: list[tuple] = out) -> None:
            nonlocal seq
            out.append((conv, seq, edit, turn, ROLES["ua"[(seq + odd) % 2]] if role is None else role, text))
            seq += 1

        for r in b.to_pylist():
            if r["audit"] is not None:
                conv, seq, audit, at, odd = r["conv"], r["seq"], r["audit"], 0, r["odd"]
                left = len(audit) - audit.count("I")
                continue
            for _ in range(r["n"]):
                while audit[at] == "I":
                    put("I", None, None, "")
                    at += 1
                edit, at, left = audit[at], at + 1, left - 1
                if edit != "D":
                    put(edit, r["turn"], r["role"] if edit == "K" else None, r["text"])
                while not left and at < len(audit):
                    put("I", None, None, "")
                    at += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(conv_id, turn, role, text, copies) -> (report, repaired).

    report(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): a row a conversation that has rows.
    repaired(conv, seq, edit, turn, role, text): the rows that stay or are new, numbered from 0. conv is _key(conv_id).

    Rows stand by turn (null first), then role, then text; rows that agree in all three are neighbours. Role and text must not
    be null. Blank rows and rows whose role and text stand before must go. A role counts by its first character; a kept row
    keeps its role whole. Whatever the number of rows, copies or conversations of a key, no task holds more than a
    partition's rows and the audits (a character a row, 16 candidates) of the conversations it ends.
    """
    spark = rows.sparkSession
    ship(spark)
    n = partitions(spark)
    order = ("conv", "turn", "role", "text")
    ranged = _judged(rows).repartitionByRange(n, "conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(*order)
    placed = keep(ranged.select("*", F.monotonically_increasing_id().alias("place")), "turns").withColumn("part", F.shiftright("place", 33))
    slim = placed.select("part", "place", "conv", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "fault")
    runs = slim.repartition(n, "part").sortWithinPartitions("part", "place").mapInArrow(lean(_runs), _RUN)
    edits = keep(runs.repartition(n, "conv").sortWithinPartitions("conv", "part").mapInArrow(lean(_edits), _EDITS), "edits")
    heads = edits.where("run = 0")
    report = heads.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("whole").alias("audit"))
    length = F.length(F.translate("whole", "D", ""))
    odd = edits.join(heads.select("conv", (length % 2).cast("long").alias("odd")), "conv")
    lead = odd.select("part", F.col("first").alias("place"), F.lit(0).alias("kind"), "conv", "seq", "audit", "odd", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"))))
    body = placed.select("part", "place", F.lit(1).alias("kind"), "conv", *(F.lit(None).cast(t).alias(c) for c, t in (("seq", "long"), ("audit", "string"), ("odd", "long"))), "turn", "role", "text", "n")
    repaired = lead.unionByName(body).repartition(n, "part").sortWithinPartitions("part", "place", "kind").mapInArrow(lean(_repaired), _REPAIRED)
    return report, repaired


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, h, out = None, hashlib.sha256(), []
    for b in batches:
        for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
            if c != conv:
                if conv is not None:
                    out.append((conv, h.hexdigest()))
                conv, h = c, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
    if conv is not None:
        out.append((conv, h.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["conv", "repaired_sha256"])


def digest(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), a row for each conv_id, null included, after damaged().

    A conversation without rows after damage has zeros, an empty audit and the hash of nothing. A sha256 is a chain, so a
    conversation's repaired rows pass through one task, one after the other and never held together. An empty table
    gives no rows; other columns are ignored.
    """
    report, repaired = repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    n = partitions(conversations.sparkSession)
    hashes = repaired.select("conv", "seq", "role", "text").repartition(n, "conv").sortWithinPartitions("conv", "seq").mapInArrow(lean(_hashes), "conv string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(report, "conv", "left").join(hashes, "conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
