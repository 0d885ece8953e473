"""Benchmark items inside documents, also with other numbers, names or units: template windows.

Windows of three templates meet the benchmark's windows by hash: the tokens as they are (verbatim copies, however
few words they hold), numbers, names and units as typed placeholders, and the same with capital words that open a
sentence as names too. A placeholder stands for a whole number (1,295.50 or twenty-five) or name (Alice Miller), so
that another one of more or fewer tokens fits. Along each alignment of document and item, placeholders that stand for
one value in the item must stand for one value in the document; windows across placeholders that break this do not
count, and if it is a name that changes within one alignment, nothing that was changed there does. Items that are mostly
placeholders are matched as a whole besides. Items that differ in their values alone are one class with one representative, so that a document never meets
every item made from a template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER_BYTES, NO_LETTER, U64, mix, span_hashes, words
from .runtime import keep, lean, ship, slices, utf8

#: Tokens of a window, and how many of them must be words rather than placeholders.
WINDOW, LITERALS = 8, 4
#: Literals of an item that is mostly placeholders and matched as a whole.
DENSE_LITERALS = 2
#: Share of an item's tokens that consistent windows must cover.
COVERAGE = 0.6
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Benchmark windows that tasks may hold in memory (8 bytes each); beyond, all windows are shuffled and joined.
HELD_WINDOWS = 2_000_000

# Names of units, singular and plural.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kmh mph c f k degree degrees percent pct usd eur gbp dollar dollars euro euros cent cents hz khz mhz ghz w kw kwh v volt volts watt watts j joule joules kb mb gb tb byte bytes"
).split()


# English number words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()


def _hashes(words_: list[str]) -> np.ndarray:
    data = [np.frombuffer(w.encode(), np.uint8) for w in words_]
    return np.sort(np.concatenate([span_hashes(d, np.array([0]), np.array([len(d)])) for d in data]))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS)
_LITERAL, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
_SLOT = np.array([0, 0x1111, 0x2222, 0x3333], U64)
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63, 58, 34]] = True  # newline ! . ? : "

#: Templates: tokens as they are, placeholders, placeholders with sentence-opening capital words as names.
RAW, TYPED, OPENED = 0, 1, 2


class Tokens:
    """The tokens of texts end to end, and their three templates.

    A token is a run of letters and digits. It is a number if it begins with a digit or is a number word, a unit if it is in
    UNITS after a number, a name if it begins with a capital and no sentence begins there (or, in OPENED, anywhere).
    Numbers joined by a point, or by a comma before three digits, number words joined by a blank or hyphen, and names
    joined by a blank are one placeholder; a word that opens a sentence is never joined to what follows.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts
        self.ws, self.we, self.first = words(data, starts, NO_LETTER)
        n = len(self.ws)
        self.low = LOWER_BYTES[data]
        self.own = span_hashes(self.low, self.ws, self.we) if n else np.zeros(0, U64)
        if not n:
            return
        head = data[self.ws]
        self.digit = (head >= 48) & (head <= 57)
        self.word = _among(self.own, _NUMBER_HASHES)
        self.opens = np.zeros(n, bool)
        self.opens[self.first[:-1][self.first[:-1] < n]] = True
        numeric = self.digit | self.word
        self.unit = np.zeros(n, bool)
        self.unit[1:] = numeric[:-1] & ~self.opens[1:] & ~numeric[1:] & _among(self.own[1:], _UNIT_HASHES)
        second = data[np.minimum(self.ws + 1, len(data) - 1)]
        self.capital = (((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))) & ~self.unit & ~self.word
        stops = np.concatenate(([0], np.cumsum(_STOP[data])))
        self.begins = self.opens.copy()
        self.begins[1:] |= stops[self.ws[1:]] > stops[self.we[:-1]]
        # the single byte between a token and the one before it, 0 if there are more or none
        self.gap = np.zeros(n, np.uint8)
        one = (self.ws[1:] - self.we[:-1] == 1) & ~self.opens[1:]
        self.gap[1:] = np.where(one, data[np.minimum(self.we[:-1], len(data) - 1)], 0)

    def template(self, kind: int) -> tuple[np.ndarray, ...]:
        """(hash of each token of the template, whether it is a placeholder, hash of its own value, its first raw token with an
        end, first token of each text with an end)."""
        n = len(self.ws)
        if kind == RAW or not n:  # in their own case
            own = span_hashes(self.data, self.ws, self.we) if n else self.own
            return own, np.zeros(n, bool), own, np.arange(n + 1), self.first
        name = self.capital if kind == OPENED else self.capital & ~self.begins
        role = np.where(self.digit | self.word, _NUMBER, np.where(name, _NAME, np.where(self.unit, _UNIT, _LITERAL)))
        size = self.we - self.ws
        glued = np.zeros(n, bool)
        a, b, gap = slice(None, -1), slice(1, None), self.gap[1:]
        glued[1:] = (self.digit[a] & self.digit[b] & ((gap == 46) | (gap == 44) & (size[b] == 3))) | (self.word[a] & self.word[b] & ((gap == 32) | (gap == 45))) | (name[a] & name[b] & ~self.begins[a] & (gap == 32))
        at = np.flatnonzero(~glued)
        ends = np.append(at[1:], n)
        slot = role[at] > _LITERAL
        value = self.own[at].copy()
        value[slot] = span_hashes(self.low, self.ws[at[slot]], self.we[ends[slot] - 1]) & ~U64(1) | (role[at[slot]] == _NAME).astype(U64)  # odd: a name
        out = value.copy()
        out[slot] = _SLOT[role[at[slot]]]
        return out, slot, value, np.append(at, n), np.searchsorted(at, self.first)


def _dense(slot: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which texts have, in TYPED, fewer literals than windows ask for on average, but DENSE_LITERALS of them."""
    used = np.concatenate(([0], np.cumsum(~slot)))
    literals = used[first[1:]] - used[first[:-1]]
    return (literals * WINDOW < LITERALS * np.diff(first)) & (literals >= DENSE_LITERALS)


_WINDOWS = "size int, window long, {key} long, at long, kind int, slots array<long>, low long, high long"


def _window_hashes(t: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` of t, by one polynomial over all of t."""
    n = len(t) - size + 1
    if size <= 2 * WINDOW:
        h = t[:n].copy()
        for j in range(1, size):
            h *= U64(0xC2B2AE3D27D4EB4F)
            h += t[j : n + j]
        return h
    power = np.full(len(t) + 1, U64(0xC2B2AE3D27D4EB4F))
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = U64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(len(t), inverse))))
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(t * back[:-1])))  # of t[i] k^-i
    return (sums[size:] - sums[:-size]) * power[size - 1 : size - 1 + n]


def _windows(sizes: list[tuple[int, int, np.ndarray | None]], key: str, own_size: int | None, dense: frozenset[int] = frozenset()):
    """Windows of all sizes (size, literals, wanted hashes). With own_size, a text has windows of one size for each template:
    own_size, or all its tokens if it has fewer; and one of all its tokens if it is dense and has so many as `dense` says. low
    and high are the places that a window covers in TYPED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            tokens = Tokens(*utf8(b.column("text")))
            typed = tokens.template(TYPED)
            thin = _dense(typed[1], typed[4])
            for kind in (RAW, TYPED, OPENED):
                t, slot, own, raw, first = typed if kind == TYPED else tokens.template(kind)
                per = np.diff(first)
                doc_of = np.repeat(np.arange(b.num_rows), per)
                for size, literals, wanted in sizes:
                    n = len(t) - size + 1
                    if n <= 0:
                        continue
                    h = mix(_window_hashes(t, size) + U64(kind))
                    ok = doc_of[:n] == doc_of[size - 1 :]
                    whole = np.zeros(n, bool)
                    if kind != RAW:
                        used = np.concatenate(([0], np.cumsum(~slot)))
                        used = used[size:] - used[:-size]
                        if size in dense:
                            whole = ok & (used >= DENSE_LITERALS - (kind == OPENED)) & (thin & (per == size) if own_size is not None else np.ones(b.num_rows, bool))[doc_of[:n]]
                        ok &= used >= literals
                    if own_size is not None:
                        ok &= (np.minimum(per, own_size) == size)[doc_of[:n]]
                    ok |= whole
                    if wanted is not None:
                        ok &= _among(h, wanted)
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    values = np.where(slot, own, U64(0)).view(np.int64)
                    grid = values[at[:, None] + np.arange(size)]
                    d = doc_of[at]
                    base = typed[4][d]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), size, np.int32)),
                            pa.array(h[at].view(np.int64)),
                            b.column(key).take(pa.array(d)),
                            pa.array(at - first[:-1][d]),
                            pa.array(np.full(len(at), kind, np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, grid.size + 1, size, dtype=np.int32)), pa.array(grid.ravel())),
                            pa.array(np.searchsorted(typed[3], raw[at]) - base),  # only what it covers whole
                            pa.array(np.searchsorted(typed[3], raw[at + size], side="right") - 1 - base),
                        ],
                        names=["size", "window", key, "at", "kind", "slots", "low", "high"],
                    )

    return run


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens each text has, in every template too, how many each token of TYPED stands for, and a hash of its TYPED
    template with the pattern of equal values in it."""
    for b in slices(batches):
        tokens = Tokens(*utf8(b.column("text")))
        t, slot, own, raw, first = tokens.template(TYPED)
        lengths = [np.diff(tokens.template(k)[4]) for k in (RAW, TYPED, OPENED)]
        shape = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            seen: dict[int, int] = {}
            pattern = np.array([seen.setdefault(v, len(seen) + 1) if s else 0 for v, s in zip(own[a:z].tolist(), slot[a:z].tolist(), strict=True)], U64)
            body = np.concatenate((t[a:z], pattern)).view(np.uint8)
            shape.append(span_hashes(body, np.array([0]), np.array([len(body)]))[0])
        sizes = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * b.num_rows + 1, 3, dtype=np.int32)), pa.array(np.column_stack(lengths).ravel().astype(np.int64)))
        weights = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.diff(raw)))
        dense = pa.array(np.where(_dense(slot, first), np.diff(first), 0))
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(np.diff(tokens.first)), sizes, weights, pa.array(np.array(shape, U64).view(np.int64)), dense], names=["item_id", "n_tokens", "lengths", "weights", "shape", "dense"])


def consistent(windows: list[dict]) -> tuple[list[int], int]:
    """Item places that an alignment covers by windows without a conflicting slot, and how many values it changed.

    Slots conflict if they stand for one value in the item and for several in the document, in TYPED and OPENED
    together, whose places are the same. If a name does that which stands inside a sentence of the item too, the document asks
    about something else: then no window counts that holds a changed value."""
    pairs = {w["at"] + j: (x, y) for w in windows for j, (x, y) in enumerate(zip(w["slots"], w["doc_slots"], strict=True)) if x}
    values: dict[int, set[int]] = {}
    for x, y in pairs.values():
        values.setdefault(x, set()).add(y)
    wrong = {p for p, (x, _) in pairs.items() if len(values[x]) > 1}
    if any(x & 1 and len(values[x]) > 1 for w in windows if w["kind"] == TYPED for x in w["slots"] if x):
        wrong |= {p for p, (x, y) in pairs.items() if x != y}
    places: set[int] = set()
    changed: set[int] = set()
    for w in windows:
        reach = range(w["at"], w["at"] + w["size"])
        if wrong.isdisjoint(reach):
            places.update(range(w["low"], w["high"]))
            changed.update(pairs[p][0] for p in reach if p in pairs and pairs[p][0] != pairs[p][1])
    return sorted(places), len(changed)


def _consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [consistent(w.as_py()) for w in b.column("windows")]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "item_id", "verbatim")] + [pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.int64())], names=["doc_id", "item_id", "verbatim", "places", "changed"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> (doc_id, item_id, n_items, n_tokens, n_covered, coverage, n_changed).

    One row for each document and class of items whose windows cover at least `coverage` of the item's tokens along
    alignments with consistent placeholders. Items are of one class if they
    differ only in the values of their placeholders, equal ones staying equal; item_id is the smallest of the class,
    n_items its size, n_changed how many of that item's values the document replaced (0 if some item of the class
    stands there as it is). Items of fewer than `window` tokens are matched as a whole, with literals in proportion;
    items or texts that are null or have no token match nothing, and a null doc_id is a document of its own. Texts of any
    length are taken whole. Repeated rows of one doc_id or item_id count as one; ties and order do not matter. Empty
    tables give no rows. Columns other than those named are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    told = items.mapInArrow(lean(_shapes), "item_id long, n_tokens long, lengths array<long>, weights array<long>, shape long, dense long").where("n_tokens > 0")
    shapes = keep(told, "items")
    classes = shapes.groupBy("shape").agg(F.min("item_id").alias("rep"), F.count_distinct("item_id").alias("n_items"), F.min_by(F.struct("n_tokens", "weights"), F.struct("item_id", "n_tokens")).alias("w")).select("shape", "rep", "n_items", "w.*")
    sizes = [r[0] for r in shapes.select(F.explode("lengths").alias("n")).where("n > 0").select(F.least("n", F.lit(window)).alias("s")).distinct().orderBy("s").collect()]  # `window` rows at most
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_items long, n_tokens long, n_covered long, coverage double, n_changed long")
    dense = frozenset(r[0] for r in shapes.select("dense").where("dense > 0").distinct().collect())  # lengths, not items
    sizes = sorted({*sizes, *dense})
    need = {s: max(1, literals * s // window) for s in sizes}
    theirs = items.mapInArrow(lean(_windows([(s, need[s], None) for s in sizes], "item_id", window, dense)), _WINDOWS.format(key="item_id"))
    of_class = theirs.join(shapes.select("item_id", "shape").distinct(), "item_id").join(classes.select("shape", "rep"), "shape")
    # of other items than the representative only verbatim windows, each once
    mine = of_class.where((F.col("kind") == RAW) | (F.col("item_id") == F.col("rep")))
    theirs = keep(mine.groupBy("size", "window", "kind", F.col("rep").alias("item_id"), "low", "high").agg(F.min(F.struct("at", "slots")).alias("s")).select("size", "window", "kind", "item_id", "low", "high", "s.at", "s.slots"), "windows")
    held: dict[int, np.ndarray | None] = dict.fromkeys(sizes)
    if theirs.select("size", "window").distinct().count() <= HELD_WINDOWS:
        lists: dict[int, list[int]] = {s: [] for s in sizes}
        for r in theirs.select("size", "window").distinct().collect():
            lists[r["size"]].append(r["window"])
        held = {s: np.unique(np.array(v, np.int64).view(U64)) for s, v in lists.items() if v}
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").where(F.col("text").isNotNull())
    ours = texts.mapInArrow(lean(_windows([(s, need[s], w) for s, w in held.items()], "doc_id", None, dense)), _WINDOWS.format(key="doc_id"))
    met = ours.select("size", "window", "kind", "doc_id", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots")).join(theirs, ["size", "window", "kind"])
    line = ["doc_id", "item_id", "verbatim", "shift"]
    one = ["at", "size", "kind", "low", "high"]
    met = met.withColumns({"shift": F.col("doc_at") - F.col("at"), "verbatim": F.col("kind") == RAW}).groupBy(*line, *one).agg(F.max(F.struct("slots", "doc_slots")).alias("s")).select(*line, *one, "s.*")
    lines = met.groupBy(*line).agg(F.collect_list(F.struct(*one, "slots", "doc_slots")).alias("windows"))
    good = lines.select("doc_id", "item_id", "verbatim", "windows").mapInArrow(lean(_consistent), "doc_id long, item_id long, verbatim boolean, places array<long>, changed long")
    places = lambda kinds: F.array_distinct(F.flatten(F.collect_list(F.when(kinds, F.col("places")))))
    pairs = good.groupBy("doc_id", "item_id").agg(places(F.lit(True)).alias("every"), places(F.col("verbatim")).alias("raw"), F.max("changed").alias("changed"))
    sized = classes.groupBy("rep").agg(F.max(F.struct("n_items", "n_tokens", "weights")).alias("w")).select("rep", "w.*")
    tokens = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, p: n + F.get("weights", p))
    out = pairs.join(sized, pairs["item_id"] == sized["rep"]).withColumns({"n_covered": tokens("every"), "raw": tokens("raw")})
    out = out.withColumn("coverage", F.col("n_covered") / F.col("n_tokens")).where(F.col("coverage") >= coverage)
    changed = F.when(F.col("raw") >= coverage * F.col("n_tokens"), 0).otherwise(F.col("changed")).cast("long")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "item_id", "n_items", "n_tokens", "n_covered", "coverage", changed.alias("n_changed"))
