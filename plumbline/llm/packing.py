"""Pack token sequences into windows with minimum bin slack, planned on the histogram of remaining lengths.

Documents are cut into full windows and a remainder. The remainders' lengths form a multiset of at most `window`
distinct values, whatever the corpus; bitset subset-sum dynamic programming picks from it the lengths that fill a
window closest to capacity, and that pattern is used as often as counts allow. Spark numbers the pieces of each
length, and a piece's number gives its place in the patterns: no window's pieces ever gather on one machine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, span_hashes, words
from .runtime import keep, lean, partitions, ship, slices, utf8

WINDOW = 2048
END = 1
#: Runs that a Python worker remembers before it starts afresh.
MEMORY = 700_000

#: Texts are tokenized in slices of so many bytes.
SLICE = 1_000_000

_encoders: dict[str, WordEncoder] = {}

# What a byte is to the tokenizer's splitter: 0 white space, 1 letter, 2 digit, 3 mark; 4: its word is encoded whole.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[39] = 4  # contractions
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordEncoder:
    """Ids of the runs that the tokenizer's splitter makes, remembered by hash, in one growing pool; run 0 is the end id.

    Runs of ASCII and Latin-1 letters, single digits and runs of marks are told apart here, in lower case. A word
    with any other character, an apostrophe or a special token's beginning goes to the tokenizer as it is.
    """

    def __init__(self, path: str, end: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.pool[0] = self.end
        self.filled = 1
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.size[0] = 1
        self.n = 1

    def _add(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.n + len(hashes) > len(self.at):
            self.at, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size))
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.at[self.n : self.n + len(hashes)] = self.filled + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(hashes)] = sizes
        self.known.update(zip(hashes, range(self.n, self.n + len(hashes)), strict=True))
        self.filled += len(ids)
        self.n += len(hashes)

    def _learn(self, hashes: list[int], texts: list[str], plain: bool) -> None:
        """plain runs are encoded many at a time: only a run's last id is one that closes a word."""
        if plain:
            for i in range(0, len(texts), 2000):
                ids = np.array(self.tokenizer.encode(" ".join(texts[i : i + 2000]), add_special_tokens=False).ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(texts[i : i + 2000]):
                    raise ValueError("the tokenizer splits otherwise than word_bpe_49k.json")
                self._add(hashes[i : i + 2000], ids, np.diff(ends, prepend=0))
        elif texts:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._add(hashes, np.array([x for ids in found for x in ids], np.uint32), np.array([len(x) for x in found], np.int64))

    def _runs(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes, starts and ends of the runs, and which are whole words."""
        ws, we, _ = words(data, starts)
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        letter = (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = 1
        kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = 4
        odd = np.concatenate(([0], np.cumsum(kind == 4)))
        whole = odd[we] > odd[ws]
        step = np.zeros(len(data) + 1, np.int8)
        step[ws[whole]] += 1
        step[we[whole]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        low = _LOWER[data]
        upper = lead[letter & (after <= 0x9E)] + 1
        low[upper] += 32
        low[inside] = data[inside]
        new = (kind == 2) | np.concatenate(([True], kind[1:] != kind[:-1]))
        new &= (kind != 0) & ~inside
        new[ws] = True
        ps = np.flatnonzero(new)
        own = np.searchsorted(ws, ps, side="right") - 1
        return low, ps, np.minimum(np.append(ps[1:], len(data)), we[own]), whole[own]

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by the end id, and where each text's begin (with an end)."""
        if len(data):
            low, ps, pe, whole = self._runs(data, starts)
        else:
            low, ps, pe, whole = data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        first = np.searchsorted(ps, starts)
        h = span_hashes(low, ps, pe)
        h[whole] ^= U64(0x9E3779B97F4A7C15)
        values, where, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.clear()
        known = self.known
        listed = values.tolist()
        new = np.array([i for i, x in enumerate(listed) if x not in known], np.int64)
        if len(new):
            raw, j = low.tobytes(), where[new]
            for plain in (True, False):
                pick = whole[j] != plain
                at = j[pick]
                self._learn([listed[i] for i in new[pick].tolist()], [raw[x:y].decode("utf-8", "replace") for x, y in zip(ps[at].tolist(), pe[at].tolist(), strict=True)], plain)
        index = np.array([known[x] for x in listed], np.int64)[which] if len(ps) else np.zeros(0, np.int64)
        index = np.insert(index, first[1:], 0)
        size = self.size[index]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[index] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bound = np.concatenate(([0], ends))
        return ids, bound[np.concatenate(([0], first[1:] + np.arange(1, len(first))))]


def encoder(path: str, end: int) -> WordEncoder:
    key = f"{path}:{end}"
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, end)
    return _encoders[key]


def _pieces(path: str, end: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end)
        for b in slices(batches, limit=SLICE):
            ids, at = encode(*utf8(b.column("text")))
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            rows: list[tuple[int, int, int, int]] = []
            for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                rows += [(i, a - x, min(window, y - a), zlib.crc32(raw[4 * a : 4 * min(a + window, y)])) for a in range(x, y, window)]
            table = np.array(rows, np.int64).reshape(-1, 4)
            doc = table[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(table[:, 1]), pa.array(table[:, 2]), pa.array(table[:, 3]), pa.array(np.diff(at)[doc])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with their counts, whose sum comes closest to room from below; longer lengths first among equals."""
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for size in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[size], room // size), 1
        while left:
            take = min(part, left)
            steps.append((size, take, sums))
            sums |= (sums << (size * take)) & full
            left -= take
            part *= 2
        if sums >> room & 1:
            break
    best = sums.bit_length() - 1
    out: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> best & 1:
            best -= size * take
            out[size] = out.get(size, 0) + take
    return out


def patterns(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (length -> count, times used), largest remaining length first, until every length is used up."""
    left = {k: v for k, v in histogram.items() if v}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        rest = fill({k: v for k, v in left.items() if v}, window - seed)
        left[seed] += 1
        rest[seed] = rest.get(seed, 0) + 1
        times = min(left[k] // v for k, v in rest.items())
        for k, v in rest.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        out.append((rest, times))
    return out


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and range of piece numbers: first window, pieces of it a window, offset of the first in a window."""
    rows, used, base = [], {}, 0
    for need, times in plan:
        offset = 0
        for size in sorted(need, reverse=True):
            first = used.get(size, 0)
            rows.append((size, first, base, need[size], offset))
            used[size] = first + need[size] * times
            offset += size * need[size]
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "first": table[:, 1], "base": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def _place(slots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, number = (np.asarray(b.column(c)) for c in ("length", "number"))
            i = np.searchsorted(slots["key"], (size << 48) + number, side="right") - 1
            k = number - slots["first"][i]
            extra = [pa.array(slots["base"][i] + k // slots["each"][i]), pa.array(slots["offset"][i] + k % slots["each"][i] * size)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + extra, names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece.

    A document's ids are those of the tokenizer file without special tokens, then `end`; a null or empty text is
    `end` alone. ids_crc32 is over the piece's ids as little-endian unsigned 32-bit numbers. Pieces of one
    sequence_id stand gapless from offset 0 and never exceed `window`. Repeated rows are pieces of their own, null ids
    stay; texts of any length are taken whole, an empty table gives an empty one, other columns are ignored.
    The tokenizer must drop white space and never join words across it, as word_bpe_49k.json does.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = keep(rows.mapInArrow(lean(_pieces(tokenizer_path, end, window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(8 * partitions(spark))))
    counted = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    before = counted.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = pieces.withColumn("inner", inner).join(before, ["length", "bucket"]).withColumn("number", F.col("inner") + F.col("before"))
    return numbered.mapInArrow(lean(_place(_slots(patterns(histogram, window)))), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
