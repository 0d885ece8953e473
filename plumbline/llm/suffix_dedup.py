"""Repeated substrings by longest-previous-factor arrays over suffix arrays that Spark deals out.

Every window of bytes belongs to the smallest k-gram hash in it (its minimizer). Runs of windows with one
minimizer travel as one string, so equal windows always meet and a byte travels a few times at most. Where
shorter passages are asked for too, strings follow the shorter windows and reach on to the end of the longer
ones, so that one array has the matches of both lengths. Equal strings are first counted and collapsed by Spark; only different strings under one minimizer
reach a suffix array. There, previous and next smaller positions in suffix order give each window's longest
earlier match, and previous and next larger positions its longest later match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U64, fixed_hashes, words
from .runtime import forget, keep, lean, partitions, schema_with, ship, slices, utf8

GRAM = 32
#: Windows in one travelling string.
RUN = 4096
#: Text of one suffix array; whole minimizer groups are added up to it.
ARRAY_BYTES = 1_000_000
#: A minimizer whose different strings exceed this goes by counted window hashes instead of one suffix array.
GROUP_BYTES = 8_000_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i with a whole window."""
    n = len(x)
    pad = -n % w
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def _strings(length: int, gram: int, reach: int):
    """Strings of windows of `length` bytes, each `reach` bytes longer where the text goes on."""
    w = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, at = utf8(b.column("text"))
            if len(data) < length:
                continue
            kh = fixed_hashes(data, gram)
            low = sliding_min(kh, w)
            size = np.diff(at)
            has = np.maximum(size - length + 1, 0)
            doc = np.repeat(np.arange(len(size)), has)
            if not len(doc):
                continue
            p = np.arange(len(doc)) - np.repeat(np.cumsum(has) - has, has) + at[:-1][doc]
            m = low[p]
            new = np.ones(len(p), bool)
            new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(p)))
            if count.max() > RUN:
                extra = [np.arange(a + RUN, a + c, RUN) for a, c in zip(first[count > RUN].tolist(), count[count > RUN].tolist(), strict=True)]
                first = np.sort(np.concatenate([first, *extra]))
                count = np.diff(np.append(first, len(p)))
            start, mini = p[first], m[first]
            end = start + count + length - 1
            values = np.unique(mini)
            near = np.flatnonzero(kh <= values[-1])
            code = np.minimum(np.searchsorted(values, kh[near]), len(values) - 1)
            hit = values[code] == kh[near]
            keys = np.sort((code[hit].astype(np.int64) << 33) + near[hit])
            own = np.searchsorted(values, mini).astype(np.int64) << 33
            twice = np.searchsorted(keys, own + end - gram + 1) - np.searchsorted(keys, own + start) > 1
            d = doc[first]
            raw, far = memoryview(np.ascontiguousarray(data)), np.minimum(end + reach, at[1:][d])
            ids = [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), far.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mini.view(np.int64)),
                    pa.array(np.array(ids, U64).view(np.int64)),
                    b.column("id").take(pa.array(d)),
                    b.column("text_id").take(pa.array(d)),
                    pa.array((start - at[:-1][d]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array((far - start).astype(np.int32)),
                    pa.array(twice),
                ],
                names=["mini", "string_id", "id", "text_id", "start", "run", "size", "twice"],
            )

    return run


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ranks of all suffixes by their first depth bytes, by prefix doubling, and the ranks at each shorter power of two."""
    n = len(data)
    padded = np.concatenate((data.astype(U64) + U64(1), np.zeros(3, U64)))  # the end sorts before byte 0
    key = np.zeros(n, U64)
    for j in range(4):
        key = (key << U64(9)) | padded[j : n + j]
    levels, h = [], 4
    rank = _ranks(key, 36)
    while h * 2 <= depth:
        levels.append((h, rank))
        rank = _ranks(*_paired(rank, h))
        h *= 2
    levels.append((h, rank))
    if h < depth:
        rank = _ranks(*_paired(rank, depth - h))
    return rank, levels


def _paired(rank: np.ndarray, h: int) -> tuple[np.ndarray, int]:
    """Ranks of suffixes with those h further on, as one number, and its bits."""
    bits = len(rank).bit_length()
    after = np.zeros(len(rank), U64)
    after[: max(0, len(rank) - h)] = rank[h:].astype(U64) + U64(1)
    return (rank.astype(U64) << U64(bits)) | after, 2 * bits


def _ranks(key: np.ndarray, bits: int) -> np.ndarray:
    n = len(key)
    place = n.bit_length()
    if bits + place <= 64:  # key and place sort as one number, several times faster than an argsort
        s = np.sort((key << U64(place)) | np.arange(n, dtype=U64))
        order = (s & U64((1 << place) - 1)).astype(np.int64)
        s >>= U64(place)
    else:
        order = np.argsort(key, kind="stable")
        s = key[order]
    step = np.zeros(n, np.uint32)
    step[1:] = s[1:] != s[:-1]
    out = np.empty(n, np.uint32)
    out[order] = np.cumsum(step, dtype=np.uint32)
    return out


def common_prefix(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the different suffixes at a and b, no longer than depth, which is under twice the last level."""
    out = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):  # equal ranks end inside the data, so places never pass its end
        rank = np.append(rank, np.uint32(0xFFFFFFFF))
        out += h * (rank[a + out] == rank[b + out])
    ends = np.append(data.astype(np.int16), np.int16(-1))
    for _ in range(3):
        out += ends[a + out] == ends[b + out]
    return np.minimum(out, depth)


def nearest_smaller(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix order the nearest earlier place with a smaller position (-1: none) and the
    common prefix with it; lcp[i] is that of places i - 1 and i. Found by pointer jumping."""
    p = np.arange(len(sa)) - 1
    least = lcp.astype(np.int64).copy()
    todo = np.flatnonzero((p >= 0) & (sa[np.maximum(p, 0)] > sa))
    while len(todo):
        q = p[todo]
        step, low = p[q], least[q]
        p[todo] = step
        least[todo] = np.minimum(least[todo], low)
        todo = todo[(step >= 0) & (sa[np.maximum(step, 0)] > sa[todo])]
    least[p < 0] = 0
    return p, least


def longest_factors(data: np.ndarray, positions: np.ndarray, most: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the positions (ascending) the longest match, up to depth and its own most, with an earlier and with a later one."""
    rank, levels = suffix_array(data, depth)
    n, bits = len(positions), len(positions).bit_length()
    key = np.sort((rank[positions].astype(U64) << U64(bits)) | np.arange(n, dtype=U64))
    order = (key & U64((1 << bits) - 1)).astype(np.int64)
    sa = positions[order]
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = common_prefix(data, levels, sa[:-1], sa[1:], depth)
    back = np.zeros(len(sa), np.int64)
    back[1:] = lcp[1:][::-1]
    found = []
    for sign in (1, -1):  # smaller positions: earlier matches; larger ones: later matches
        key = sign * sa
        _, up = nearest_smaller(key, lcp)
        _, down = nearest_smaller(key[::-1], back)
        out = np.empty(len(sa), np.int64)
        out[order] = np.maximum(up, down[::-1])
        found.append(np.minimum(out, most))
    return found[0], found[1]


#: What a span is: to be removed, repeated anywhere at the shorter length, or there standing earlier as well.
REMOVED, REPEATED, LATER = 0, 1, 2

_FOUND = "id long, text_id long, kind int, start int, end int"


def _match(length: int, keep_first: bool, short: int | None):
    """Sorted strings of whole minimizer groups -> spans of bytes that matching windows cover."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(r[4]) for r in rows])
        base = np.cumsum(size + 1) - size - 1
        data = np.zeros(int(base[-1] + size[-1]), np.uint16)  # bytes as 1 to 256, and a 0 between strings: no match runs on behind it unseen
        for at, r in zip(base.tolist(), rows, strict=True):
            data[at : at + len(r[4])] = np.frombuffer(r[4], np.uint8)
            data[at : at + len(r[4])] += 1
        run = np.array([r[5] for r in rows])
        row = np.repeat(np.arange(len(rows)), run)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(run) - run, run)
        pos = base[row] + inner
        before, after = longest_factors(data, pos, size[row] - inner, length)
        wanted = [(REMOVED, length, before if keep_first else np.maximum(before, after))]
        if short is not None:
            wanted += [(REPEATED, short, np.maximum(before, after)), (LATER, short, before)]
        ids, texts, starts = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        out: list[tuple[np.ndarray, ...]] = []
        for kind, least, match in wanted:
            hit = np.flatnonzero(match >= least)
            r, i = row[hit], inner[hit]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (i[1:] > i[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(r)) - 1 if len(r) else first
            at = r[first]
            out.append((ids[at], texts[at], np.full(len(at), kind), starts[at] + i[first], starts[at] + i[last] + least))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(x.astype(np.int32)) for x in columns[2:])], names=["id", "text_id", "kind", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        group: list[tuple] = []
        done_bytes = group_bytes = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("mini", "id", "text_id", "start", "bytes", "run")), strict=True):
                if group and group[-1][0] != row[0]:
                    if done and done_bytes + group_bytes > ARRAY_BYTES:
                        yield solve(done)
                        done, done_bytes = [], 0
                    done += group
                    done_bytes += group_bytes
                    group, group_bytes = [], 0
                group.append(row)
                group_bytes += len(row[4])
        if done and done_bytes + group_bytes > ARRAY_BYTES:
            yield solve(done)
            done = []
        if done or group:
            yield solve(done + group)

    return run


_CUT = "mini long, id long, text_id long, start int, run int, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("mini", pa.int64()), ("id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int32()), ("run", pa.int32()), ("bytes", pa.binary())])
    for b in batches:
        out: list[tuple] = []
        for own, text_id, text, parts in zip(b.column("id").to_pylist(), b.column("text_id").to_pylist(), b.column("text"), b.column("parts").to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            out += [(x["mini"], own, text_id, x["start"], x["run"], bytes(raw[x["start"] : x["start"] + x["size"]])) for x in parts]
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x, strict=True)) for x in out], schema=kind)


def _window_hashes(length: int, short: int):
    """Every window of a string, by its hash: of `length` bytes, and of `short` ones if these are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes"):
            data, at = utf8(b.column("bytes"))
            runs = np.asarray(b.column("run")).astype(np.int64)
            start = np.asarray(b.column("start")).astype(np.int64)
            for size in sorted({length, short}):
                if not len(h := fixed_hashes(data, size)):
                    continue
                here = np.clip(np.diff(at) - size + 1, 0, runs)
                row = np.repeat(np.arange(len(here)), here)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(here) - here, here)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(h[at[:-1][row] + inner].view(np.int64)), pa.array(np.full(len(row), size, np.int32)), b.column("id").take(take), b.column("text_id").take(take), pa.array((start[row] + inner).astype(np.int32))], names=["window", "size", "id", "text_id", "start"])

    return run


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<start:int,end:int>>"


def _remove(whole_chars: bool, passages: bool, least_words: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def whole(raw: memoryview, x: int, y: int) -> tuple[int, int]:
        while whole_chars and x < y and raw[x] & 0xC0 == 0x80:
            x += 1
        while whole_chars and x < y < len(raw) and raw[y] & 0xC0 == 0x80:
            y -= 1
        return x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: dict[str, list] = {k: [] for k in ("spans", "repeated", "later")[: 3 if passages else 1]}
            kept = []
            for text, found in zip(b.column("text"), b.column("found").to_pylist(), strict=True):
                raw, at, parts = memoryview(text.as_buffer()), 0, []
                for code, name in enumerate(lists):
                    runs = (whole(raw, x, y) for x, y in _merged([f for f in found or [] if f["kind"] == code]))
                    if code != REMOVED and least_words:
                        runs = ((x, y) for x, y in runs if len(words(np.frombuffer(raw[x:y], np.uint8), np.array([0, y - x]))[0]) >= least_words)
                    lists[name].append([{"start": x, "end": y} for x, y in runs if x < y])
                for f in lists["spans"][-1]:
                    parts.append(raw[at : f["start"]])
                    at = f["end"]
                parts.append(raw[at:])
                kept.append(b"".join(parts))
            columns = [b.column("doc_id"), b.column("row"), pa.array([t.as_buffer().size for t in b.column("text")], pa.int64()), *(pa.array(x, kind) for x in lists.values()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_bytes", *lists, "kept"])

    return run


#: Stands for a null doc_id, before all others; texts tell such rows apart.
NO_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = True, whole_chars: bool = False, passage: int | None = None, passage_words: int = 0) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, row, n_bytes, spans array<struct<start, end>>, kept binary).

    A window is any `length` bytes of one text as UTF-8. With keep_first, bytes covered by a window that also
    starts earlier (by doc_id, then text, then place) are removed; otherwise bytes covered by a window that
    starts anywhere else. Windows are judged on the input and never cross texts; spans are the maximal removed
    runs of bytes, kept the other bytes; with whole_chars a span gives up bytes of characters that it would split,
    so that kept is UTF-8 again. `row` carries the other columns of docs as a struct, whatever their names.

    With `passage` (bytes, at most length) there are two more columns like spans, after it: repeated, the runs
    covered by windows of so many bytes that start anywhere else, and later, those whose windows start earlier
    too; of both only runs of `passage_words` words or more. They come from the same arrays and change no text.

    A null text is empty; texts under a window's bytes have nothing. Texts of any length are taken whole. Rows that
    repeat both doc_id and text are decided alike: among them keep_first counts one as the first. A null doc_id
    sorts before all others. An empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    short = length if passage is None else passage
    if not 0 < short <= length:
        raise ValueError("a passage has at most `length` bytes, and at least one")
    gram = min(GRAM, max(1, short // 2))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.struct(*others or [F.lit(True).alias("none")]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "text_id": F.xxhash64("text")})
    texts = rows.select("id", "text_id", "text").where(F.octet_length("text") >= short)
    strings = keep(texts.mapInArrow(lean(_strings(short, gram, length - short)), "mini long, string_id long, id long, text_id long, start int, run int, size int, twice boolean"), "strings")
    often = strings.groupBy("mini").agg(F.count("*").alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("mini")
    hits = keep(strings.join(often, "mini", "left_semi"), "hits")
    forget(strings)
    place = F.struct("id", "text_id", "start")
    classes = keep(hits.groupBy("mini", "string_id", "run", "size").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max("twice").alias("twice")), "classes")
    spread = classes.groupBy("mini").agg(F.count("*").alias("k"), F.max("twice").alias("t"), F.sum(F.col("size").cast("long")).alias("bytes")).where("k > 1 or t").select("mini", "bytes")
    lists = classes.join(spread, "mini").select("first.*", "mini", "run", "size").groupBy("id", "text_id").agg(F.collect_list(F.struct("mini", "start", "run", "size")).alias("parts"))
    # One of the rows that repeat both: else the second would match the first, and the span is of both.
    cut = texts.join(lists, ["id", "text_id"]).dropDuplicates(["id", "text_id"]).mapInArrow(lean(_cut), _CUT)
    heavy = spread.where(F.col("bytes") > GROUP_BYTES).select("mini")
    some_heavy = heavy.limit(1).count() > 0
    if some_heavy:
        cut = keep(cut, "cut")
    light = cut.join(heavy, "mini", "left_anti") if some_heavy else cut
    found = light.repartition(n, "mini").sortWithinPartitions("mini", "id", "text_id", "start").mapInArrow(lean(_match(length, keep_first, passage)), _FOUND)
    if some_heavy:
        w = cut.join(heavy, "mini", "left_semi").mapInArrow(lean(_window_hashes(length, short)), "window long, size int, id long, text_id long, start int")
        seen = w.groupBy("window", "size").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
        again = w.join(seen, ["window", "size"]).select("id", "text_id", "start", (F.col("start") + F.col("size")).alias("end"), (F.col("first") != place).alias("other"), "size")
        found = found.unionAll(_kinds(again, F.col("size") == length, F.col("size") == short, keep_first, passage is not None))
    same = classes.where("copies > 1").select("mini", "string_id", "run", "size", "first")
    copies = hits.join(same, ["mini", "string_id", "run", "size"]).select("id", "text_id", "start", (F.col("start") + F.col("size")).alias("end"), (F.col("first") != place).alias("other"), "size")
    found = found.unionAll(_kinds(copies, F.col("size") >= length, F.lit(True), keep_first, passage is not None))
    by_doc = keep(found.groupBy("id", "text_id").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found")), "spans")
    forget(hits, classes, cut)
    columns = f"doc_id long, row row, n_bytes long, spans {_SPANS}, " + (f"repeated {_SPANS}, later {_SPANS}, " if passage is not None else "") + "kept binary"
    return rows.join(by_doc, ["id", "text_id"], "left").select("doc_id", "row", "text", "found").mapInArrow(lean(_remove(whole_chars, passage is not None, passage_words)), schema_with(rows, columns))


def _kinds(found: DataFrame, is_long: Column, is_short: Column, keep_first: bool, passages: bool) -> DataFrame:
    """found(id, text_id, start, end, other, ...) as spans of each kind that they count for."""
    kinds = [(REMOVED, is_long & F.col("other") if keep_first else is_long)]
    if passages:
        kinds += [(REPEATED, is_short), (LATER, is_short & F.col("other"))]
    counted = F.array(*(F.when(ok, F.lit(k)) for k, ok in kinds))
    return found.select("id", "text_id", F.explode(F.array_compact(counted)).alias("kind"), "start", "end")
