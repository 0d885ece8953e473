"""Exact Jaccard self-join of word-shingle sets by partitioning the universe of shingles (pigeonhole).

A pair that reaches the threshold differs in at most H shingles. Its size band fixes H, hence a number of
segments; hashing puts each shingle into one segment. H differences cannot touch every segment, so a linked
pair agrees on some segment in full ("exact" segments) or up to one deletion ("neighbour" segments, which
count twice). Segments are hashed, equal hashes meet in a shuffle, candidates are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, mix, shingle_sets, word_hashes
from .runtime import BROADCAST_IDS, forget, keep, lean, partitions, row_key, ship, slices, utf8

#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1
#: A signature's members up to so many are paired with each other; larger groups go through a pivot first.
SMALL_GROUP = 8
#: In large groups, how many candidates a set gets in each other component, round by round; the last round has no limit.
ROUNDS = (4, None)
#: Members of a block when a larger group is compared by parities.
BLOCK = 2000


def band_edges(num: int, den: int, top: int) -> list[tuple[int, int]]:
    """Size bands [low, high]: a partner of at least num/den similarity lies in the same or a neighbouring band."""
    out, low = [], 1
    while low <= top:
        high = max(low, low * den // num)
        out.append((low, high))
        low = high + 1
    return out


#: Cost of checking a candidate pair, in signatures; share of a random set's shingles that another one has.
PAIR_COST, COMMON = 20.0, 0.002


def _at_most(size: float, i: int) -> float:
    """Chance that a segment of `size` shingles on average has i or fewer."""
    return sum(math.exp(-size) * size**k / math.factorial(k) for k in range(i + 1))


def allocation(low: int, high: int, sets: int, num: int, den: int) -> tuple[int, int, int]:
    """(exact segments, neighbour segments, spare) for one band, by estimated cost.

    A linked pair has H differences at most. A set leaves out its `spare` smallest exact segments (the first ones
    among equals): of the segments that a pair agrees on, the two together leave out what the one of them with the
    larger bound does, `spare` at most. So exact - spare + 2 * neighbours > H lets a pair meet. Cost: signatures written, plus
    pairs that unlike sets share, mostly by segments of no or few shingles; more spare means fewer of these.
    """
    h = (den - num) * (high + high * den // num) // (den + num)
    best = None
    for neighbours in sorted({0, *(h * i // 16 for i in range(1, 9)), h // 2 + 1}):
        need = max(0, h + 1 - 2 * neighbours)
        for spare in sorted({0, *(need * i // 8 for i in range(1, 13)), *range(1, 4)}) if h and need else (0,):
            exact = need + spare
            size = (low + high) / 2 / (exact + neighbours)
            left, chance, before = spare - 2 * math.sqrt(spare), 0.0, 0.0
            for i in range(12):
                sent = max(before, exact * _at_most(low / (exact + neighbours), i) - max(0.0, left))
                chance += (sent - before) * math.exp(-size) * COMMON**i
                before = sent
            near = neighbours * math.exp(-size) * ((1 + size) ** 2 * math.exp(-size) + size * COMMON)
            cost = sets * (need + neighbours * (1 + size)) + PAIR_COST * sets * sets / 2 * (chance + near)
            if best is None or cost < best[0]:
                best = (cost, (exact, neighbours, spare))
    return best[1]


_PAIR = np.dtype([("sig", "<u8"), ("node", "<i8")])
#: What travels: the bucket and 32 more bits tell signatures apart; a chance meeting is only a candidate that fails.
_SENT = np.dtype([("sig", "<u4"), ("node", "<i8")])


class _Plan:
    """What one band's allocation needs for every set: where segments begin, and their tags."""

    def __init__(self, band: int, allocation: tuple[int, int, int]):
        self.exact, self.neighbours, self.spare = allocation
        m = self.exact + self.neighbours
        self.bounds = np.array([min(-(-(j << 32) // m) << 32, (1 << 64) - 1) for j in range(m + 1)], U64)
        self.tag = (np.arange(m, dtype=U64) << U64(40)) + U64(band + 1)

    def cut(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, self.bounds)
        at[-1] = len(s)
        return at


def _raw_signatures(plan: _Plan, cut: np.ndarray, spread: np.ndarray, total: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(content, size) of the segments of one set, and of its neighbour segments less one shingle."""
    size = cut[1:] - cut[:-1]
    t = total[cut]
    whole = (t[1:] - t[:-1]) ^ plan.tag
    if plan.spare:
        least = np.argsort(size[: plan.exact], kind="stable")[: plan.spare]
        wanted = np.ones(len(size), bool)
        wanted[least] = False
        out = [(whole[wanted], size[wanted])]
    else:
        out = [(whole, size)]
    if plan.neighbours:
        own = np.arange(cut[plan.exact], cut[-1])
        at = np.repeat(np.arange(plan.exact, len(size)), size[plan.exact :])
        out.append((((t[1:] - t[:-1])[at] - spread[own]) ^ plan.tag[at], size[at] - 1))
    return out


def _set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets end to end, where each begins (with an end), and a hash of each as a whole (0: empty)."""
    size = np.array([len(x) for x in sets], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    total = np.zeros(len(flat) + 1, U64)
    np.cumsum(mix(flat), out=total[1:])
    ids = mix(total[at[1:]] - total[at[:-1]] + size.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
    return flat, at, np.where(size > 0, ids, 0)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, starts = utf8(b.column("text"))
            _, at, ids = _set_ids(shingle_sets(*word_hashes(data, starts), k))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(np.diff(at)), pa.array(ids)], names=["doc_id", "key", "n_shingles", "set_id"])

    return run


def _emit(k: int, bands: list[tuple[int, int]], allocations: list[tuple[int, int, int]], buckets: int):
    lows = np.array([x for x, _ in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = [_Plan(i, x) for i, x in enumerate(allocations)]
        held: list[np.ndarray] = []
        seen: set[int] = set()  # sets that this task has sent; sending one again would only cost time

        def flush() -> pa.RecordBatch:
            pair = np.concatenate(held)
            held.clear()
            bucket = (pair["sig"] % U64(buckets)).astype(np.uint32 if buckets > 65535 else np.uint16)
            order = np.argsort(bucket, kind="stable")
            pair, bucket = pair[order], bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            sent = np.empty(len(pair), _SENT)
            sent["sig"], sent["node"] = pair["sig"] >> U64(32), pair["node"]
            blobs = [sent[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in slices(batches):
            data, starts = utf8(b.column("text"))
            flat, at, ids = _set_ids(shingle_sets(*word_hashes(data, starts), k))
            size = np.diff(at)
            band = np.searchsorted(lows, size, side="right") - 1
            spread = mix(flat ^ U64(0xA24BAED4963EE407))
            total = np.zeros(len(flat) + 1, U64)
            np.cumsum(spread, out=total[1:])
            raw, owner = [], []
            for i, own, j in zip(range(len(size)), ids.tolist(), band.tolist(), strict=True):
                if not size[i] or own in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(own)
                s = flat[at[i] : at[i + 1]]
                for plan in plans[max(0, j - 1) : j + 1]:
                    found = _raw_signatures(plan, plan.cut(s) + at[i], spread, total)
                    raw += found
                    owner.append((own, sum(len(x) for x, _ in found)))
            if raw:
                sig = mix(mix(np.concatenate([x for x, _ in raw])) + np.concatenate([n for _, n in raw]).astype(U64))
                pair = np.empty(len(sig), _PAIR)
                pair["sig"], pair["node"] = sig, np.repeat(np.array([x for x, _ in owner]), np.array([n for _, n in owner]))
                held.append(pair)
            if sum(map(len, held)) > 500_000:
                yield flush()
        if held:
            yield flush()

    return run


def _meet(small: int):
    """Per partition: signatures that two or more sets share, as candidate pairs and as members of large groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(k, np.frombuffer(x.as_buffer(), _SENT)) for b in batches for k, x in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True)]
        if not parts:
            return
        sig = np.concatenate([(x["sig"].astype(np.int64) << 24) + k for k, x in parts])
        node = np.concatenate([x["node"] for _, x in parts])
        del parts
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        del order
        alone = np.ones(len(sig), bool)
        same = sig[1:] == sig[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        sig, node = sig[~alone], node[~alone]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        if not len(sig):
            return
        cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
        size, first = np.diff(cut), cut[:-1]
        a, b = [], []
        for g in range(2, small + 1):
            at = first[size == g]
            if len(at):
                i, j = np.triu_indices(g, 1)
                grid = node[at[:, None] + np.arange(g)]
                a.append(grid[:, i].ravel())
                b.append(grid[:, j].ravel())
        big = np.repeat(size > small, size)
        lead = np.repeat(node[first], size)
        star = big & (lead != node)
        a.append(lead[star])
        b.append(node[star])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[new], b[new]
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b)], names=["sig", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(sig[big]), pa.array(lead[big]), pa.array(node[big])], names=["sig", "a", "b"])

    return run


def _texts_to_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, starts = utf8(b.column("text"))
            sets = shingle_sets(*word_hashes(data, starts), k)
            mine = _set_ids(sets)[2] == np.asarray(b.column("node"))  # another text with the row's key is none of its
            b = b.filter(pa.array(mine))
            sets = [x for x, own in zip(sets, mine.tolist(), strict=True) if own]
            parity, coarse = [], []
            for s in sets:
                few, bits = (1 << max(6, (k * len(s) - 1).bit_length()) for k in (1, 4))
                odd = (np.bincount((s % U64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
                parity.append(np.packbits(odd).tobytes())
                coarse.append(np.packbits(np.bitwise_xor.reduce(odd.reshape(-1, few))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(parity, pa.binary()), pa.array(coarse, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "parity", "coarse", "items"])

    return run


def _screen(num: int, den: int):
    """Bit i of a set's parity tells whether an odd number of its shingles hash to i, so two parities differ in no
    more bits than their sets differ in shingles. That bounds a pair's similarity from above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = []
            for p, q, x, y in zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), b.column("parity_a").to_pylist(), b.column("parity_b").to_pylist(), strict=True):
                u, v = int.from_bytes(x), int.from_bytes(y)
                i, j = 8 * len(x), 8 * len(y)
                while i != j:
                    if i > j:
                        i //= 2
                        u = (u >> i) ^ (u & ((1 << i) - 1))
                    else:
                        j //= 2
                        v = (v >> j) ^ (v & ((1 << j) - 1))
                both = min((p + q - (u ^ v).bit_count()) // 2, p, q)
                may.append(den * both >= num * (p + q - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(may, pa.bool_())], names=["a", "b", "may"])

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inter, union = [], []
        for p, q in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
            x, y = np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64)
            u, v = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(v, u)
            n = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            inter.append(n)
            union.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "inter", "union_size"])


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b) -> (a, b, linked), exactly; a kept table."""

    def side(name: str, *columns: str, of: DataFrame = sets) -> DataFrame:
        return of.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    thin = pairs.join(side("a", "n", "parity"), "a").join(side("b", "n", "parity"), "b")
    screened = keep(thin.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(lean(_screen(num, den)), "a long, b long, may boolean"), "screened")
    near = screened.where("may").select("a", "b")
    used = keep(near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct(), "used")
    items = sets.join(F.broadcast(used), "node", "left_semi") if used.count() <= BROADCAST_IDS else sets  # only these travel
    full = near.join(side("a", "items", of=items), "a").join(side("b", "items", of=items), "b").select("a", "b", "items_a", "items_b")
    exact = full.mapInArrow(lean(_overlap), "a long, b long, inter long, union_size long")
    out = keep(exact.select("a", "b", F.expr(f"{den} * inter >= {num} * union_size").alias("linked")).unionAll(screened.where("not may").select("a", "b", F.lit(False))), "checked")
    forget(screened, used)
    return out


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, n_equal_sets).

    Two documents link when den * |intersection| >= num * |union| of their distinct word shingles. Words are
    runs of bytes other than ASCII white space, with A-Z lowered. component_id is the smallest doc_id that
    links reach, n_equal_sets the documents with the very same set, itself included.
    Null and empty texts have no shingles and no links. Texts of any length are taken whole. Repeated doc_ids are
    separate rows; a null doc_id links like any other and is component_id only where no row of its component has
    one. An empty table gives an empty table. Columns other than doc_id and text are ignored. Documents with equal
    sets are one node, so copies are never paired. Shingles and sets are told apart by 64-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    told = keep(rows.mapInArrow(lean(_describe(shingle)), "doc_id long, key long, n_shingles long, set_id long"), "sets")
    own = F.coalesce("doc_id", F.lit(NO_ID))
    nodes = keep(told.where("n_shingles > 0").groupBy("set_id").agg(F.min(own).alias("rep"), F.min("key").alias("key"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")), "nodes")
    top = nodes.agg(F.max("n")).first()[0] or 0
    bands = band_edges(num, den, max(top, 1))
    band = F.expr("size(filter(array(" + ",".join(str(x) for x, _ in bands) + "), x -> x <= n)) - 1")
    counts = {r[0]: r[1] for r in nodes.groupBy(band.alias("band")).count().collect()}  # a row a band: as many as the logarithm of the largest set
    plans = [allocation(lo, hi, counts.get(i, 0) + counts.get(i + 1, 0), num, den) for i, (lo, hi) in enumerate(bands)]
    n = partitions(spark)
    blobs = rows.select("text").mapInArrow(lean(_emit(shingle, bands, plans, 4 * n)), "bucket long, blob binary").repartition(n, "bucket")
    met = keep(blobs.mapInArrow(lean(_meet(SMALL_GROUP)), "sig long, a long, b long"), "met")
    pairs = keep(met.where("sig is null or a <> b").select("a", "b").distinct(), "pairs")
    used = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select("b")).distinct()
    reps = keep(nodes.join(used, "set_id", "left_semi").select("key", F.col("set_id").alias("node")), "reps")
    n_used = reps.count()
    near = F.broadcast(reps) if n_used <= BROADCAST_IDS else reps  # saves a shuffle of all texts
    sets = keep(rows.select("key", "text").join(near, "key").select("node", "text").mapInArrow(lean(_texts_to_sets(shingle)), "node long, n long, parity binary, coarse binary, items binary"), "items")
    forget(reps)
    if sets.count() > n_used:  # only where rows repeat
        every, sets = sets, keep(sets.dropDuplicates(["node"]), "items")
        forget(every)
    done = [_verify(pairs, sets, num, den)]
    forget(pairs)
    comp = _linked(done)
    groups = met.where("sig is not null").select("sig", F.col("b").alias("node"))
    found = None
    for limit in ROUNDS if groups.limit(1).count() else ():
        last, checked = found, reduce(DataFrame.unionAll, done).select("a", "b")
        fresh, found = _rest(groups, found, checked, comp, sets, num, den, limit)
        forget(last)
        if fresh.limit(1).count():
            done.append(_verify(fresh, sets, num, den))
            if done[-1].where("linked").limit(1).count():
                forget(comp)
                comp = _linked(done)
        forget(fresh)
        if not found.where("more is not null").limit(1).count():
            break
    forget(met, sets, found, *done)
    rep_of = nodes.select(F.col("set_id").alias("component"), F.col("rep"))
    lead = comp.join(rep_of, F.col("node") == rep_of["component"]).groupBy(comp["component"]).agg(F.min("rep").alias("lead"))
    by_node = comp.join(lead, "component").select(F.col("node").alias("set_id"), "lead")
    final = nodes.join(by_node, "set_id", "left").select("set_id", "copies", F.nullif(F.coalesce("lead", "rep"), F.lit(NO_ID)).alias("lead"))
    return told.join(final, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("lead")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_equal_sets"),
    )


def _linked(done: list[DataFrame]) -> DataFrame:
    """Components of the links found so far."""
    return components(reduce(DataFrame.unionAll, done).where("linked").select("a", "b"))


_CELL = ("main", "left", "right")


def _within(num: int, den: int, limit: int | None):
    """Rows of one (component, block of queries, block of members) together -> pairs of different components that share a
    signature and that their sizes and parities allow to link, each once; of a query's candidates in one other component
    the `limit` likeliest. A row with `more` names a query that has others."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        parity = rows.column("parity").combine_chunks()
        data, at = utf8(parity)
        size = np.diff(at)
        width = int(size.min())
        par = np.empty((len(size), width // 8), U64)
        for n_bytes in np.unique(size).tolist():
            own = np.flatnonzero(size == n_bytes)
            x = data[at[own][:, None] + np.arange(n_bytes)].view(U64)
            par[own] = np.bitwise_xor.reduce(x.reshape(len(own), -1, width // 8), axis=1)
        node, comp, n, query, aside = (rows.column(c).to_numpy() for c in ("node", "c", "n", "query", "aside"))
        sigs = rows.column("sigs").combine_chunks()
        start, sig = np.asarray(sigs.offsets), np.asarray(sigs.values)
        a, b, more = [], [], []
        for i in np.flatnonzero(query).tolist():
            low, high = np.minimum(n, n[i]), np.maximum(n, n[i])
            j = np.flatnonzero(~query & (comp != comp[i]) & (~aside | (node > node[i])) & (den * low >= num * high))
            differ = np.bitwise_count(par[j] ^ par[i]).sum(axis=1, dtype=np.int64)
            both = np.minimum((n[j] + n[i] - differ) // 2, low[j])
            ok = den * both >= num * (n[j] + n[i] - both)
            j, both = j[ok], both[ok]
            mine = sig[start[i] : start[i + 1]]
            ok = np.array([np.isin(sig[start[k] : start[k + 1]], mine).any() for k in j.tolist()], bool)
            j, both = j[ok], both[ok]
            if limit is not None and len(j) > limit:
                order = np.lexsort((node[j], n[j] - both, comp[j]))
                c = comp[j][order]
                first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
                if place.max() >= limit:
                    more.append(node[i])
                j = j[order[place < limit]]
            a.append(np.full(len(j), node[i]))
            b.append(node[j])
        x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
        none = pa.nulls(len(more), pa.int64())
        columns = [pa.concat_arrays([pa.array(z(x, y)), none]) for z in (np.minimum, np.maximum)]
        return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(more, pa.int64())])], names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.column_stack([np.asarray(b.column(c)) for c in _CELL])
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if held and keys[x].tolist() != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                last = keys[x].tolist()
                held.append(b.slice(x, y - x))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _rest(groups: DataFrame, wanted: DataFrame | None, checked: DataFrame, comp: DataFrame, sets: DataFrame, num: int, den: int, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs of large groups that may link, are not yet connected and not yet checked; and a table whose `more` names sets that have
    others. If `wanted` is such a table, only what can concern its sets is looked at.

    Members of a group's largest component need no pairing with each other. All groups with one largest component are
    worked on together: a set stands there once, with the signatures that it has in common with others. Sets of other
    components are queries: in blocks of about BLOCK they are held against all sets there, also in blocks, by their
    coarse parities (a bit or two a shingle); only pairs that can reach the threshold leave a task. A set travels once a
    block of queries, a query once a block of sets.
    """
    member = groups.join(comp, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
    size = member.groupBy("sig", "c").agg(F.count("*").alias("k"))
    main = size.groupBy("sig").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("sig", F.col("m.c").alias("main"))
    per = keep(member.join(main, "sig").groupBy("main", "node", "c").agg(F.collect_set("sig").alias("sigs")), "members")
    aside = F.col("c") != F.col("main")
    cells = per.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(aside) / BLOCK).cast("int").alias("query_blocks"))
    if wanted is not None:
        named = wanted.where("more is not null").select(F.col("more").alias("node")).distinct()
        cells = cells.join(per.join(named, "node", "left_semi").select("main").distinct(), "main", "left_semi")
    rows = per.join(cells, "main").join(sets.select("node", "n", F.col("coarse").alias("parity")), "node").withColumn("aside", aside).withColumn("h", F.xxhash64("node"))
    members = rows.withColumns({"query": F.lit(False), "left": F.explode(F.expr("sequence(0, query_blocks - 1)")), "right": F.expr("cast(pmod(h, blocks) as int)")})
    queries = rows.where("aside").withColumns({"query": F.lit(True), "left": F.expr("cast(pmod(h, query_blocks) as int)"), "right": F.explode(F.expr("sequence(0, blocks - 1)"))})
    columns = (*_CELL, "node", "c", "n", "parity", "query", "aside", "sigs")
    dealt = members.select(*columns).unionAll(queries.select(*columns)).repartition(partitions(groups.sparkSession), *_CELL).sortWithinPartitions(*_CELL)
    found = keep(dealt.mapInArrow(lean(_within(num, den, limit)), "a long, b long, more long").distinct(), "found")
    fresh = keep(found.where("more is null").select("a", "b").join(checked, ["a", "b"], "left_anti"), "rest")
    forget(per)
    return fresh, found
