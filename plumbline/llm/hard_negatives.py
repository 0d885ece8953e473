"""Hard negatives by inner product, with cover trees over norm-augmented vectors.

A candidate x becomes (x, sqrt(M^2 - |x|^2)), M the largest norm of its block, and a query q becomes (q M / |q|, 0). All
candidates then lie on one sphere with the query, and the distance to a node's centre, more or less the node's covering
radius, bounds the inner products of what the node covers. A descent takes the node with the best bound first, leaves out nodes that
lie outside the window of wanted scores or cannot improve the result, and looks at the rows of leaves exactly.

Candidates are cut into blocks of nearby rows, one tree a block with a branch for each label; anchors come in groups. A task holds
one tree and one group at a time, and what it has found for a group bounds its descents into later trees. All anchors against all
rows is the question that is asked. The driver holds the reference points and numbers of rows, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .runtime import forget, keep, lean, partitions

#: Rows of a block at least and at most; between, so many that each task slot gets about two blocks.
BLOCK_ROWS = (1024, 65_536)
#: Bytes of a block's vectors at most.
BLOCK_BYTES = 64 << 20
#: Reference points that deal rows to blocks, at most; a point with too many rows is cut into several blocks.
PIVOTS = 1024
#: Bytes of the reference points' vectors at most: the driver holds them, and tasks get them.
PIVOT_BYTES = 4 << 20
#: Anchors of a group at most.
ASKED = 2048
#: Bytes of an Arrow batch about: a row here is a tree, or a tree and a group.
BATCH_BYTES = 16 << 20
#: Rows that a leaf holds unless they are equal, children of a node at most, and how much smaller a child's radius should be.
LEAF, FANOUT, SHRINK = 32, 16, 1.3
_LAST = (1 << 63) - 1


class Tree:
    """A cover tree over integer vectors, with a branch for each label.

    Node i has a centre row, a covering radius, a label, and either children first[i]..first[i] + n[i] or, as a leaf, rows in
    that range: rows stand in the order of leaves.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        norm = (vectors.astype(float) ** 2).sum(1)
        self.most = math.sqrt(norm.max(initial=0.0))
        full = np.column_stack([vectors.astype(float), np.sqrt(np.maximum(self.most**2 - norm, 0))])
        nodes: list[tuple[int, float, int]] = []
        rows: list[np.ndarray] = []
        children: dict[int, tuple[int, int]] = {}

        def far(own: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(((full[own] - full[centre]) ** 2).sum(1))

        def add(own: np.ndarray, centre: int) -> None:
            nodes.append((centre, float(far(own, centre).max(initial=0.0)), int(labels[own[0]])))
            rows.append(own)

        by_label = np.lexsort((ids, labels))
        for part in np.split(by_label, np.flatnonzero(np.diff(labels[by_label])) + 1):
            if len(part):
                add(part, int(part[0]))
        self.roots = np.arange(len(nodes))
        at = 0
        while at < len(nodes):  # level by level, since children are added behind
            own, (centre, radius, _) = rows[at], nodes[at]
            if len(own) > LEAF and radius > 0:
                centres, near, nearest = [centre], far(own, centre), np.zeros(len(own), int)
                while len(centres) < FANOUT and near.max() > radius / SHRINK:
                    c = int(own[near.argmax()])
                    d = far(own, c)
                    nearest[d < near] = len(centres)
                    near = np.minimum(near, d)
                    centres.append(c)
                parts = [(c, own[nearest == i]) for i, c in enumerate(centres)]
                parts = [x for x in parts if len(x[1])]
                if len(parts) > 1:
                    children[at] = (len(nodes), len(parts))
                    rows[at] = own[:0]
                    for c, part in parts:
                        add(part, c)
            at += 1
        self.order = np.concatenate(rows) if rows else np.zeros(0, int)
        place = np.empty(len(self.order), int)
        place[self.order] = np.arange(len(self.order))
        starts = np.cumsum([0, *map(len, rows)])
        self.ids, self.x = ids[self.order], vectors[self.order]
        self.centre = place[[c for c, _, _ in nodes]] if nodes else np.zeros(0, int)
        self.radius = np.array([r for _, r, _ in nodes], float)
        self.label = np.array([y for _, _, y in nodes], np.int64)
        self.leaf = np.array([i not in children for i in range(len(nodes))], bool)
        self.first = np.array([children.get(i, (starts[i], 0))[0] for i in range(len(nodes))], np.int64)
        self.n = np.array([children.get(i, (0, len(rows[i])))[1] for i in range(len(nodes))], np.int64)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each anchor with what each node covers, with room for rounding."""
        q = anchors.astype(float)
        size = np.sqrt((q**2).sum(1))[:, None]
        scale = np.where(size > 0, self.most / np.where(size > 0, size, 1), 0)
        # |q' - c'|^2 = 2 M^2 - 2 q'.c for q' of norm M (a zero anchor has zero products)
        d = np.sqrt(np.maximum(2 * self.most**2 - 2 * scale * (q @ self.x[self.centre].astype(float).T), 0))
        back = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
        product = lambda far: back * (self.most**2 - far**2 / 2)
        room = 1e-9 * size * self.most + 1e-6
        return product(np.minimum(d + self.radius, 2 * self.most)) - room, product(np.maximum(d - self.radius, 0)) + room

    def descend(self, anchor: np.ndarray, own: int, low: np.ndarray, high: np.ndarray, roots: np.ndarray, windows: list[tuple], k: int) -> list[list[tuple]]:
        """For each window (least, most) the k best (score, id, row) with least <= score <= most below roots, without the
        row `own`; ties by smaller id. Levels leave out nodes outside all windows; leaves are looked at from the best bound
        on, until no window can gain."""
        least, most = min(w[0] for w in windows), max(w[1] for w in windows)
        leaves, level = [], roots
        while len(level):
            level = level[(low[level] <= most) & (high[level] >= least)]
            leaves.append(level[self.leaf[level]])
            level = _ranges(self.first, self.n, level[~self.leaf[level]])
        at = np.concatenate(leaves) if leaves else roots[:0]
        at = at[np.argsort(-high[at], kind="stable")]
        ends = np.cumsum(self.n[at])
        rows, scores, done, look = [], [], 0, 8 * LEAF
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while done < len(at):
            to = min(len(at), max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + look, side="right"))))
            new = _ranges(self.first, self.n, at[done:to])
            new = new[new != own]
            rows.append(new)
            scores.append(self.x[new] @ anchor)
            done, look = to, 2 * look
            r, s = np.concatenate(rows), np.concatenate(scores)
            found = [(r[inside], s[inside]) for lo, hi in windows for inside in [((s >= lo) & (s <= hi)).astype(bool)]]
            if done < len(at) and all(lo > high[at[done]] or len(s) >= k and np.sort(s)[-k] > high[at[done]] for (lo, _), (_, s) in zip(windows, found, strict=True)):
                break
        out = []
        for r, s in found:
            if len(s) > k:
                top = (s >= np.sort(s)[-k]).astype(bool)
                r, s = r[top], s[top]
            out.append(sorted(zip(s.tolist(), self.ids[r].tolist(), r.tolist(), strict=True), key=lambda x: (-x[0], x[1], x[2]))[:k])
        return out or [[] for _ in windows]


def _ranges(first: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for every i of at."""
    size = n[at]
    return np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Ragged vectors as rows of float32; shorter ones are filled with zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.float32)
    out[np.arange(width) < sizes[:, None]] = np.asarray(vectors.flatten())
    return out


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x): float64 while inner products are exact there, Python integers beyond."""
    out = np.floor(256 * vectors.astype(float))
    if len(out) and (out**2).sum(1).max() >= 2.0**53:
        out = np.array([[int(x) for x in v] for v in out], object).reshape(out.shape)
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    kind = object if object in (a.dtype, b.dtype) else float
    wide = lambda x: np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], 1).astype(kind)
    return wide(a), wide(b)


def _keep(df: DataFrame, name: str) -> DataFrame:
    """keep(df, name) with batches of BATCH_BYTES."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH_BYTES))
    try:
        return keep(df, name)
    finally:
        conf.set(key, before)


def usable(embeddings: DataFrame) -> DataFrame:
    """(rid, vec_id, label, embedding) of the rows that have a label and a vector of finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))


def _pivots(embeddings: DataFrame, n: int, total: int) -> np.ndarray:
    """Vectors of at most n rows of total: of about 8 n rows that their hashes choose, the first of each class of hashes. Tasks
    send rows to each other, and at most n come to the driver."""
    own = F.xxhash64("vec_id", "embedding")
    some = embeddings.where(F.pmod(own, F.lit(max(1, total // (8 * n)))) == 0)
    first = some.groupBy(F.pmod(F.xxhash64(own), F.lit(n))).agg(F.min_by("embedding", own).alias("embedding"))
    found = first.select("embedding").collect() or embeddings.select("embedding").limit(1).collect()  # many equal rows: perhaps none
    return matrix(pa.array([r["embedding"] for r in found], pa.list_(pa.float32())))


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with the number of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, p = _same_width(matrix(b.column("embedding")), pivots)
            near = (-2 * (v @ p.T) + (p**2).sum(1)).argmin(1).astype(np.int64) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[*b.schema.names, "pivot"])

    return rows.mapInArrow(lean(run), "vec_id long, label long, embedding array<float>, pivot long")


_LONGS, _LISTS = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
_TREE = pa.schema([("block", pa.int64()), ("ids", _LONGS), ("rids", _LONGS), ("width", pa.int64()), ("vectors", pa.binary()), ("roots", _LONGS), ("centre", _LONGS), ("radius", pa.list_(pa.float64())), ("label", _LONGS), ("leaf", pa.list_(pa.bool_())), ("first", _LONGS), ("n", _LONGS)])
_TREE_DDL = "block long, ids array<long>, rids array<long>, width long, vectors binary, roots array<long>, centre array<long>, radius array<double>, label array<long>, leaf array<boolean>, first array<long>, n array<long>"
_ASKED_DDL = "group long, asked array<long>, kinds array<long>, asked_width long, asked_vectors binary, windows array<array<long>>"


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows -> their trees, as arrays."""
    for b in batches:
        for i in range(b.num_rows):
            rows = b.column("rows")[i].values
            ids, rids, labels = (np.asarray(rows.field(c).fill_null(_LAST)) for c in ("vec_id", "rid", "label"))
            given = matrix(rows.field("embedding"))
            t = Tree(ids, labels, whole_numbers(given))
            parts = {c: getattr(t, c) for c in ("ids", "roots", "centre", "radius", "label", "leaf", "first", "n")}
            row = {"block": b.column("block")[i].as_py(), "rids": rids[t.order], "width": given.shape[1], "vectors": given[t.order].tobytes()} | parts
            yield pa.RecordBatch.from_pylist([row], schema=_TREE)


def _grown(b: pa.RecordBatch, i: int) -> tuple[Tree, np.ndarray]:
    """The tree of a stored block, and its rows' rids."""
    t = Tree.__new__(Tree)
    for c in ("ids", "roots", "centre", "radius", "label", "leaf", "first", "n", "rids"):
        setattr(t, c, b.column(c)[i].values.to_numpy(zero_copy_only=False))
    t.x = whole_numbers(np.frombuffer(b.column("vectors")[i].as_py(), np.float32).reshape(len(t.ids), b.column("width")[i].as_py()))
    t.most = math.sqrt(float((t.x.astype(float) ** 2).sum(1).max(initial=0.0)))
    return t, t.rids


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors -> the same with their vectors in one value."""
    for b in batches:
        for i in range(b.num_rows):
            rows = b.column("rows")[i].values
            x = matrix(rows.field("embedding"))
            columns = [pa.array([v], t) for v, t in ((b.column("group")[i].as_py(), pa.int64()), (rows.field("rid").to_pylist(), _LONGS), (rows.field("label").to_pylist(), _LONGS), (x.shape[1], pa.int64()), (x.tobytes(), pa.binary()), (rows.field("windows").to_pylist(), _LISTS))]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "asked", "kinds", "asked_width", "asked_vectors", "windows"])


_HITS = "anchor long, window long, rid long, vec_id long, score long"


class _Asked:
    """A group of anchors, and the k best rows for each anchor and window in the trees so far."""

    def __init__(self, b: pa.RecordBatch, j: int):
        self.rids, self.kinds = (b.column(c)[j].values.to_numpy() for c in ("asked", "kinds"))
        self.x = whole_numbers(np.frombuffer(b.column("asked_vectors")[j].as_py(), np.float32).reshape(len(self.rids), b.column("asked_width")[j].as_py()))
        self.windows = b.column("windows")[j].as_py()
        self.best: dict[tuple[int, int | None], list[tuple]] = {}  # (anchor's place, window) -> (-score, vec_id, rid), in order

    def meet(self, tree: Tree, rids: np.ndarray, k: int, same: bool, low_share: int, high_share: int) -> None:
        tree.x, q = _same_width(tree.x, self.x)
        by_rid = np.argsort(rids)
        at = by_rid[np.minimum(np.searchsorted(rids, self.rids, sorter=by_rid), len(rids) - 1)]
        own = np.where(rids[at] == self.rids, at, -1)
        for start in range(0, len(q), 256):  # bounds of so many anchors at once
            low, high = tree.bounds(q[start : start + 256])
            for i in range(start, min(start + 256, len(q))):
                roots = tree.roots[(tree.label[tree.roots] == self.kinds[i]) == same]
                # low_share * positive <= 100 * negative <= high_share * positive
                windows = [(None, -math.inf, math.inf)] if same else [(w, -(-low_share * w // 100), high_share * w // 100) for w in self.windows[i]]
                held = [self.best.get((i, w), []) for w, _, _ in windows]
                # nothing below the k-th of what is held counts any more
                windows = [(w, max(lo, -h[k - 1][0]) if len(h) >= k else lo, hi) for (w, lo, hi), h in zip(windows, held, strict=True)]
                windows = [w for w in windows if w[1] <= w[2]]
                found = tree.descend(q[i], int(own[i]), low[i - start], high[i - start], roots, [w[1:] for w in windows], k) if windows and len(roots) else []
                for (w, _, _), hits in zip(windows, found, strict=False):
                    if hits:
                        new = [(-int(score), vec_id, int(rids[row])) for score, vec_id, row in hits]
                        self.best[i, w] = sorted(self.best.get((i, w), []) + new)[:k]

    def found(self) -> Iterator[pa.RecordBatch]:
        anchors = [(int(self.rids[i]), w, rid, None if vec_id == _LAST else vec_id, -score) for (i, w), hits in self.best.items() for score, vec_id, rid in hits]
        if anchors:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*anchors, strict=True)], names=["anchor", "window", "rid", "vec_id", "score"])


def _search(k: int, same: bool, low_share: int, high_share: int):
    """Pairs of a block's tree and a group of anchors -> the k best rows of this task's trees for each anchor and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Asked] = {}
        block, tree, rids = None, None, None
        for b in batches:
            for j in range(b.num_rows):
                if tree is None or block != b.column("block")[j].as_py():
                    block, (tree, rids) = b.column("block")[j].as_py(), _grown(b, j)
                group = b.column("group")[j].as_py()
                if group not in asked:
                    asked[group] = _Asked(b, j)
                asked[group].meet(tree, rids, k, same, low_share, high_share)
        for group in asked.values():
            yield from group.found()

    return run


def mine(embeddings: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90, block_rows: int | None = None) -> DataFrame:
    """embeddings(vec_id, label, embedding) as usable() gives them; anchors: a condition on its columns.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor the `positives`
    best other rows of its label, and for each of those the `negatives` best rows of other labels with low_share * positive_score <=
    100 * negative_score <= high_share * positive_score.

    Scores are inner products of floor(256 x), in whole numbers; higher ones first, ties by smaller vec_id (null
    last). Repeated rows are rows of their own, so equal rows may stand beside each other; vectors of different lengths
    count as filled with zeros. Scores beyond 63 bits end in an error. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ship(spark)
    n, width = embeddings.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    each = block_rows or max(1, min(max(BLOCK_ROWS[0], min(BLOCK_ROWS[1], n // (2 * partitions(spark)))), BLOCK_BYTES // (8 * max(1, width))))
    pivots = _pivots(embeddings, max(1, min(PIVOTS, -(-n // each), PIVOT_BYTES // (4 * max(1, width)))), n)
    rows = keep(_dealt(embeddings, pivots).select("*", F.monotonically_increasing_id().alias("rid")), "vectors")
    parts = rows.groupBy("pivot").agg(F.ceil(F.count("*") / each).alias("parts"))  # a row a pivot
    dealt = rows.join(F.broadcast(parts), "pivot").withColumn("block", F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("rid"), "parts"))
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("rid", "vec_id", "label", "embedding")).alias("rows"))
    trees = _keep(blocks.mapInArrow(lean(_plant), _TREE_DDL), "trees")
    chosen = rows.where(anchors).select("rid", "vec_id", "label", "embedding")
    groups = max(1, -(-chosen.count() // min(each, ASKED)))
    streams = max(1, -(-max(partitions(spark), spark.sparkContext.defaultParallelism) // groups))

    def against(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """asked(rid, label, embedding, windows) in groups, each against every tree; the best k over all trees. The trees are cut into
        `streams`: each of them goes by every partition of groups, so trees and groups meet without copies of either."""
        met = asked.groupBy(F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("rid", "label", "embedding", "windows")).alias("rows"))
        sent = met.mapInArrow(lean(_packed), _ASKED_DDL).repartition(groups)
        hits = trees.coalesce(streams).hint("shuffle_replicate_nl").crossJoin(sent).mapInArrow(lean(_search(k, same, low_share, high_share)), _HITS)
        place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid"))
        return hits.withColumn("place", place).where(F.col("place") <= k)

    near = _keep(against(chosen.withColumn("windows", F.array().cast("array<long>")), positives, True).drop("window"), "positives")
    windows = near.groupBy(F.col("anchor").alias("rid")).agg(F.collect_set("score").alias("windows"))
    far = _keep(against(chosen.join(windows.hint("merge"), "rid"), negatives, False), "negatives")
    forget(trees)
    ids = chosen.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pos = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = far.select("anchor", F.col("window").alias("positive_score"), F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pos.join(neg.hint("merge"), ["anchor", "positive_score"]).join(ids.hint("merge"), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest(embeddings: DataFrame) -> DataFrame:
    """mine() for anchors whose vec_id is divisible by 100; where vec_id is divisible by 7, label becomes (label + 1) % 10 first. Rows
    with a null label or vector, or a component that is null or not finite, take no part; other columns are ignored."""
    rows = usable(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
