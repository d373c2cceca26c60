"""Hard negatives by dual-tree search.

Rows are dealt by vector length, label and the signs of a few random projections, sorted, and cut into blocks; each block becomes a
ball tree. Anchors become trees in the same way, and go round by broadcast in groups of bounded size. A task walks each
pair of an anchor tree and a candidate tree from both roots: the inner products of two nodes lie between bounds made of
their centres and radii, and if no anchor of one asks for a score in them, the pair goes with all that is below.
Pairs of leaves are scored exactly, in integers.

A first search asks for positives, a second one for the negatives in the score windows that the positives open. Each goes
over a share of the trees first, whose k-th best scores are the least that the others have to beat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.common import Scratch, arrow_map, buckets, give_back

#: Rows of a candidate tree, anchors of an anchor tree, and rows of their leaves.
TREE_ROWS = 8192
LEAF = 64
ANCHOR_LEAF = 16
#: Anchors that go round at once; of their trees no broadcast has more.
GROUP_ANCHORS = 4 * TREE_ROWS
#: Projections whose signs deal rows of one label.
SIGNS = 12
#: One tree in SHARE is searched first.
SHARE = 16
#: Squared norms up to which products fit in 64 bits, and up to which doubles hold them exactly.
LONGEST = 2.0**61
EXACT = 2.0**52
NONE = -(2**62)

DEALT = "dim int, label long, cell int, vec_id long, row long, raw binary"
TREES = (
    "dim int, n int, tree long, kind string, vectors binary, rows binary, ids binary, labels binary, "
    "nodes binary, centres binary, radii binary"
)


def usable(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, row, v (floor of scale times each component) of the rows that take part."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    df = df.where("vec_id is not null and label is not null and size(x) > 0")
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    short = F.aggregate("x", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1)) <= F.lit(LONGEST)
    return df.where(finite).where(short).select("vec_id", "label", F.monotonically_increasing_id().alias("row"), F.transform("x", lambda x: F.floor(x)).alias("v"))


def _signs(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, SIGNS))


def _deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with the signs of their projections (the first in the highest bit) and their vector as bytes."""
    column = batch["v"]
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == dim)
        vectors = values[offsets[some][:, None] + np.arange(dim)].astype("<i8")
        cell = (vectors @ _signs(dim) > 0) @ (1 << np.arange(SIGNS)[::-1])
        raw = pa.array([v.tobytes() for v in vectors], pa.binary())
        rows = batch.take(pa.array(some))
        yield pa.record_batch([pa.array(np.full(len(some), dim, np.int32)), rows["label"], pa.array(cell.astype(np.int32)), rows["vec_id"], rows["row"], raw], ["dim", "label", "cell", "vec_id", "row", "raw"])


def _smallest(vectors: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    most = int(np.abs(vectors).max(initial=0))
    return vectors.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")


def build(vectors: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A ball tree: the rows' order; of each node begin, end, left and right child (or -1), parent, least and largest label; centres; radii.

    A node is cut in two at the median of the component that varies most, until it has `leaf` rows or less.
    """
    order = np.arange(len(vectors))
    x = vectors.astype(np.float64)
    nodes: list[list[int]] = []
    centres, radii = [], []
    waiting = [(0, len(vectors), -1, 0)]
    while waiting:
        a, b, parent, side = waiting.pop()
        own = x[order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        centre = own.mean(axis=0)
        here = len(nodes)
        held = labels[order[a:b]]
        nodes.append([a, b, -1, -1, parent, int(held.min()), int(held.max())])
        centres.append(centre)
        radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        if parent >= 0:
            nodes[parent][2 + side] = here
        if b - a > leaf:
            widest = int(np.argmax(high - low))
            order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]
            middle = (a + b) // 2
            waiting += [(middle, b, here, 1), (a, middle, here, 0)]
    return order, np.array(nodes, np.int64), np.array(centres), np.array(radii)


def _plant(batch: pa.RecordBatch, leaf: int) -> Iterator[pa.RecordBatch]:
    """Trees of the batch's rows, each of one vector length and at most TREE_ROWS rows."""
    dims = np.asarray(batch["dim"])
    cuts = np.concatenate([[0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)]])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for a in range(low, high, TREE_ROWS):
            part = batch.slice(a, min(TREE_ROWS, high - a))
            dim = int(dims[a])
            vectors = np.frombuffer(b"".join(part["raw"].to_pylist()), "<i8").reshape(-1, dim)
            labels, rows, ids = (np.asarray(part[c]) for c in ("label", "row", "vec_id"))
            order, nodes, centres, radii = build(vectors, labels, leaf)
            packed = _smallest(vectors[order])
            binaries = (x.tobytes() for x in (packed, rows[order], ids[order], labels[order], nodes, centres, radii))
            row = [dim, len(order), int(rows.min()), packed.dtype.str, *binaries]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 7]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in TREES.split(", ")])


class Tree:
    """A stored ball tree; it travels as it is stored."""

    def __init__(self, row: dict):
        self.row, self.dim = row, row["dim"]
        integers = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, self.dim)
        self.longest = float((integers.astype(np.float64) ** 2).sum(axis=1).max())
        self.integers, self.vectors = integers.astype(np.int64), integers.astype(np.float64)
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 7)
        self.centres = np.frombuffer(row["centres"]).reshape(-1, self.dim)
        self.radii = np.frombuffer(row["radii"])
        self.norms = np.sqrt((self.centres**2).sum(axis=1))

    def __reduce__(self):
        return Tree, (self.row,)

    def products(self, other: Tree, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Exact inner products of rows a..b-1 with the other's rows c..d-1."""
        if self.longest * other.longest < EXACT**2:
            return (self.vectors[a:b] @ other.vectors[c:d].T).astype(np.int64)
        return self.integers[a:b] @ other.integers[c:d].T

    def bounds(self, other: Tree) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of nodes the least and the largest inner product that their rows can have."""
        middle = self.centres @ other.centres.T
        slack = self.radii[:, None] * other.norms + self.norms[:, None] * other.radii + self.radii[:, None] * other.radii
        slack += 1e-9 * (self.norms + self.radii)[:, None] * (other.norms + other.radii) + 1e-6
        return middle - slack, middle + slack


class Asks:
    """What the anchors of a tree ask for: the k best scores from low to high, of rows of their own label or of others.

    at: each ask's anchor, ascending places in the tree; number: which of the anchor's asks it is.
    """

    def __init__(self, tree: Tree, at: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.tree, self.at, self.number, self.low, self.high, self.k, self.same = tree, at, number, low, high, k, same
        self.first = np.searchsorted(at, np.arange(len(tree.rows) + 1))

    def begin(self) -> None:
        """Nothing found yet. A node's pair is only walked while one of its anchors still asks for a score in its bounds."""
        n = len(self.at)
        self.scores = np.full((n, self.k), NONE, np.int64)
        self.ids, self.found = np.full((n, self.k), 2**63 - 1, np.int64), np.full((n, self.k), -1, np.int64)
        self.need, self.worst = self.low.copy(), np.full(n, 2**63 - 1, np.int64)
        # Of each node the least score that one of its anchors still asks for, and the largest.
        self.least, self.most = [], []
        for a, b in self.tree.nodes[:, :2].tolist():
            s, e = self.first[a], self.first[b]
            self.least.append(int(self.need[s:e].min(initial=2**62)))
            self.most.append(int(self.high[s:e].max(initial=NONE)))

    def visit(self, other: Tree) -> None:
        """Walks the node pairs of both trees, the most promising first."""
        tree = self.tree
        low, high = (np.floor(b).astype(np.int64) if i else np.ceil(b).astype(np.int64) for i, b in enumerate(tree.bounds(other)))
        low, high = low.tolist(), high.tolist()
        mine, theirs = tree.nodes.tolist(), other.nodes.tolist()
        waiting = [(0, 0)]
        while waiting:
            a, c = waiting.pop()
            x, y = mine[a], theirs[c]
            if high[a][c] < self.least[a] or low[a][c] > self.most[a]:
                continue
            if self.same and (x[6] < y[5] or y[6] < x[5]) or not self.same and x[5] == x[6] == y[5] == y[6]:
                continue
            if x[2] < 0 and y[2] < 0:
                self.score(a, x, other, y)
            elif y[2] < 0 or x[2] >= 0 and tree.radii[a] >= other.radii[c]:
                waiting += sorted(((x[2], c), (x[3], c)), key=lambda p: high[p[0]][p[1]])
            else:
                waiting += sorted(((a, y[2]), (a, y[3])), key=lambda p: high[p[0]][p[1]])

    def score(self, node: int, x: list[int], other: Tree, y: list[int]) -> None:
        tree, (a, b), (c, d) = self.tree, x[:2], y[:2]
        s, e = int(self.first[a]), int(self.first[b])
        if s == e:
            return
        at = self.at[s:e] - a
        scores = tree.products(other, a, b, c, d)
        allowed = (tree.labels[a:b, None] == other.labels[c:d]) == self.same
        allowed &= tree.rows[a:b, None] != other.rows[c:d]
        ids, rows = other.ids[c:d], other.rows[c:d]
        scores, need = scores[at], self.need[s:e, None]
        better = (scores > need) | (scores == need) & (ids < self.worst[s:e, None])
        better &= allowed[at] & (scores <= self.high[s:e, None])
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        own = some + s
        wide = lambda kept, new, none: np.concatenate([kept[own], np.where(better[some], new, none)], axis=1)
        scores, ids, rows = wide(self.scores, scores[some], NONE), wide(self.ids, ids, 2**63 - 1), wide(self.found, rows, -1)
        best = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.scores[own], self.ids[own], self.found[own] = (np.take_along_axis(v, best, axis=1) for v in (scores, ids, rows))
        full = self.scores[own, -1] > NONE
        self.need[own[full]], self.worst[own[full]] = self.scores[own[full], -1], self.ids[own[full], -1]
        self.least[node] = int(self.need[s:e].min())
        while (node := int(tree.nodes[node, 4])) >= 0:
            least = min(self.least[int(i)] for i in tree.nodes[node, 2:4])
            if least == self.least[node]:
                break
            self.least[node] = least

    def kept(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.scores > NONE)
        columns = (self.tree.rows[self.at[i]], self.number[i].astype(np.int32), self.scores[i, j], self.ids[i, j], self.found[i, j])
        return pa.record_batch([pa.array(c) for c in columns], ["anchor", "number", "score", "vec_id", "row"])


def _search(trees: DataFrame, sent) -> DataFrame:
    """The best of each partition's trees for each of the asks in a broadcast."""

    def run(batches):
        asks = None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    if asks is None:
                        asks = sent.value
                        for x in asks:
                            x.begin()
                    other = Tree(batch.slice(i, 1).to_pylist()[0])
                    for x in asks:
                        if x.tree.dim == other.dim:
                            x.visit(other)
            for x in asks or []:
                yield x.kept()
        finally:
            give_back()

    return trees.mapInArrow(run, "anchor long, number int, score long, vec_id long, row long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each ask, with their rank. A task has handed on k at most."""
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Forest:
    """Candidate trees and the searches over them."""

    def __init__(self, trees: DataFrame, scratch: Scratch):
        self.trees, self.scratch, self.spark = trees, scratch, trees.sparkSession

    def top(self, asks: list[Asks], k: int, name: str) -> DataFrame:
        first = F.pmod(F.xxhash64("tree"), F.lit(SHARE)) == 0
        begun = self.asked(self.trees.where(first), asks, f"{name}_first")
        worst = _best(begun, k).where(F.col("rank") == k).select("anchor", "number", "score").toArrow()
        # At most one number for each of the group's asks.
        anchor, number, score = (worst[c].to_numpy() for c in ("anchor", "number", "score"))
        for x in asks:
            keys = {(r, j): i for i, (r, j) in enumerate(zip(x.tree.rows[x.at].tolist(), x.number.tolist(), strict=True))}
            for r, j, s in zip(anchor.tolist(), number.tolist(), score.tolist(), strict=True):
                if (r, j) in keys:
                    x.low[keys[r, j]] = max(x.low[keys[r, j]], s)
        rest = self.asked(self.trees.where(~first), asks, f"{name}_rest")
        return _best(begun.unionByName(rest), k)

    def asked(self, trees: DataFrame, asks: list[Asks], name: str) -> DataFrame:
        """What the trees hold for the asks, stored, so that the asks needn't stay on the executors."""
        sent = self.spark.sparkContext.broadcast(asks)
        try:
            return self.scratch.store(_search(trees, sent), name)
        finally:
            sent.destroy()


def mine_hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels whose score is `low` to `high` percent of the positive's.

    Anchors are the rows whose id is divisible by `every`. Components x become floor(scale * x); a score is the integer
    inner product with the anchor; higher scores come first, equal ones by smaller id. An anchor's positives are its best
    other rows of the same label. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id or label, or a vector that is null, empty or holds null or non-finite components take no part, nor do
    vectors so long (a squared norm over 2**61, scaled) that scores could leave 64 bits. Vectors of different lengths are
    not compared. Rows of one id are rows of their own: each can be an anchor, a positive and a negative. A negative
    positive score has no negatives. An empty table gives an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    dealt = scratch.store(arrow_map(usable(vectors, scale, id_col, label_col, vector_col), _deal, DEALT), "dealt")
    order = ["dim", "label", "cell", "vec_id", "row"]
    # Ids are part of the order, so that equal vectors are split like others.
    planted = dealt.repartitionByRange(buckets(spark), *order).sortWithinPartitions(*order)
    forest = Forest(scratch.store(arrow_map(planted, lambda b: _plant(b, LEAF), TREES), "trees"), scratch)
    anchors = dealt.where(F.col("vec_id") % every == 0).repartitionByRange(max(1, buckets(spark) // 8), *order).sortWithinPartitions(*order)
    anchors = scratch.store(arrow_map(anchors, lambda b: _plant(b, ANCHOR_LEAF), TREES), "anchors")

    # A number for each tree of anchors; groups of GROUP_ANCHORS at most, one tree at least.
    groups: list[list[int]] = []
    room = 0
    for r in anchors.select("tree", "n").orderBy("dim", "tree").collect():
        if not groups or r.n > room:
            groups.append([])
            room = GROUP_ANCHORS
        groups[-1].append(r.tree)
        room -= r.n
    parts = []
    for i, group in enumerate(groups):
        trees = [Tree(r) for r in anchors.where(F.col("tree").isin(group)).toArrow().to_pylist()]
        whole = [(t, np.arange(len(t.rows))) for t in trees]
        asks = [Asks(t, at, np.zeros(len(at), np.int64), np.full(len(at), NONE + 1), np.full(len(at), 2**62), positives, True) for t, at in whole]
        best = scratch.store(forest.top(asks, positives, f"positives_{i}"), f"best_{i}")
        # At most `positives` rows for each anchor of the group.
        own = best.select("anchor", "rank", "score").toArrow()
        row, rank, score = (own[c].to_numpy() for c in ("anchor", "rank", "score"))
        least, most = _share(score, low, up=True), _share(score, high, up=False)
        asks = []
        for t, _ in whole:
            by_row = np.argsort(t.rows)
            place = np.searchsorted(t.rows[by_row], row)
            some = np.flatnonzero((place < len(by_row)) & (t.rows[by_row[np.minimum(place, len(by_row) - 1)]] == row) & (least <= most))
            at = by_row[place[some]]
            ranked = np.lexsort((rank[some], at))
            some = some[ranked]
            asks.append(Asks(t, at[ranked], rank[some].astype(np.int64), least[some].copy(), most[some].copy(), negatives, False))
        found = forest.top(asks, negatives, f"negatives_{i}").select("anchor", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        wanted = best.select("anchor", F.col("rank").alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        parts.append(scratch.store(found.join(wanted, ["anchor", "number"]), f"mined/{i}"))
    schema = "anchor long, number int, rank int, negative_id long, negative_score long, positive_id long, positive_score long"
    mined = spark.read.schema(schema).parquet(f"{scratch.path}/mined/*") if parts else spark.createDataFrame([], schema)
    ids = dealt.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return mined.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent % of each score, rounded up or down, without leaving 64 bits."""
    tens, rest = np.divmod(score, 100)
    return tens * percent + (-(-rest * percent // 100) if up else rest * percent // 100)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"))
