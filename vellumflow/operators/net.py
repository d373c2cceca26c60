"""A net with one hidden layer on sparse vectors: Linear, ReLU, dropout, Linear, trained by AdamW with early stopping.

Spark has no such learner. Rows lie in blocks on all tasks; at each step every task adds up the gradients of its rows of the step's
batch, a tree of sums brings them together, and the driver, which holds the weights only, makes one AdamW step. Which batch a row
is in and what dropout leaves of it follow from a hash of its key and the epoch, so that the loss curve doesn't depend on how rows
are partitioned, but for the order in which floats are added. Scoring runs Arrow batch by batch on all tasks.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.sources.shared import run_folder

HIDDEN, DROPOUT, BATCH, RATE, DECAY, EPOCHS, PATIENCE = 384, 0.25, 128, 1e-3, 1e-4, 20, 4
#: Steps of an epoch, at most: with more rows a batch has more than BATCH rows.
STEPS = 32
LEAST_GAIN = 1e-4
#: Rows of a block, at most.
BLOCK = 2048
#: Tasks whose sums the driver adds up itself.
FEW_TASKS = 16
Weights = list[np.ndarray]


class Sparse:
    """Rows of (indices, values) as dense batches of `size` columns."""

    def __init__(self, index, value, size: int):
        self.counts = np.array([len(x) if x is not None else 0 for x in index], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(x, kind) for x in parts if x is not None)])
        self.index, self.value, self.size = join(index, np.int64), join(value, np.float32), size

    @classmethod
    def of_lists(cls, index: pa.ListArray, value: pa.ListArray, size: int) -> Sparse:
        """The same of Arrow's lists, without an object for each number."""
        out = cls([], [], size)
        out.counts = pc.fill_null(pc.list_value_length(index), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out.first = np.concatenate([[0], np.cumsum(out.counts)])
        out.index, out.value = index.flatten().to_numpy(zero_copy_only=False).astype(np.int32), value.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        return out

    def __len__(self) -> int:
        return len(self.counts)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.size), np.float32)
        for i, r in enumerate(rows):
            a, b = self.first[r], self.first[r + 1]
            out[i, self.index[a:b]] = self.value[a:b]
        return out


def initial(size: int, labels: int, hidden: int, rng: np.random.Generator) -> Weights:
    """Uniform within one over the root of what comes in."""
    layer = lambda a, b: [rng.uniform(-1, 1, (a, b)).astype(np.float32) / np.sqrt(a), rng.uniform(-1, 1, b).astype(np.float32) / np.sqrt(a)]
    return [*layer(max(size, 1), hidden), *layer(hidden, labels)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(w: Weights, x: np.ndarray) -> np.ndarray:
    return softmax(np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3])


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: np.ndarray | None) -> tuple[float, np.ndarray, Weights]:
    """Weighted mean cross-entropy, probabilities, and the gradient; keep: what dropout leaves of the hidden layer, scaled."""
    before = x @ w[0] + w[1]
    hidden = np.maximum(before, 0)
    if keep is not None:
        hidden = hidden * keep
    p = softmax(hidden @ w[2] + w[3])
    share = (weight / weight.sum())[:, None].astype(np.float32)
    rows = np.arange(len(y))
    loss = -float((share[:, 0] * np.log(np.maximum(p[rows, y], 1e-12))).sum())
    back = p.copy()
    back[rows, y] -= 1
    back *= share
    inner = back @ w[2].T
    if keep is not None:
        inner = inner * keep
    inner = inner * (before > 0)
    return loss, p, [x.T @ inner, inner.sum(axis=0), hidden.T @ back, back.sum(axis=0)]


class AdamW:
    def __init__(self, w: Weights, rate: float, decay: float):
        self.w, self.rate, self.decay, self.t = w, rate, decay, 0
        self.m, self.v = ([np.zeros_like(x) for x in w] for _ in range(2))

    def step(self, grads: Weights) -> None:
        self.t += 1
        for x, g, m, v in zip(self.w, grads, self.m, self.v, strict=True):
            x *= 1 - self.rate * self.decay
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Block:
    """Some rows: vectors, label numbers, and a hash of each key."""

    x: Sparse
    y: np.ndarray
    h: np.ndarray


class Blocks:
    """Blocks in this process, and sums over them."""

    def __init__(self, blocks: Iterable[Block]):
        self.blocks = list(blocks)

    def total(self, f: Callable[[Block, Weights], list], w: Weights) -> list:
        return _added([f(b, w) for b in self.blocks])


class Spread(Blocks):
    """Blocks on the executors; sums come together in a tree."""

    def __init__(self, rdd: RDD):
        self.rdd = rdd

    def total(self, f: Callable[[Block, Weights], list], w: Weights) -> list:
        sent = self.rdd.context.broadcast(w)
        try:
            # Sums of few tasks come together at once, those of many by one stage more.
            depth = 1 if self.rdd.getNumPartitions() <= FEW_TASKS else 2
            return self.rdd.map(lambda b: f(b, sent.value)).treeReduce(lambda a, b: _added([a, b]), depth)
        finally:
            sent.destroy()


def _added(parts: list[list]) -> list:
    return [sum(some[1:], some[0]) for some in zip(*parts, strict=True)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _kept(h: np.ndarray, hidden: int, dropout: float) -> np.ndarray:
    """What dropout leaves of the hidden units of rows, scaled."""
    drawn = _mixed(h[:, None] + np.arange(1, hidden + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (drawn >= np.uint64(int(dropout * 2.0**64))).astype(np.float32) / np.float32(1 - dropout)


def _step(block: Block, w: Weights, epoch: int, step: int, steps: int, seed: int, weight: np.ndarray, dropout: float) -> list:
    """Of a block's rows of a step's batch: weight, weighted loss, rows, rows told right, and weighted gradients."""
    h = _mixed(block.h ^ _mixed(np.array([seed * 1_000_003 + epoch], np.uint64)))
    rows = np.flatnonzero(h % np.uint64(steps) == step)
    out = [0.0, 0.0, 0, 0, *(np.zeros(x.shape) for x in w)]
    for a in range(0, len(rows), BATCH):
        some = rows[a : a + BATCH]
        own = weight[block.y[some]]
        keep = _kept(h[some], len(w[1]), dropout) if dropout else None
        loss, p, grads = gradients(w, block.x.dense(some), block.y[some], own, keep)
        told = [own.sum(), loss * own.sum(), len(some), int((p.argmax(axis=1) == block.y[some]).sum()), *(g.astype(np.float64) * own.sum() for g in grads)]
        out = _added([out, told])
    return out


def _confused(block: Block, w: Weights, labels: int) -> list:
    """Of a block's rows: loss, and how often each label is told as each."""
    loss, counts = 0.0, np.zeros((labels, labels), np.int64)
    for a in range(0, len(block.x), BATCH):
        rows = np.arange(a, min(a + BATCH, len(block.x)))
        p, y = probabilities(w, block.x.dense(rows)), block.y[rows]
        loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum())
        np.add.at(counts, (y, p.argmax(axis=1)), 1)
    return [loss, counts]


def measured(blocks: Blocks, w: Weights, labels: int) -> tuple[float, float, float]:
    """Mean loss, accuracy and macro F1 over labels that are there or guessed."""
    loss, counts = blocks.total(lambda b, w: _confused(b, w, labels), w)
    n, hits, there = counts.sum(), np.diag(counts), counts.sum(axis=0) + counts.sum(axis=1)
    if not n:
        return 0.0, 0.0, 0.0
    return float(loss / n), float(hits.sum() / n), float((2 * hits[there > 0] / there[there > 0]).mean())


def scores(w: Weights, x: Sparse, y: np.ndarray, batch: int) -> tuple[float, float, float]:
    """The same of rows in this process."""
    return measured(Blocks([Block(x, y, np.zeros(len(x), np.uint64))]), w, len(w[3]))


def train(parts: dict[str, Blocks | tuple[Sparse, np.ndarray]], weight: np.ndarray, labels: int, hidden: int, dropout: float, batch: int, rate: float, decay: float, epochs: int, patience: int, seed: int) -> tuple[Weights, dict]:
    """The weights of the epoch of best validation macro F1, and what was told of each epoch. weight: of each label, in training only.

    An epoch has a step for each `batch` rows, STEPS at most. Every row is in one of its batches.
    """
    own, held = (p if isinstance(p, Blocks) else Blocks([Block(*p, _mixed(np.arange(len(p[1]), dtype=np.uint64)))]) for p in (parts["train"], parts["validation"]))
    # Each block has one for the number of columns, as all blocks have the same.
    n, columns, blocks = own.total(lambda b, w: [len(b.x), b.x.size, 1], [])
    w = initial(columns // blocks, labels, hidden, np.random.default_rng(seed))
    untrained = measured(held, w, labels)[1]
    adam, history = AdamW(w, rate, decay), []
    best, best_score, best_epoch, waited = [v.copy() for v in w], -1.0, 0, 0
    steps = max(1, min(STEPS, -(-n // batch)))
    for epoch in range(1, epochs + 1):
        losses, hits = 0.0, 0
        for step in range(steps):
            total, loss, rows, right, *grads = own.total(lambda b, w, epoch=epoch, step=step: _step(b, w, epoch, step, steps, seed, weight, dropout), w)
            if rows:
                adam.step([(g / total).astype(np.float32) for g in grads])
                losses, hits = losses + loss / total * rows, hits + right
        told = measured(held, w, labels)
        history.append({"epoch": epoch, "train_loss": float(losses / n), "train_accuracy": float(hits / n), "validation_loss": told[0], "validation_accuracy": told[1], "validation_macro_f1": told[2]})
        if told[2] > best_score + LEAST_GAIN:
            best, best_score, best_epoch, waited = [v.copy() for v in w], told[2], epoch, 0
        elif (waited := waited + 1) >= patience:
            break
    return best, {"history": history, "best_epoch": best_epoch, "untrained_validation_accuracy": untrained}


def packed(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, *w)
    return out.getvalue()


def unpacked(data: bytes) -> Weights:
    with np.load(io.BytesIO(data)) as f:
        return [f[f"arr_{i}"] for i in range(4)]


@dataclass
class Net:
    weights: bytes

    def probability(self, spark: SparkSession, index: Column, value: Column, size: int) -> Column:
        """The probabilities of all labels. The weights are as large as features times hidden units ask for."""
        sent = spark.sparkContext.broadcast(self.weights)

        @F.pandas_udf("array<double>")
        def score(index: pd.Series, value: pd.Series) -> pd.Series:
            w, x = unpacked(sent.value), Sparse(index, value, size)
            out = [probabilities(w, x.dense(np.arange(a, min(a + BATCH, len(x))))) for a in range(0, len(x), BATCH)]
            return pd.Series([p.astype(float).tolist() for part in out for p in part])

        return score(index, value)


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    x = Sparse.of_lists(batch["index"], batch["value"], size)
    block = Block(x, np.asarray(batch["y"], np.int64), np.asarray(batch["h"]).view(np.uint64))
    yield pa.record_batch([pa.array([pickle.dumps(block)], pa.binary())], ["block"])


def spread(rows: DataFrame, key: str, size: int, seed: int) -> Spread:
    """Rows (features: struct of index and value; y) as stored blocks on the executors."""
    spark = rows.sparkSession
    plain = rows.select("features.index", "features.value", F.col("y").cast("long").alias("y"), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                yield from _blocks(batch.slice(a, BLOCK), size)

    path = run_folder(spark, "blocks")
    plain.mapInArrow(run, "block binary").write.parquet(path)
    blocks = spark.read.schema("block binary").parquet(path).rdd.map(lambda r: pickle.loads(r.block))
    empty = Block(Sparse([], [], size), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Spread(blocks.union(spark.sparkContext.parallelize([empty], 1)).persist(StorageLevel.MEMORY_AND_DISK))


def fit(rows: DataFrame, key: str, size: int, weights: list[float], hidden: int = HIDDEN, dropout: float = DROPOUT, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, epochs: int = EPOCHS, patience: int = PATIENCE, seed: int = 42) -> tuple[Net, dict]:
    """Trains on all rows (split: train or validation; features: struct of index and value; y: number of the label).

    weights: of each label's training rows, in the order of their numbers.
    """
    if min(epochs, batch, patience, hidden) < 1 or not 0 <= dropout < 1:
        raise ValueError("epochs, batch, patience and hidden are positive, and dropout is below 1")
    parts = {name: spread(rows.where(F.col("split") == name), key, size, seed) for name in ("train", "validation")}
    try:
        w, told = train(parts, np.array(weights), len(weights), hidden, dropout, batch, rate, decay, epochs, patience, seed)
    finally:
        for p in parts.values():
            p.rdd.unpersist()
    return Net(packed(w)), told
