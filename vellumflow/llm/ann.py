"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector v = r * u (u a unit vector) is padded with zeros to D = WIDTH * dim components and rotated by a fixed random
orthogonal matrix; the signs of the rotated u, packed into 64-bit words, are its code, x = signs / sqrt(D), and
f = <x, Pu> its correction scalar. <x, Pq> / f estimates <q, u> without bias, and its error stays under BOUND * sqrt((1 - f^2) / f^2
/ (D - 1)) but with small probability. The rotated query is rounded to PLANES bits a component, so that <x, Pq> is a sum of bit
counts of words; e, what rounding takes off, is an error of |e| / f / sqrt(D - 1) more. One bit for each component of short
vectors (WIDTH 1) would bound nothing: 63 % of all candidates of 64 components would be reranked, 13 % are with four.

Vectors are encoded where they are read, into blocks. The queries go round in groups of checked size, in two scans
over the blocks. The first reads codes and scalars only and finds for each query the k-th largest lower bound over all
blocks. The second takes the vectors whose upper bound reaches it and reranks them exactly. No vector is shuffled: what
leaves a task is k numbers or k rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.common import BROADCAST_BYTES, Scratch, arrow_map, give_back

BLOCK = 8192
BLOCK_BYTES = 8 << 20
#: Bytes of queries that go round at once; hashing deals groups a little larger than this.
GROUP_BYTES = BROADCAST_BYTES // 2
TILE = 8
WIDTH = 4
PLANES = 5
BOUND = 3.0
SEED = 5
BLOCKS = "dim int, n long, n_queries long, rows binary, ids binary, codes binary, norms binary, f binary, vectors binary"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The columns of the rotation that vectors of dim components and zeros meet."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((WIDTH * dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    words = -(-bits.shape[1] // 64)
    out = np.zeros((len(bits), words * 8), np.uint8)
    some = np.packbits(bits, axis=1)
    out[:, : some.shape[1]] = some
    return out.view(np.uint64)


def lengths(vectors: np.ndarray) -> np.ndarray:
    peak = np.abs(vectors).max(axis=1)
    return peak * np.linalg.norm(vectors / peak[:, None], axis=1)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths and correction scalars."""
    norms = lengths(vectors)
    turned = (vectors / norms[:, None]) @ rotation(vectors.shape[1]).T
    return packed(turned > 0), norms, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


class Block:
    """The codes of one stored block, and what estimates take from its scalars."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        codes = np.frombuffer(row["codes"], np.uint64).reshape(len(self.rows), -1)
        self.words = np.ascontiguousarray(codes.T)
        self.ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
        norms, f = np.frombuffer(row["norms"]), np.frombuffer(row["f"])
        size = WIDTH * self.dim
        self.scale = norms / f / np.sqrt(size)
        # Squared, for queries of length 1 and for a rounding error of length 1.
        self.rounding = (norms * BOUND / f) ** 2 / max(size - 1, 1)
        self.spread = self.rounding * np.maximum(1 - f * f, 0)
        self.vectors = np.frombuffer(row["vectors"]).reshape(-1, self.dim) if "vectors" in row else None


class Queries:
    """A group of queries of one length: rounded to bit planes, with what rounding takes off."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray):
        self.rows, self.vectors = rows, vectors
        turned = vectors @ rotation(vectors.shape[1]).T
        low = turned.min(axis=1, keepdims=True)
        step = (turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1)
        level = np.rint((turned - low) / np.where(step > 0, step, 1)).astype(np.uint8)
        self.low, self.step = low[:, 0], step[:, 0]
        # planes: (plane, query, word)
        self.planes = np.stack([packed((level >> j) & 1 == 1) for j in range(PLANES)])
        self.total = (low + step * level).sum(axis=1)
        self.lost = np.linalg.norm(turned - low - step * level, axis=1)
        self.norms = lengths(vectors)

    def bounds(self, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Lower and upper bounds of the inner products, TILE queries at a time (in buffers that the next ones overwrite).

        A query's own row has minus infinity.
        """
        own = np.searchsorted(block.rows, self.rows)
        found = block.rows[np.minimum(own, len(block.rows) - 1)] == self.rows
        wide = np.uint16 if WIDTH * block.dim << PLANES < 1 << 16 else np.uint32
        shape = (TILE, len(block.rows))
        met, ones = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
        counts, estimate, error, more = np.empty(shape, wide), np.empty(shape), np.empty(shape), np.empty(shape)
        for a in range(0, len(self.rows), TILE):
            part = slice(a, a + TILE)
            n = len(self.rows[part])
            m, o, c, e, r, x = (y[:n] for y in (met, ones, counts, estimate, error, more))
            c[:] = 0
            for j in reversed(range(PLANES)):
                c <<= wide(1)
                for w, words in enumerate(block.words):
                    np.bitwise_and(words, self.planes[j, part, w][:, None], out=m)
                    np.bitwise_count(m, out=o)
                    c += o
            # (2 * (low * ones + step * counts) - total) * scale, and the two parts of the error
            np.multiply(c, (2 * self.step[part])[:, None], out=e)
            np.multiply((2 * self.low[part])[:, None], block.ones, out=x)
            e += x
            e -= self.total[part][:, None]
            e *= block.scale
            np.multiply(self.norms[part][:, None] ** 2, block.spread, out=r)
            np.multiply(self.lost[part][:, None] ** 2, block.rounding, out=x)
            r += x
            np.sqrt(r, out=r)
            low, high = np.subtract(e, r, out=x), np.add(e, r, out=e)
            mine = np.flatnonzero(found[part])
            low[mine, own[part][mine]] = high[mine, own[part][mine]] = -np.inf
            yield a, low, high


def _blocks(batch: pa.RecordBatch, every: int) -> Iterator[pa.RecordBatch]:
    dims = np.asarray(batch["dim"])
    values, offsets = np.asarray(batch["v"].flatten()), np.concatenate([[0], np.cumsum(dims)])
    rows, ids = np.asarray(batch["row"]), np.asarray(batch["vec_id"])
    out = []
    for dim in np.unique(dims):
        every_row = np.flatnonzero(dims == dim)
        size = max(1, min(BLOCK, BLOCK_BYTES // (8 * int(dim))))
        for a in range(0, len(every_row), size):
            some = every_row[a : a + size]
            vectors = values[offsets[some][:, None] + np.arange(dim)]
            codes, norms, f = encode(vectors)
            asked = int((ids[some] % every == 0).sum())
            out.append((int(dim), len(some), asked, *(x.tobytes() for x in (rows[some], ids[some], codes, norms, f, vectors))))
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("n_queries", pa.int64()), *((c, pa.binary()) for c in ("rows", "ids", "codes", "norms", "f", "vectors"))])
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _asked(batch: pa.RecordBatch, every: int) -> Iterator[pa.RecordBatch]:
    for row in batch.to_pylist():
        ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        some = np.flatnonzero(ids % every == 0)
        if len(some):
            vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])[some]
            raw = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["dim"], np.int32)), pa.array(rows[some]), pa.array(ids[some]), raw], ["dim", "row", "query_id", "vector"])


def _scan(blocks: DataFrame, visit, finish, schema: str) -> DataFrame:
    """finish(state) after visit(state, block) on each block of a partition; state starts as an empty dict."""

    def run(batches):
        state: dict = {}
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    visit(state, Block(batch.slice(i, 1).to_pylist()[0]))
            batch = None
            yield from finish(state)
        finally:
            give_back()

    return blocks.mapInArrow(run, schema)


def _raised(best: np.ndarray, low: np.ndarray, k: int) -> None:
    """Takes new values into each row's k largest (ascending, in place)."""
    for i in np.flatnonzero((low > best[:, :1]).any(axis=1)):
        better = low[i][low[i] > best[i, 0]]
        if len(better) > k:
            better = np.partition(better, len(better) - k)[-k:]
        best[i] = np.sort(np.concatenate([best[i], better]))[-k:]


def lower_bounds(blocks: DataFrame, sent, k: int) -> DataFrame:
    """For each query of the group (a broadcast rows, vectors) the k-th largest lower bound, if there are k candidates."""

    def visit(state: dict, block: Block) -> None:
        if not state:
            state["queries"] = Queries(*sent.value)
            state["best"] = np.full((len(state["queries"].rows), k), -np.inf)
        for a, low, _ in state["queries"].bounds(block):
            _raised(state["best"][a : a + TILE], low, k)

    def finish(state: dict) -> Iterator[pa.RecordBatch]:
        if state:
            best = state["best"]
            offsets = pa.array(np.arange(0, best.size + 1, k).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(state["queries"].rows), pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))], ["row", "best"])

    found = _scan(blocks, visit, finish, "row long, best array<double>")
    every = F.sort_array(F.flatten(F.collect_list("best")), asc=False)
    return found.groupBy("row").agg(F.get(every, F.lit(k - 1)).alias("least"))


def reranked(blocks: DataFrame, sent, k: int) -> DataFrame:
    """The best k of each partition's blocks for each query of the group (a broadcast rows, vectors, least bounds), by exact products."""

    def visit(state: dict, block: Block) -> None:
        if not state:
            rows, vectors, least = sent.value
            state.update(queries=Queries(rows, vectors), least=least.copy(), kept=[(np.zeros(0), np.zeros(0, np.int64))] * len(rows))
        queries, least, kept = state["queries"], state["least"], state["kept"]
        for a, _, high in queries.bounds(block):
            for i in range(len(high)):
                chosen = np.flatnonzero((high[i] >= least[a + i]) & (high[i] > -np.inf))
                if not len(chosen):
                    continue
                scores = np.concatenate([kept[a + i][0], np.einsum("ij,j->i", block.vectors[chosen], queries.vectors[a + i])])
                ids = np.concatenate([kept[a + i][1], block.ids[chosen]])
                best = np.lexsort((ids, -scores))[:k]
                kept[a + i] = scores[best], ids[best]
                if len(best) == k:
                    least[a + i] = max(least[a + i], scores[best[-1]])

    def finish(state: dict) -> Iterator[pa.RecordBatch]:
        if state:
            sizes = [len(s) for s, _ in state["kept"]]
            scores, ids = (np.concatenate([x[i] for x in state["kept"]]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(state["queries"].rows, sizes)), pa.array(ids), pa.array(scores)], ["row", "vec_id", "score"])

    return _scan(blocks, visit, finish, "row long, vec_id long, score double")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles): rows with an id and a vector of finite components that isn't zero."""
    v = F.col(vector_col).cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product with each query, a query being a row whose id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score: the exact inner product in double precision; equal scores go by
    smaller vec_id. A query's own row is left out of its result; other rows are candidates, also those of its id.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without id, take no part.
    Vectors of different lengths are only compared with those of their own. Rows of one id are rows of their own: each
    that is a query has its own ranks, and each is found by others. An empty table gives an empty table. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = usable(vectors, id_col, vector_col).select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))
    blocks = scratch.store(arrow_map(rows, lambda b: _blocks(b, every), BLOCKS), "blocks")
    queries = scratch.store(arrow_map(blocks.where("n_queries > 0").select("dim", "rows", "ids", "vectors"), lambda b: _asked(b, every), "dim int, row long, query_id long, vector binary"), "queries")
    # A row for each length of vectors.
    sizes = queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    turn = 0
    for dim, n in sizes:
        groups = -(-n * dim * 8 // GROUP_BYTES)
        own = blocks.where(F.col("dim") == dim)
        for group in range(groups):
            # About GROUP_BYTES of queries, whatever their number.
            some = queries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("row"), F.lit(groups)) == group)).select("row", "vector").toArrow()
            if not some.num_rows:
                continue
            row = some["row"].to_numpy()
            vector = np.frombuffer(b"".join(some["vector"].to_pylist())).reshape(-1, dim)
            sent = spark.sparkContext.broadcast((row, vector))
            bounds = lower_bounds(own.drop("vectors"), sent, k).toArrow()
            least = np.full(len(row), -np.inf)
            order = np.argsort(row)
            least[order[np.searchsorted(row[order], bounds["row"].to_numpy())]] = bounds["least"].to_numpy()
            with_least = spark.sparkContext.broadcast((row, vector, least))
            scratch.store(reranked(own, with_least, k), f"found/{turn}")
            sent.destroy()
            with_least.destroy()
            turn += 1
    schema = "row long, vec_id long, score double"
    found = spark.read.schema(schema).parquet(f"{scratch.path}/found/*") if turn else spark.createDataFrame([], schema)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k)
    ranked = found.groupBy("row").agg(best.alias("best")).join(queries.select("row", "query_id"), "row")
    return ranked.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
