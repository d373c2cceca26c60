"""Best-fit packing of token pieces into sequences, with a swap-based local search.

Pieces of equal length are interchangeable, so the search runs on the histogram of lengths (at most `capacity`
numbers, whatever the input's size): a bin pattern is a multiset of lengths and stands for many equal bins. At first
each piece has a bin to itself. The search then moves pieces, or exchanges one for one or two for one, between underfull
bins so that the sum of squared fills grows, until bins are empty and no exchange is left. Best-fit decreasing is what
it is held against. Pieces then take the places of their length by rank.
"""

from __future__ import annotations

import bisect
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumflow.llm.common import Scratch, arrow_map
from vellumflow.llm.kernel import slices

CAPACITY = 2048
#: A run of white space of twice as many characters is never read by the fast reader.
BLANKS = 50_000
#: Pieces in a bucket in which ranks are dealt.
BUCKET = 10_000
# How byte-level vocabularies split text, and the one string they read as a token of its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary as ranks: ids are in merge order, so both give equal ids; the tests compare them."""
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model.items() if piece != END_OF_TEXT}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _mostly_blank(text: str) -> bool:
    """Whether some block of BLANKS characters is all white space, as it is in any run of twice as many."""
    return any(text[i : i + BLANKS].isspace() for i in range(0, len(text) - BLANKS + 1, BLANKS))


def token_ids(text: str, path: str) -> list[int]:
    """Ids of a text of any length. The fast reader goes back over a run of blanks once for each of them and breaks off at about a
    million, so texts with a long run go to the other one, which gives the same ids.
    """
    if END_OF_TEXT in text or _mostly_blank(text):
        return _slow(path).encode(text, add_special_tokens=False).ids
    return _fast(path).encode_ordinary(text)


def _pieces(batch: pa.RecordBatch, path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        rows: list[tuple] = []
        for i, text in enumerate(part["text"].to_pylist()):
            ids = np.array([*token_ids(text or "", path), 0], "<u4")
            cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                rows.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if keep_ids else None))
        doc, piece, start, length, crc, ids = zip(*rows, strict=True)
        yield pa.record_batch(
            [part["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
            ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
        )


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces of every row: ids by the byte-level vocabulary at path, then id 0.

    Longer documents are cut into full pieces; the first piece takes what is left over. Null text is empty, one id. Texts may
    be of any length, long runs of blanks included.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = arrow_map(rows, lambda b: _pieces(b, path, capacity, keep_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>")
    return out if keep_ids else out.drop("ids")


Pattern = tuple[int, ...]


def best_fit(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing on counted lengths. Patterns (lengths, descending) and how many bins have each."""
    done: Counter[Pattern] = Counter()
    open_bins: dict[int, Counter[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, room: int, n: int) -> None:
        if not room:
            done[pattern] += n
            return
        if room not in open_bins:
            open_bins[room] = Counter()
            bisect.insort(rooms, room)
        open_bins[room][pattern] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(left, capacity // length)
                n = left // each
                put((length,) * each, capacity - each * length, n)
                left -= n * each
                continue
            room = rooms[at]
            pattern, bins = next(iter(open_bins[room].items()))
            each = min(left, room // length)
            n = min(bins, left // each)
            open_bins[room][pattern] -= n
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            put(pattern + (length,) * each, room - each * length, n)
            left -= n * each
    for bins in open_bins.values():
        done.update(bins)
    return done


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each t, what is longer than capacity - t shares its bin with nothing of length t or more,
    what is longer than half has a bin of its own, and the rest, from t on, has the room that these leave."""
    total = sum(x * n for x, n in histogram.items())
    best = -(-total // capacity)
    count, size = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for x, n in histogram.items():
        count[x], size[x] = n, x * n
    above, weight = np.cumsum(count[::-1])[::-1], np.cumsum(size[::-1])[::-1]
    half = capacity // 2
    for t in range(1, half + 1):
        alone, large = above[capacity - t + 1], above[half + 1] - above[capacity - t + 1]
        room = large * capacity - (weight[half + 1] - weight[capacity - t + 1])
        rest = weight[t] - weight[half + 1]
        best = max(best, int(alone + large + max(0, -(-(rest - room) // capacity))))
    return best


def _pairs(pattern: Pattern) -> set[Pattern]:
    counts = Counter(pattern)
    lengths = sorted(counts)
    return {(x, y) for i, x in enumerate(lengths) for y in lengths[i:] if x != y or counts[x] > 1}


def _transfer(fuller: Pattern, other: Pattern, room: int) -> tuple[Pattern, Pattern] | None:
    """The exchange that brings most, at most `room`, from other into fuller: a move, one for one, or two for one."""
    best, choice = 0, None
    ins = sorted({(y,) for y in other} | _pairs(other))
    outs = sorted((sum(o), o) for o in {()} | {(x,) for x in fuller} | _pairs(fuller))
    sizes = [s for s, _ in outs]
    for i in ins:
        size = sum(i)
        for s, o in outs[bisect.bisect_left(sizes, size - room) :]:
            if size - s <= best:
                break
            if len(i) == 2 and len(o) == 2:
                continue
            best, choice = size - s, (i, o)
            break
        if best == room:
            break
    if not choice:
        return None
    i, o = choice
    a, b = Counter(fuller), Counter(other)
    a.subtract(o), a.update(i), b.subtract(i), b.update(o)
    return tuple(sorted(a.elements(), reverse=True)), tuple(sorted(b.elements(), reverse=True))


class _Search:
    """Bins by pattern, and what exchanges look up: lengths that have a bin to themselves, and other underfull patterns by fill."""

    def __init__(self, bins: Counter[Pattern], capacity: int):
        self.capacity, self.bins = capacity, Counter()
        self.alone: list[int] = []
        self.others: list[tuple[int, Pattern]] = []
        self.made: dict[Pattern, int] = {}
        self.turn = 0
        self.total = sum(bins.values())
        for p, n in bins.items():
            self.add(p, n)

    def add(self, p: Pattern, n: int) -> None:
        if not p:
            self.total -= n
        elif n:
            if not self.bins[p] and sum(p) < self.capacity:
                bisect.insort(*((self.alone, p[0]) if len(p) == 1 else (self.others, (sum(p), p))))
                self.made[p] = self.turn
            self.bins[p] += n

    def take(self, p: Pattern, n: int) -> None:
        self.bins[p] -= n
        if not self.bins[p]:
            del self.bins[p]
            if sum(p) < self.capacity:
                index, key = (self.alone, p[0]) if len(p) == 1 else (self.others, (sum(p), p))
                index.pop(bisect.bisect_left(index, key))

    def with_alone(self, fuller: Pattern) -> tuple[Pattern, Pattern, Pattern] | None:
        """The move or exchange of one for one with a piece that has its bin to itself which brings most into fuller."""
        fill = sum(fuller)
        best, choice = 0, None
        for x in (0, *sorted(set(fuller))):
            at = bisect.bisect_right(self.alone, min(self.capacity - fill + x, fill)) - 1
            if at >= 0 and (self.alone[at],) == fuller and self.bins[fuller] < 2:
                at -= 1
            if at >= 0 and self.alone[at] - x > best:
                best, choice = self.alone[at] - x, (x, self.alone[at])
        if not choice:
            return None
        x, y = choice
        filled = Counter(fuller)
        filled[y] += 1
        if x:
            filled[x] -= 1
        return (y,), tuple(sorted(filled.elements(), reverse=True)), (x,) if x else ()

    def with_others(self, fuller: Pattern, since: int) -> tuple[Pattern, Pattern, Pattern] | None:
        """An exchange with the emptiest other bin that has one, made at the turn `since` or later."""
        fill = sum(fuller)
        for size, other in self.others:
            if size > fill:
                break
            if self.made[other] >= since and (other != fuller or self.bins[other] > 1):
                if changed := _transfer(fuller, other, self.capacity - fill):
                    return other, *changed
        return None

    def run(self, least: int) -> None:
        met: dict[Pattern, int] = {}
        while self.total > least:
            before = self.turn
            waiting = [(-sum(p), p) for p in self.bins if sum(p) < self.capacity]
            heapq.heapify(waiting)
            while waiting and self.total > least:
                _, fuller = heapq.heappop(waiting)
                if fuller not in self.bins:
                    continue
                found = self.with_alone(fuller) or self.with_others(fuller, met.get(fuller, -1))
                if not found:
                    met[fuller] = self.turn
                    continue
                other, filled, left = found
                n = self.bins[fuller] // 2 if other == fuller else min(self.bins[fuller], self.bins[other])
                self.turn += 1
                for p in (fuller, other):
                    self.take(p, n)
                for p in (filled, left):
                    self.add(p, n)
                for p in {fuller, filled, left}:
                    if p in self.bins and sum(p) < self.capacity:
                        heapq.heappush(waiting, (-sum(p), p))
            if self.turn == before:
                break


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Fills the fuller of the underfull bins from the emptier ones until no exchange is left; equal bins exchange all at once.

    Each step moves some length from a bin to one that is at least as full, so the sum of squared fills grows and the
    search ends: when a whole round finds no exchange between any two underfull bins, or with as few bins as any packing
    needs. Bins of several pieces between which none was found are compared again only when one of them is new. The
    result never has more bins than before.
    """
    histogram: Counter[int] = Counter()
    for p, n in bins.items():
        for x in p:
            histogram[x] += n
    search = _Search(Counter({p: n for p, n in bins.items() if n}), capacity)
    search.run(lower_bound(histogram, capacity))
    return search.bins


def packed_bins(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """The patterns that the search makes when each piece has a bin to itself at first, or best-fit decreasing where that has fewer bins."""
    found = local_search(Counter({(x,): n for x, n in histogram.items()}), capacity)
    return min(found, best_fit(histogram, capacity), key=lambda bins: sum(bins.values()))


def _places(bins: Counter[Pattern]) -> tuple[np.ndarray, ...]:
    """For each length and range of ranks: first rank, first sequence, places of the length in a bin, offset of the first."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in Counter(pattern).items():
            rows.append((length, used[length], sequence, each, offset))
            used[length] += each * n
            offset += each * length
        sequence += n
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))


def _place(batch: pa.RecordBatch, table: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    lengths, first, sequence, each, offset = table
    length, rank = (np.asarray(batch[c]) for c in ("length", "rank"))
    key = lambda a, b: (a.astype(np.uint64) << np.uint64(48)) + b.astype(np.uint64)
    at = np.searchsorted(key(lengths, first), key(length, rank), "right") - 1
    within = rank - first[at]
    named = [batch[c] for c in batch.schema.names if c != "rank"]
    yield pa.RecordBatch.from_arrays(
        [*named, pa.array(sequence[at] + within // each[at]), pa.array(offset[at] + within % each[at] * length)],
        [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"],
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ...; cheap to read again) with sequence_id and offset.

    Lengths lie in 1..capacity. Equal rows are packed each for itself. An empty table gives an empty table.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = _places(packed_bins(histogram, capacity))
    buckets = -(-sum(histogram.values()) // BUCKET)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    before = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("rank", (F.col("rank") + F.col("_before")).cast("long"))
    ranked = ranked.select(*(c for c in pieces.columns if c != "_bucket"), "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return arrow_map(ranked, lambda b: _place(b, table), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cuts and packs: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null or empty texts give one piece of one id. Null and repeated ids are allowed. Other columns are ignored.
    """
    pieces = Scratch(docs.sparkSession).store(cut(docs, path, capacity, id_col, text_col, keep_ids), "pieces")
    return pack(pieces, capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
