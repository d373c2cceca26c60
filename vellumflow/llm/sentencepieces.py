"""SentencePiece encoding and decoding in batched numpy.

Texts are cut into words (a run of word marks and what follows up to the next mark; no piece crosses that border).
The distinct words of a slice advance together by length: hashes of all their substrings probe the sorted
piece keys, which gives a table of piece numbers by start and length. A Viterbi pass then goes position by position, with
vectorised maxima that store backpointers. Unigram models take the segmentation of the greatest sum of scores.

BPE models merge the best-scoring adjacent pair again and again, which is no greatest sum. Yet what merging gives for a
prefix never changes when the prefix grows by a whole piece, and a segmentation is that of the merges exactly if each two
neighbouring pieces, merged by themselves, stay as they are. So the same pass holds for BPE: the score of a step is 0 if
the piece stands beside the last piece of the prefix before it, else minus infinity, and one step has score 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.common import arrow_map
from vellumflow.llm.kernel import mix, slices

MARK = 0x2581
#: Words longer than this are first cut where no piece has the two characters side by side.
LONG = 48
RUN_BITS = 18
#: Answers on pairs of pieces that a process keeps, by the first bits of the mixed pair.
PAIR_BITS = 18
#: Order of a piece that no merge makes.
WHOLE = -1
CACHED = 1 << 19
# Field numbers and codes of the model file.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
_BASE = 0xA24BAED4963EE407 | 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each entry of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield key >> 3, data[i : i + size]
            i += size


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Cache:
    """Ids of words met before, by word key, up to CACHED words of this process."""

    def __init__(self):
        self.keys, self.first, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, first: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHED:
            return
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged)
        self.keys = merged[order]
        self.first = np.concatenate([self.first, first + len(self.flat)])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.flat = np.concatenate([self.flat, flat])


class Model:
    """The pieces of a model file: texts, scores, kinds, and sorted keys of those that can match."""

    def __init__(self, data: bytes, algorithm: int | None = None):
        self.texts, scores, kinds = [], [], []
        self.algorithm, self.byte_fallback = UNIGRAM, False
        self.prefix, self.squeeze, charsmap = True, True, b""
        for field, value in _fields(data):
            if field == PIECE:
                entry = dict(_fields(value))
                self.texts.append(entry[1].decode())
                scores.append(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(entry.get(3, NORMAL))
            elif field == TRAINER:
                entry = dict(_fields(value))
                self.algorithm, self.byte_fallback = entry.get(3, UNIGRAM), bool(entry.get(35, 0))
            elif field == NORMALIZER:
                entry = dict(_fields(value))
                charsmap, self.prefix, self.squeeze = entry.get(2, b""), bool(entry.get(3, 1)), bool(entry.get(4, 1))
        self.algorithm = algorithm or self.algorithm
        if charsmap or self.squeeze or USER in kinds or UNUSED in kinds or not self.byte_fallback:
            raise ValueError("only models that keep the text as it is and fall back to bytes can be read")
        self.scores, self.kinds = np.array(scores, np.float64), np.array(kinds)
        normal = np.flatnonzero(self.kinds == NORMAL)
        if any(chr(MARK) in self.texts[i].lstrip(chr(MARK)) for i in normal):
            raise ValueError("a piece has a word mark inside")
        points = [np.array([ord(c) for c in self.texts[i]], np.uint64) for i in normal]
        self.longest = max(map(len, points))
        up, _ = _powers(self.longest + 1)
        keys = np.array([np.sum(mix(p + np.uint64(1)) * up[: len(p)], dtype=np.uint64) for p in points], np.uint64)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], normal[order].astype(np.int32)
        # Sorted keys by their first bits: where each run of equal first bits begins.
        self.runs = np.searchsorted(self.keys >> np.uint64(64 - RUN_BITS), np.arange((1 << RUN_BITS) + 1).astype(np.uint64)).astype(np.int32)
        self.longest_run = int(np.diff(self.runs).max())
        self.joined = np.unique(np.concatenate([(p[:-1] << np.uint64(32)) | p[1:] for p in points]))
        self.cache = Cache()
        self.unknown = self.scores[normal].min() - UNKNOWN_PENALTY
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.texts[i][3:5], 16)] = i
        bytes_of = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else t.encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.ends = np.cumsum([len(b) for b in bytes_of])
        self.sizes = np.array([len(b) for b in bytes_of])
        if self.algorithm == BPE:
            self._learn_merges(normal, points)

    def _learn_merges(self, normal: np.ndarray, points: list[np.ndarray]) -> None:
        """The order of each piece among the merges, and the two pieces that its last merge joins.

        Parts have to be of no later order than what they make, as trained models have it. A character that is no piece
        is the piece number len(texts), which nothing joins.
        """
        n = len(self.texts) + 1
        lengths = np.zeros(n, np.int64)
        lengths[normal] = [len(p) for p in points]
        lengths[-1] = 1
        made = normal[lengths[normal] > 1]
        self.order = np.full(n, WHOLE)
        self.order[made] = np.unique(-self.scores[made], return_inverse=True)[1]
        self.left, self.right = np.arange(n), np.arange(n)
        self.reached = np.zeros(n, bool)
        self.reached[normal[lengths[normal] == 1]] = self.reached[-1] = True
        up, _ = _powers(self.longest + 1)
        self.shift = up[lengths]
        self.hashed = np.zeros(n, np.uint64)
        self.hashed[self.numbers] = self.keys
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        by_number = dict(zip(normal.tolist(), points, strict=True))
        for length in range(2, self.longest + 1):
            own = made[lengths[made] == length]
            if not len(own):
                continue
            table = self.table(np.stack([by_number[i] for i in own.tolist()]))
            for cut in range(1, length):
                a, b = table[:, 0, cut - 1], table[:, cut, length - cut - 1]
                some = np.flatnonzero((a >= 0) & (b >= 0))
                a, b, whole = a[some], b[some], own[some]
                fits = self.reached[a] & self.reached[b] & (np.maximum(self.order[a], self.order[b]) <= self.order[whole])
                a, b, whole = a[fits], b[fits], whole[fits]
                stays = self._stay(a, b, self.order[whole])
                self.left[whole[stays]], self.right[whole[stays]] = a[stays], b[stays]
                self.reached[whole[stays]] = True

    def _stay(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether pieces a and b side by side stay as they are by merges of an order below limit.

        The merges within both are undone from the last on. If what then meets at the border makes a piece of a lower order than the
        merge undone, merging would have joined it instead. Of equal merges the left one comes first: undone last.
        """
        ok = np.ones(len(a), bool)
        at, a, b, limit = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), limit.copy()
        while len(at):
            met = self.probe(self.hashed[a] + self.shift[a] * self.hashed[b])
            met = np.where((a < len(self.texts)) & (b < len(self.texts)), met, -1)
            joins = (met >= 0) & (self.order[met] < limit)
            ok[at[joins]] = False
            going = ~joins & ((self.order[a] > WHOLE) | (self.order[b] > WHOLE))
            at, a, b = at[going], a[going], b[going]
            first = self.order[a] > self.order[b]
            limit = np.where(first, self.order[a], self.order[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stay without limit, with the answers to pairs met before."""
        pair = a.astype(np.int64) * (len(self.texts) + 1) + b
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_keys[slot] != pair)
        if len(new):
            out[new] = self._stay(a[new], b[new], np.full(len(new), len(self.order)))
            self.pair_keys[slot[new]], self.pair_ok[slot[new]] = pair[new], out[new]
        return out

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The piece number of each key, or -1."""
        at = self.runs[(keys >> np.uint64(64 - RUN_BITS)).astype(np.int64)]
        out = np.full(keys.shape, -1, np.int32)
        for i in range(self.longest_run):
            here = np.minimum(at + i, len(self.keys) - 1)
            np.copyto(out, self.numbers[here], where=self.keys[here] == keys)
        return out

    def table(self, points: np.ndarray) -> np.ndarray:
        """Piece numbers by word, start and length - 1, for words (rows of code points) of one length."""
        n, size = points.shape
        up, down = _powers(size + 1)
        total = np.zeros((n, size + 1), np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:size], axis=1, out=total[:, 1:])
        out = np.full((n, size, min(size, self.longest)), -1, np.int32)
        for length in range(1, out.shape[2] + 1):
            out[:, : size - length + 1, length - 1] = self.probe((total[:, length:] - total[:, : size - length + 1]) * down[: size - length + 1])
        return out

    def viterbi(self, pieces: np.ndarray) -> np.ndarray:
        """Segment ends (a mask by word and position) of the best-scoring segmentation; of equals the one with the longest last piece."""
        n, size, longest = pieces.shape
        score = np.append(self.scores, -np.inf)[pieces]
        score[:, :, 0] = np.where(pieces[:, :, 0] < 0, self.unknown, score[:, :, 0])
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            lengths = np.arange(min(end, longest), 0, -1)
            options = np.stack([best[:, end - x] + score[:, end - x, x - 1] for x in lengths], axis=1)
            choice = options.argmax(axis=1)
            best[:, end] = options[np.arange(n), choice]
            back[:, end] = lengths[choice]
        return _ends(back)

    def viterbi_merges(self, pieces: np.ndarray) -> np.ndarray:
        """Segment ends of what merging gives: at each end, the piece that can stand beside the last one before it."""
        n, size, longest = pieces.shape
        none = len(self.texts)
        last = np.full((n, size + 1), none)
        back = np.ones((n, size + 1), np.int64)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, longest) + 1)
            options = pieces[:, end - lengths, lengths - 1]
            options[:, 0] = np.where(options[:, 0] < 0, none, options[:, 0])
            word, which = np.nonzero((options >= 0) & self.reached[options])
            piece = options[word, which]
            before = last[word, end - lengths[which]]
            fits = np.zeros(options.shape, bool)
            fits[word, which] = self.beside(before, piece)
            choice = fits.argmax(axis=1)
            last[:, end] = options[np.arange(n), choice]
            back[:, end] = lengths[choice]
        return _ends(back)


def _ends(back: np.ndarray) -> np.ndarray:
    """The mask of segment ends that the backpointers (lengths of last pieces) lead to."""
    n, size = back.shape[0], back.shape[1] - 1
    ends = np.zeros((n, size + 1), bool)
    at = np.full(n, size)
    while at.any():
        some = np.flatnonzero(at)
        ends[some, at[some]] = True
        at[some] -= back[some, at[some]]
    return ends[:, 1:]


@lru_cache(maxsize=4)
def load(path: str, algorithm: int | None = None) -> Model:
    """algorithm: reads the pieces as those of a model of another kind."""
    with open(path, "rb") as f:
        return Model(f.read(), algorithm)


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + counts[0] - 1, first[1] .., joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(first, counts)


def encode_batch(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, joined, and how many each text has."""
    mark = chr(MARK) if model.prefix else ""
    marked = [mark + t if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == 32] = MARK
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
    is_mark = points == MARK
    cut = np.zeros(len(points), bool)
    cut[1:] = is_mark[1:] & ~is_mark[:-1]
    cut[offsets[:-1][offsets[:-1] < len(points)]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(points)))
    if model.algorithm == BPE and (long := np.flatnonzero(size > LONG)).size:
        inside = _ragged(start[long] + 1, size[long] - 1)
        pair = (points[inside - 1].astype(np.uint64) << np.uint64(32)) | points[inside]
        at = np.minimum(np.searchsorted(model.joined, pair), len(model.joined) - 1)
        cut[inside[model.joined[at] != pair]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(points)))
    up, down = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    key = mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))
    distinct, one, word = np.unique(key, return_index=True, return_inverse=True)
    known = model.cache.find(distinct)
    cached_places = model.cache.first[known[known >= 0]], model.cache.counts[known[known >= 0]]
    n_ids, parts, places = np.zeros(len(one), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    lengths = np.where(known < 0, size[one], 0)
    for length in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == length)
        step = max(1, 400_000 // int(length * min(length, model.longest)))
        for a in range(0, len(own), step):
            some = own[a : a + step]
            rows = points[start[one[some]][:, None] + np.arange(length)]
            pieces = model.table(rows)
            ends = model.viterbi(pieces) if model.algorithm == UNIGRAM else model.viterbi_merges(pieces)
            w, e = np.nonzero(ends)
            s = np.zeros_like(e)
            s[1:] = np.where(w[1:] == w[:-1], e[:-1] + 1, 0)
            ids = pieces[w, s, e - s]
            counts = np.ones(len(ids), np.int64)
            unknown = np.flatnonzero(ids < 0)
            if len(unknown):
                raw = [chr(c).encode("utf-8", "replace") for c in rows[w[unknown], s[unknown]]]
                counts[unknown] = [len(b) for b in raw]
                spread = np.repeat(ids, counts)
                spread[_ragged((np.cumsum(counts) - counts)[unknown], counts[unknown])] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
                ids = spread
            n_ids[some] = np.bincount(w, counts, minlength=len(some)).astype(np.int64)
            parts.append(ids)
            places.append(some)
    flat, at = np.concatenate(parts), np.concatenate(places)
    cached, old = model.cache, known >= 0
    first = np.zeros(len(one), np.int64)
    first[at] = np.cumsum(n_ids[at]) - n_ids[at]
    every = np.concatenate([flat, cached.flat])
    cached.add(distinct[at], first[at], n_ids[at], flat)
    first[old], n_ids[old] = cached_places[0] + len(flat), cached_places[1]
    counts = n_ids[word]
    ids = every[_ragged(first[word], counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(ends[np.searchsorted(start, offsets)])


def decode_batch(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each run of ids."""
    sizes = model.sizes[ids]
    data = model.bytes[_ragged((model.ends - model.sizes)[ids], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        text = data[a:b].decode("utf-8", "replace").replace(chr(MARK), " ")
        out.append(text[1:] if model.prefix and text.startswith(" ") else text)
    return out


def _encode(batch: pa.RecordBatch, path: str, algorithm: int | None) -> Iterator[pa.RecordBatch]:
    model = load(path, algorithm)
    for part in slices(batch, "text", 4 << 20):
        texts = [t or "" for t in part["text"].to_pylist()]
        ids, counts = encode_batch(model, texts)
        decoded = decode_batch(model, ids, counts)
        # The mark itself reads as a space, here as in every decoder of these models.
        same = [d == t.replace(chr(MARK), " ") for d, t in zip(decoded, texts, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
        raw, ends = ids.astype("<u4"), np.cumsum(counts)
        crc = [zlib.crc32(raw[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part["doc_id"], lists, pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])


def encode(docs: DataFrame, path: str | None = None, algorithm: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Ids of every row, by the model's own rule, or by the given one (UNIGRAM: greatest sum; BPE: merge order).

    Returns a row for each row of docs: doc_id, ids, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip
    (does decoding give the text back). with_ids=False leaves the lists out.

    Null and empty texts have no ids. Rows are read one by one. Other columns are ignored.
    """
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = arrow_map(rows, lambda b: _encode(b, path, algorithm), f"doc_id {kind}, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")
    return out if with_ids else out.drop("ids")


def _decode(batch: pa.RecordBatch, path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    ids = batch["ids"]
    counts = np.array([len(x) if x is not None else 0 for x in ids.to_pylist()], np.int64)
    yield pa.record_batch([batch["doc_id"], pa.array(decode_batch(model, np.asarray(ids.flatten()).astype(np.int64), counts), pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null or empty ids give the empty text."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return arrow_map(rows, lambda b: _decode(b, path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
