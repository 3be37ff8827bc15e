"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves pre-tokens that are in the
vocabulary as a whole, for all distinct pre-tokens of a run of texts at once; a
miss is merged from its bytes with a heap of pairs over a linked list, in
O(n log n) for n bytes. Decoding gathers token bytes from one flat table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as X
from churnlens.llm.tables import given_back, small_batches, unused

#: Merged misses that a worker remembers before it starts anew.
REMEMBERED = 150_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bytes_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the byte strings that lie end to end in `data`."""
    every = np.ones(256, dtype=bool)
    out = X.mix(np.zeros(len(bounds) - 1, np.uint64))
    full = np.flatnonzero(np.diff(bounds))
    out[full] = X.find_words(data, bounds, every).hash
    return out


def _flat(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=bounds[1:])
    return np.frombuffer(b"".join(pieces), np.uint8), bounds


class PerfectHash:
    """Minimal perfect hash: n distinct keys have the slots 0 .. n - 1, by hash and displace.

    A bucket of several keys has a displacement under which they fall on free
    slots; a bucket of one key names its slot directly (as -1 - slot). A key's
    hash kept at its slot tells keys from strangers.
    """

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = n // 4 + 1
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-size, kind="stable"):
            if size[b] <= 1:
                break
            own, base = keys[order[first[b] : first[b] + size[b]]], 0
            while True:
                tries = np.arange(base, base + 64, dtype=np.uint64)[:, None]
                slots = np.sort(self._slots(own[None, :], tries), axis=1)
                fits = free[slots].all(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
                if fits.any():
                    hit = int(fits.argmax())
                    self.shift[b] = base + hit
                    free[slots[hit]] = False
                    break
                base += 64
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - np.flatnonzero(free)
        self.key = np.empty(n, np.uint64)
        self.slot = self._find(keys)  # of each key, in the order given
        self.key[self.slot] = keys

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (X.mix(keys + shift * _STEP) % np.uint64(self.n)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        moved = self._slots(keys, np.maximum(shift, 0).astype(np.uint64))
        return np.where(shift < 0, -1 - shift, moved)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for strangers."""
        slot = self._find(keys)
        return np.where(self.key[slot] == keys, slot, -1)


class Vocabulary:
    """Byte strings and their ranks (= ids), as in a .tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        tokens = list(ranks)
        self.hash = PerfectHash(bytes_hashes(*_flat(tokens)))
        self.id_at = np.empty(len(tokens), np.int64)
        self.id_at[self.hash.slot] = np.fromiter(ranks.values(), np.int64, len(tokens))
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes, self.bounds = _flat(by_id)
        self.size = [len(token) for token in by_id]
        self.merged: dict[str, bytes] = {}  # ids of misses, as int32

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token that is not in the vocabulary: lowest rank first, leftmost of equals."""
        get, size, n = self.ranks.get, self.size, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends, and the next one starts; 0: merged away
        before = list(range(-1, n))  # start of the part before
        heap = [r * n + i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = end[i]
            if not j or j >= n or (to := end[j]) != i + size[rank]:
                continue  # one of the two parts has changed since
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
                if (r := get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := get(piece[h:to])) is not None:
                heapq.heappush(heap, r * n + h)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text."""
        pieces, count = [], np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            pieces += self.pattern.findall(text)
            count[k + 1] = len(pieces)
        index = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        which = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        slot = self.hash.lookup(bytes_hashes(*_flat([p.encode() for p in index])))
        whole = np.where(slot >= 0, self.id_at[slot], -1)
        size, start, extra, base = np.ones(len(index), np.int64), np.arange(len(index)), [], len(index)
        misses = np.flatnonzero(whole < 0)
        distinct = list(index) if len(misses) else []
        if len(self.merged) > REMEMBERED:
            self.merged = {}
        for k in misses:
            piece = distinct[k]
            if (ids := self.merged.get(piece)) is None:
                ids = self.merged[piece] = array("i", self.merge(piece.encode())).tobytes()
            extra.append(ids)
        size[misses] = [len(ids) // 4 for ids in extra]
        start[misses] = base + np.cumsum(size[misses]) - size[misses]
        table = np.concatenate([whole, np.frombuffer(b"".join(extra), np.int32)])
        return _gather(table, start[which], size[which], count)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences end to end, and the bounds of each."""
        return _gather(self.bytes, self.bounds[ids], self.bounds[ids + 1] - self.bounds[ids], bounds)


def _gather(table: np.ndarray, start: np.ndarray, size: np.ndarray, bounds: np.ndarray):
    """table[start : start + size] of each part end to end; bounds are counted in parts."""
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    where = np.arange(total[-1]) + np.repeat(start - total[:-1], size)
    return table[where], total[bounds]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


def _encode_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            texts = batch.column(last)
            for lo, hi, _, _ in X.text_slices(texts):
                part = batch.slice(lo, hi - lo)
                ids, bounds = vocab.encode([t or "" for t in part.column(last).to_pylist()])
                tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                keep = [part.column(k) for k in range(last)]
                yield pa.RecordBatch.from_arrays([*keep, tokens], [*batch.schema.names[:last], "ids"])

    return rows


def _decode_rows(shared, column: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        for batch in batches:
            tokens = batch.column(column).fill_null([])
            size = tokens.value_lengths().to_numpy()
            bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            ids = tokens.flatten().to_numpy()
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + X.SLICE_BYTES // 4, side="right")) - 1)
                data, ends = vocab.decode(ids[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                whole = data.tobytes()
                decoded = pa.array([whole[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*batch.schema.names, "decoded"])
                lo = hi

    return rows


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with `ids` array<int>: the BPE ids of each text, without special tokens.

    Each match of `pattern` is encoded by itself, by the ranks in the file at
    `path` (read by the driver; the vocabulary, not the data, sets the size of
    the broadcast). A null or empty text has no ids. An `ids` column that
    `docs` has already is replaced. A very long text is encoded as a whole; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    source = docs.drop("ids") if "ids" in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    rows = source.withColumn(unused(source, "text"), docs[text_col].cast("string"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    return rows.mapInArrow(_encode_rows(shared), ", ".join([*fields, "ids array<int>"]))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """`rows` with `decoded` binary: the bytes of their `ids` (null ids: no bytes)."""
    source = rows.drop("decoded") if "decoded" in rows.columns else rows
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    return source.mapInArrow(
        _decode_rows(shared, source.columns.index("ids")), ", ".join([*fields, "decoded binary"])
    )


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, decoded = batch.column(1), batch.column(2)
        size = tokens.value_lengths().to_numpy()
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = tokens.flatten().to_numpy().astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(size.astype(np.int64)),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                pa.array([hashlib.sha256(b.as_py()).hexdigest() for b in decoded], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _coded_rows(shared, last=None):
    """Encoding, decoding and what `last` makes of it in one worker: the vocabulary is held once, ids cross to the JVM once at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _decode_rows(shared, 1)(_encode_rows(shared)(batches))
        yield from last(coded) if last else coded

    return given_back(rows)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row (doc_id, text): encode() and decode() in one pass."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_coded_rows(shared), "doc_id long, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of `docs`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_coded_rows(shared, _digest_rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
