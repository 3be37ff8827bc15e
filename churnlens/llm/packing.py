"""Packing of examples into training sequences as vector bin packing.

An example is a vector of three sizes: tokens, segments (one) and loss-bearing
tokens. A sequence has a limit for each. The open sequence takes, again and
again, the waiting example that fits and has the largest dot product with the
room that is left (both as fractions of the limits), so an example that needs much
of what the sequence has plenty of goes first. What no waiting example fits into is
filled with the head of one; its rest waits on. A sequence that can't be
filled (too many segments, too much loss, nothing left) is cut to a power of two,
where no padding is needed, and the tokens behind wait on too.

A task packs the rows of its own partition in their order, with a bounded
number of waiting examples; nothing is shuffled, and a lost task repeats
itself exactly. Sequence ids carry the partition in their upper bits.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.tables import small_batches

#: Examples that wait in a task before sequences are closed.
WAITING = 1024
#: Pieces that a task emits together.
PIECES_PER_BATCH = 2048
#: Bits of a sequence id that number the sequences of one partition.
SEQUENCE_BITS = 36
#: Longer texts are tokenised in parts of about this many characters.
PART_CHARS = 1 << 16
# between a letter and a blank with a letter behind, the tokeniser's pattern always separates
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


@dataclass
class Example:
    """Token ids of one row from `start` on; `loss` counts the loss-bearing ones up to each place."""

    row: int
    ids: np.ndarray
    loss: np.ndarray | None  # None: every token bears loss
    start: int
    end: int

    def sizes(self) -> tuple[int, int, int]:
        n = self.end - self.start
        return n, 1, n if self.loss is None else int(self.loss[self.end] - self.loss[self.start])

    def head(self, tokens: int, loss_tokens: int) -> int:
        """Length of the longest head within both limits."""
        n = min(tokens, self.end - self.start)
        if self.loss is None:
            return min(n, loss_tokens)
        most = np.searchsorted(self.loss[self.start : self.end + 1], self.loss[self.start] + loss_tokens, side="right") - 1
        return min(n, int(most))


class Packer:
    """Waiting examples and the sequences made of them; emits (example, start, end, sequence, offset)."""

    def __init__(self, limits: Limits):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        self.tokens = limits.tokens
        self.sizes = np.full((2 * WAITING, 3), np.inf)
        self.waiting: list[Example | None] = [None] * len(self.sizes)
        self.free = list(range(len(self.sizes)))[::-1]
        self.sequences = 0

    def add(self, example: Example) -> Iterator[tuple]:
        """Lets `example` wait, but for heads that fill a sequence by themselves."""
        while example.end - example.start >= self.tokens and example.head(self.tokens, int(self.limits[2])) == self.tokens:
            yield example, example.start, example.start + self.tokens, self.sequences, 0
            self.sequences += 1
            example.start += self.tokens
        self._wait(example)
        while len(self.waiting) - len(self.free) > WAITING:
            yield from self._sequence()

    def rest(self) -> Iterator[tuple]:
        while len(self.free) < len(self.waiting):
            yield from self._sequence()

    def _wait(self, example: Example) -> None:
        if example.end > example.start:
            at = self.free.pop()
            self.waiting[at], self.sizes[at] = example, example.sizes()

    def _take(self, at: int) -> Example:
        example, self.waiting[at], self.sizes[at] = self.waiting[at], None, np.inf
        self.free.append(at)
        return example

    def _sequence(self) -> Iterator[tuple]:
        room, pieces = self.limits.copy(), []
        while room[0] and room[1]:
            weight = room / self.limits / self.limits
            fits = np.flatnonzero((self.sizes <= room).all(axis=1))
            if len(fits):
                at = fits[np.argmax(self.sizes[fits] @ weight)]
                room -= self.sizes[at]
                example = self._take(at)
                pieces.append((example, example.start, example.end))
                continue
            left = np.flatnonzero(np.isfinite(self.sizes[:, 0]))
            heads = [(at, n) for at in left[np.argsort(-(self.sizes[left] @ weight), kind="stable")[:8]]
                     if (n := self.waiting[at].head(int(room[0]), int(room[2])))]
            if not heads:
                break
            at, n = heads[0]
            example = self._take(at)
            cut = Example(example.row, example.ids, example.loss, example.start, example.start + n)
            room -= cut.sizes()
            pieces.append((example, cut.start, cut.end))
            example.start = cut.end
            self._wait(example)
        used = sum(end - start for _, start, end in pieces)
        keep = used if used == self.tokens else 1 << (used.bit_length() - 1)
        offset = 0
        for example, start, end in pieces:
            n = min(end - start, keep - offset)
            if n:
                yield example, start, start + n, self.sequences, offset
                offset += n
            if n < end - start:
                self._wait(Example(example.row, example.ids, example.loss, start + n, end))
        self.sequences += 1


SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long"


def _emit(examples: Iterator[tuple[object, Example]], limits: Limits, id_type: pa.DataType, digest: bool) -> Iterator[pa.RecordBatch]:
    """Record batches of the pieces of `examples`, each with the id of its row."""
    base = TaskContext.get().partitionId() << SEQUENCE_BITS
    packer, ids, out = Packer(limits), {}, []

    def batch() -> pa.RecordBatch:
        rows, starts, ends, sequences, offsets = zip(*out)
        slices = [e.ids[a:b] for e, a, b in zip(rows, starts, ends)]
        last = (
            pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in slices], pa.int64())
            if digest
            else pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(s) for s in slices]))), pa.int32()),
                pa.array(np.concatenate(slices).astype(np.int32)),
            )
        )
        columns = [
            pa.array([ids[e.row][0] for e in rows], id_type),
            pa.array(starts, pa.int64()),
            pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
            pa.array([len(e.ids) for e in rows], pa.int64()),
            pa.array([base + s for s in sequences], pa.int64()),
            pa.array(offsets, pa.int64()),
            last,
        ]
        for e, a, b in zip(rows, starts, ends):  # a row is forgotten with its last token
            ids[e.row][1] -= b - a
            if not ids[e.row][1]:
                del ids[e.row]
        out.clear()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(columns, ["id", *names, "ids_crc32" if digest else "ids"])

    for key, example in examples:
        ids[example.row] = [key, len(example.ids)]
        for piece in packer.add(example):
            out.append(piece)
            if len(out) >= PIECES_PER_BATCH:
                yield batch()
    for piece in packer.rest():
        out.append(piece)
        if len(out) >= PIECES_PER_BATCH:
            yield batch()
    if out:
        yield batch()


def _given_rows(limits: Limits, digest: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples():
            count = 0
            for batch in batches:
                ids, loss = batch.column(1), batch.column(2)
                for k in range(len(batch)):
                    tokens = np.array(ids[k].as_py() or [], np.int64)
                    if not len(tokens):
                        continue
                    bears = loss[k].as_py()
                    if bears is not None:
                        bears = np.array([bool(x) for x in bears[: len(tokens)]] + [False] * (len(tokens) - len(bears)), np.int64)
                        bears = np.concatenate(([0], np.cumsum(bears)))
                    yield batch.column(0)[k].as_py(), Example(count, tokens, bears, 0, len(tokens))
                    count += 1

        yield from _emit(examples(), limits, pa.int64(), digest)

    return rows


def pack(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids) of rows (id, ids array<int>, loss array<boolean>).

    The pieces of a sequence, by offset, are its tokens without a gap; all of a row's
    tokens lie in exactly one piece each. `loss` marks the tokens that bear loss
    (null: all; missing places: none). A sequence has limits.tokens tokens or a
    power of two of them. Rows without tokens (null or empty ids) give no pieces;
    every row is packed for itself, also with a null or repeated id; a long row is cut;
    an empty table gives an empty result. Further columns are not read.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("a sequence needs room for a token, a segment and a loss-bearing token")
    small_batches(rows.sparkSession)
    source = rows.select(F.col("id").cast("long").alias("id"), F.col("ids").cast("array<int>").alias("ids"), F.col("loss").cast("array<boolean>").alias("loss"))
    return source.mapInArrow(_given_rows(limits, False), f"id long, {SCHEMA}, ids array<int>")


def safe_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """`text` cut where the tokeniser's pattern separates anyway, into parts of about `most` characters."""
    parts, at = [], 0
    while len(text) - at > most and (found := _SAFE.search(text, at + most)):
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


# fixed value: the byte-level pattern of the tokenizer files, with possessive repeats (the same matches, no backtracking)
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_of_letter() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by token bytes if the file is byte-level BPE whose merges come in the order of their ids, else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if not plain or before.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges"):
        return None
    added = {t["content"] for t in spec.get("added_tokens", ())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"]["".join(pair)] for pair in pairs]
    if any(a >= b for a, b in zip(order, order[1:])):
        return None
    letters = byte_of_letter()
    return {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if token not in added}


_coders: dict[str, object] = {}


def _coder(spec: str):
    """Function from texts to ids, as the file's library gives them; special tokens' strings are ordinary text.

    Byte-level files are read as ranks, which merge several times faster to the same ids.
    """
    if spec not in _coders:
        _coders.clear()
        ranks = byte_ranks(json.loads(spec))
        if ranks:
            import tiktoken

            made = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _coders[spec] = lambda texts: [made.encode_to_numpy(t, disallowed_special=()) for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
            from tokenizers import Tokenizer

            other = Tokenizer.from_str(spec)
            other.encode_special_tokens = True
            _coders[spec] = lambda texts: [np.array(e.ids, np.uint32) for e in other.encode_batch_fast(texts, add_special_tokens=False)]
    return _coders[spec]


def _document_rows(shared, end_id: int, limits: Limits, digest: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = _coder(shared.value), np.array([end_id], np.uint32)

        def examples():
            count = 0
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1)):
                    ids = np.concatenate([*coder(safe_parts(text.as_py() or "")), end])
                    yield key.as_py(), Example(count, ids, None, 0, len(ids))
                    count += 1

        yield from _emit(examples(), limits, pa.int64(), digest)

    return rows


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, limits: Limits = Limits(), digest: bool = False
) -> DataFrame:
    """Pieces as pack() gives them for the token ids of whole texts (doc_id, text), each closed by `end_id`.

    The tokenizer file is read by the driver and sent along; its size is that of the
    vocabulary. A null text is empty: one token, the end. Every token bears loss.
    A special token's string inside a text is ordinary text. Very long texts are
    tokenised in parts, cut where the pattern separates anyway. With `digest` the last column
    is ids_crc32 (of the little-endian 32-bit ids) in place of ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as spec:
        shared = spark.sparkContext.broadcast(spec.read())
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    last = "ids_crc32 long" if digest else "ids array<int>"
    packed = source.mapInArrow(_document_rows(shared, end_id, limits, digest), f"id long, {SCHEMA}, {last}")
    return packed.withColumnRenamed("id", "doc_id")
