"""Spelling variant grouping by a trie of letter-group counts.

The words of the corpus and their frequencies are counted by grouped aggregation.
A word stands in a trie under its successive counts of letters of each group
(GROUPS). One inserted or replaced code point raises one count by one at most, one
deleted or replaced code point lowers one by one at most; so a depth-first search for the words near a
given one may spend a surplus of one and a deficit of one on its way down, and
the words of the leaves it reaches are verified.

The trie is dealt to tasks by its upper nodes: a node of more than SHARD_WORDS words
is split into its children, level by level, and what is left are shards. The same
search over the upper nodes routes every word as a query to the shards that its
budget reaches. A shard with many queries gets them in several parts, a bottom node
with too many equal counts its words in several parts, each with all the
partners they need, so no task holds more than a bounded number of words and none
is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.tables import dealt_anew, small_batches, stored

#: A word has so many code points, and occurs so often, at least.
LEAST_LENGTH, LEAST_TIMES = 7, 2
#: A word's form occurs so many times as often as the word.
FORM_FACTOR = 10
#: One of so many (document, run) hashes marks a run that loses a code point.
MARKED = 31
#: Words of a shard, and queries of one part of a shard, at most (queries: about).
SHARD_WORDS, PART_QUERIES = 40_000, 400_000
#: Words that a counting task merges before it emits them.
MOST_ENTRIES = 250_000
#: Rows of the directory of upper nodes counted at once, in levels.
LEVEL_STEP = 6

#: Letters of each group, in the order of the levels of the trie; accented letters follow in four groups by code point.
LETTERS = ("e", "t", "a", "o", "n", "i", "s", "r", "h", "l", "d", "u", "c", "m", "fw", "gy", "pb", "vkxjqz")
GROUPS = len(LETTERS) + 4

_GROUP = np.zeros(256, np.int64)
for _k, _letters in enumerate(LETTERS):
    _GROUP[[ord(c) for c in _letters]] = _k
    _GROUP[[ord(c) - 32 for c in _letters]] = _k
_GROUP[0xC0:] = len(LETTERS) + np.arange(64) % 4

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def document_words(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """(word, times) of one text, with runs of at least LEAST_LENGTH and their marked losses applied."""
    runs = Counter(_RUN.findall((text or "").encode().translate(_LOWER).decode()))
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        if h % MARKED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    times: dict[str, int] = {}

    def merged() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())], ["word", "n"])
        times.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            for word, n in document_words(doc_id.as_py(), text.as_py()):
                times[word] = times.get(word, 0) + n
            if len(times) > MOST_ENTRIES:
                yield merged()
    yield merged()


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points and LEAST_TIMES occurrences over all rows (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_word_rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of each letter group in each word (Latin-1 bytes); counts beyond 255 are 255, which brings none further apart."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    where = np.repeat(np.arange(len(words)) * GROUPS, sizes) + _GROUP[flat]
    counts = np.bincount(where, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return np.minimum(counts, 255).astype(np.int16)


def _latin(words: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in words.to_pylist()]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `rows`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# the directory: {prefix of counts: number of words}, for all nodes whose parent is split


def _node_rows(lo: int, hi: int, split: set[bytes]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            found = vectors(_latin(batch.column(0))).astype(np.uint8)
            if lo:
                inside = [bytes(v[:lo]) in split for v in found]
                found = found[np.array(inside, bool)] if len(found) else found
            nodes: Counter = Counter()
            for level in range(lo + 1, hi + 1):
                prefix, n = np.unique(found[:, :level], axis=0, return_counts=True)
                nodes.update({bytes(p): int(k) for p, k in zip(prefix, n)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[:-1] for p in nodes], pa.binary()), pa.array(list(nodes), pa.binary()), pa.array(list(nodes.values()), pa.int64())],
                ["parent", "node", "n"],
            )

    return rows


def directory(words: DataFrame, most: int) -> dict[bytes, int]:
    """Words under each node of the trie whose parent has more than `most` of them, the root's children included.

    About GROUPS * words / most nodes reach the driver, with their few children.
    """
    nodes: dict[bytes, int] = {}
    split: set[bytes] = {b""}
    for lo in range(0, GROUPS, LEVEL_STEP):
        hi = min(GROUPS, lo + LEVEL_STEP)
        counted = words.select("word").mapInArrow(_node_rows(lo, hi, split), "parent binary, node binary, n long")
        counted = counted.groupBy("parent", "node").agg(F.sum("n").alias("n"))
        big = counted.groupBy("parent").agg(F.sum("n").alias("words")).filter((F.col("words") > most) | (F.length("parent") == lo))
        for r in counted.join(big, "parent").select("node", "n").toLocalIterator():
            nodes[bytes(r.node)] = r.n
        split = {node for node, n in nodes.items() if len(node) == hi and n > most}
        if not split:
            break
    return nodes


class Shards:
    """The nodes of the directory that are not split further, numbered, with the parts of each."""

    def __init__(self, nodes: dict[bytes, int], most: int):
        self.children: dict[bytes, list[tuple[int, bytes]]] = {}
        ends = []
        for node, n in sorted(nodes.items()):
            self.children.setdefault(node[:-1], []).append((node[-1], node))
            if n <= most or len(node) == GROUPS:
                ends.append(node)
        self.number = {node: k for k, node in enumerate(ends)}
        self.member_parts = np.array([-(-nodes[node] // most) for node in ends] or [1], np.int64)
        self.query_parts = np.ones(len(self.member_parts), np.int64)

    def reached(self, found: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, queries, which of them are at home there) by depth-first search with the vectors `found`."""
        every = np.arange(len(found))
        stack = [(b"", every, np.zeros(len(found), np.int8), np.zeros(len(found), np.int8))]
        while stack:
            node, queries, surplus, deficit = stack.pop()
            if node in self.number:
                yield self.number[node], queries, (surplus == 0) & (deficit == 0) & (found[queries, : len(node)] == np.frombuffer(node, np.uint8)).all(axis=1)
                continue
            own = found[queries, len(node)]
            for count, child in self.children.get(node, ()):
                more = count - own
                up, down = surplus + (more > 0) * np.abs(more), deficit + (more < 0) * np.abs(more)
                alive = (up <= 1) & (down <= 1)
                if alive.any():
                    stack.append((child, queries[alive], up[alive], down[alive]))


def _load_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: Shards = shared.value
        load = np.zeros(len(shards.member_parts), np.int64)
        for batch in _gathered(batches):
            for shard, queries, _ in shards.reached(vectors(_latin(batch.column(0)))):
                load[shard] += len(queries)
        some = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(load[some])], ["shard", "n"])

    return rows


def _route_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: Shards = shared.value
        for batch in _gathered(batches):
            words = _latin(batch.column(0))
            marks = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            for shard, queries, home in shards.reached(vectors(words)):
                ways, blocks = int(shards.query_parts[shard]), int(shards.member_parts[shard])
                for way in range(ways):
                    for block in range(blocks):
                        asks = marks[queries] % ways == way
                        stands = home & (marks[queries] // 97 % blocks == block)
                        at = np.flatnonzero(asks | stands)
                        if not len(at):
                            continue
                        part = (shard << 38) | (way << 19) | block
                        own = home[at] & asks[at] & (block == 0)  # one row for each word itself
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), part, np.int64)),
                                batch.column(0).take(pa.array(queries[at])),
                                batch.column(1).take(pa.array(queries[at])),
                                pa.array(asks[at]),
                                pa.array(stands[at]),
                                pa.array(own),
                            ],
                            ["part", "word", "n", "asks", "stands", "own"],
                        )

    return rows


#: Pairs of a node that are compared at once instead of going further down.
FEW_PAIRS = 1 << 13


def leaves(members: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, query) numbers that the depth-first search brings together.

    `members` are sorted vectors; a node is a range of them with equal counts on its
    upper levels. The search goes down with all queries that still have their budget.
    """
    zero = np.zeros(len(asked), np.int8)
    stack = [(0, 0, len(members), np.arange(len(asked)), zero, zero)]
    while stack:
        level, lo, hi, queries, surplus, deficit = stack.pop()
        if lo == hi or not len(queries):
            continue
        if level == GROUPS or (hi - lo) * len(queries) <= FEW_PAIRS:
            for k in range(0, len(queries), max(1, (FEW_PAIRS << 3) // (hi - lo))):
                some = slice(k, k + max(1, (FEW_PAIRS << 3) // (hi - lo)))
                more = members[lo:hi, None, level:] - asked[None, queries[some], level:]
                up = np.maximum(more, 0).sum(axis=2) + surplus[some]
                down = up - more.sum(axis=2) - surplus[some] + deficit[some]
                m, q = np.nonzero((up <= 1) & (down <= 1))
                yield m + lo, queries[some][q]
            continue
        column = members[lo:hi, level]
        own = asked[queries, level]
        counts, first = np.unique(column, return_index=True)
        ends = [*first[1:], hi - lo]
        for count, a, b in zip(counts, first, ends):
            more = count - own
            up, down = surplus + (more > 0) * np.abs(more), deficit + (more < 0) * np.abs(more)
            alive = (up <= 1) & (down <= 1)
            if alive.any():
                stack.append((level + 1, lo + a, lo + b, queries[alive], up[alive].astype(np.int8), down[alive].astype(np.int8)))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced byte makes `a` out of `b`."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


#: Longer words are verified one by one.
WIDTH = 32


class Verifier:
    """Checks pairs of words (Latin-1) for one edit, short ones as rows of a matrix."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.rows = np.frombuffer(b"".join(w[:WIDTH].ljust(WIDTH + 1, b"\0") for w in words), np.uint8).reshape(len(words), WIDTH + 1)

    def check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of word numbers whether they are one edit apart."""
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        longer = self.size[b] - self.size[a]
        out = longer <= 1
        wide = np.flatnonzero(out & (self.size[b] > WIDTH))
        out[wide] = [one_edit(self.words[i], self.words[j]) for i, j in zip(a[wide], b[wide])]
        near = np.flatnonzero(out & (self.size[b] <= WIDTH))
        x, y = self.rows[a[near]], self.rows[b[near]]
        differs = x != y
        first = differs.argmax(axis=1)
        same = ~differs.any(axis=1)
        # replaced: no second difference; inserted: x from the first difference on equals y one place further
        replaced = differs.sum(axis=1) == 1
        shifted = x[:, :-1] == y[:, 1:]
        inserted = (shifted | (np.arange(WIDTH) < first[:, None])).all(axis=1)
        out[near] = ~same & np.where(longer[near] == 1, inserted, replaced)
        return out


def _shard_rows(group: pa.Table) -> pa.Table:
    """Near words of the queries of one part: (word, n, near, best_n, best)."""
    names = group["word"].to_pylist()
    n = group["n"].to_numpy()
    words = [w.encode("latin-1") for w in names]
    found = vectors(words)
    stands, asks = group["stands"].to_numpy(), group["asks"].to_numpy()
    members, queries = np.flatnonzero(stands), np.flatnonzero(asks)
    members = members[np.lexsort(found[members].T[::-1])]
    verifier = Verifier(words)
    near, best_n, best = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.full(len(names), -1, np.int64)
    # Latin-1 bytes sort like code points
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))

    def settle(m: np.ndarray, q: np.ndarray) -> None:
        good = verifier.check(m, q)
        m, q = m[good], q[good]
        np.add.at(near, q, 1)
        order = np.lexsort((place[m], -n[m], q))
        m, q = m[order], q[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
        m, q = m[first], q[first]
        better = (n[m] > best_n[q]) | ((n[m] == best_n[q]) & (best[q] >= 0) & (place[m] < place[best[q]]))
        best[q[better]], best_n[q[better]] = m[better], n[m[better]]

    held_m, held_q, held = [], [], 0
    for m, q in leaves(found[members], found[queries]):
        held_m.append(members[m])
        held_q.append(queries[q])
        held += len(m)
        if held > 1 << 17:
            settle(np.concatenate(held_m), np.concatenate(held_q))
            held_m, held_q, held = [], [], 0
    if held:
        settle(np.concatenate(held_m), np.concatenate(held_q))
    out = np.flatnonzero((near > 0) | group["own"].to_numpy())
    has = best[out] >= 0
    return pa.table(
        {
            "word": pa.array([names[k] for k in out], pa.string()),
            "n": pa.array(n[out]),
            "near": pa.array(near[out]),
            "best_n": pa.array(best_n[out], pa.int64(), mask=~has),
            "best": pa.array([names[k] if k >= 0 else None for k in best[out]], pa.string()),
        }
    )


def near_words(words: DataFrame, most: int = SHARD_WORDS, part_queries: int = PART_QUERIES) -> DataFrame:
    """(word, n, n_near, best, best_n) for stored rows (word, n): the number of near words and the most frequent of them.

    Of equally frequent ones the first by code points is taken. Words are distinct
    and of code points below 256.
    """
    spark = words.sparkSession
    shards = Shards(directory(words, most), most)
    shared = spark.sparkContext.broadcast(shards)
    load = words.select("word").mapInArrow(_load_rows(shared), "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    for shard, n in load.collect():  # one row for each shard
        shards.query_parts[shard] = -(-n // part_queries)
    shared = spark.sparkContext.broadcast(shards)
    routed = words.select("word", "n").mapInArrow(
        _route_rows(shared), "part long, word string, n long, asks boolean, stands boolean, own boolean"
    )
    found = routed.groupBy("part").applyInArrow(_shard_rows, "word string, n long, near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return (
        found.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("top"))
        .select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form, form_n): forms followed to the last, by doubling the steps.

    A form occurs FORM_FACTOR times as often as its word, so a chain has no more
    links than the largest count has decimal places.
    """
    links = stored(forms.select("word", F.col("form").alias("root"), "form_n"))
    steps, most = 1, links.agg(F.max("form_n")).first()[0] or 0
    reached = links.select("word", "root")
    while FORM_FACTOR**steps * LEAST_TIMES < most:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("last"))
        reached = stored(reached.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")))
        steps *= 2
    return reached


def spelling_variants(docs: DataFrame, most: int = SHARD_WORDS, part_queries: int = PART_QUERIES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of rows (doc_id, text); other columns are not read.

    Two words are near if one inserted, deleted or replaced code point makes one of
    the other. A word's form is its most frequent near word (ties: the first by code
    points) if that occurs FORM_FACTOR times as often, else null; its root is where the forms
    lead, the word itself without one. Null and empty texts have no words, a null
    doc_id marks runs as an empty one; every repeated row counts; very long texts are one Counter,
    very long words are compared one by one; an empty table gives an empty result.
    """
    words = stored(corpus_words(docs))
    chosen = F.col("best_n") >= FORM_FACTOR * F.col("n")
    near = stored(
        near_words(words, most, part_queries).select(
            "word", "n", "n_near", F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")
        )
    )
    last = roots(near.filter("form IS NOT NULL"))
    return near.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
