"""Benchmark decontamination by suffix arrays over the training text.

Every shard (a run of whole documents inside a task) gets a suffix array: the
word positions that can start a match, sorted by the words that follow. Every
test suffix is found in it by binary search, which gives the range of training
positions that hold a window; matches on the same diagonal are joined into
maximal verbatim matches with their locations. Shards hold whole documents, so
their results need no shuffle. The test set is hashed in tasks and written in
blocks of bounded size, which are sent one at a time; one pass over the shards
is made for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as X
from churnlens.llm.tables import given_back, small_batches, written
from churnlens.session import scratch_path

WINDOW = 10
#: Test words sent to the tasks at once; a larger test set takes several passes.
BLOCK_WORDS = 2_000_000
_FILTER_BITS = 22

MATCH = "struct<item_id:bigint,word:bigint,item_word:bigint,n_words:bigint>"


@dataclass
class TestBlock:
    """Test items as one array of word hashes, with a window start for each test suffix."""

    items: np.ndarray  # item ids
    words: np.ndarray  # word hashes of all items, end to end
    suffix: np.ndarray  # positions of the windows
    length: np.ndarray  # words in the window at each position
    item: np.ndarray  # index of the item of each window
    offset: np.ndarray  # its first word within the item

    def __post_init__(self):
        self.lead = int(min(3, self.length.min())) if len(self.length) else 1
        self.heads = np.unique(X.range_hashes(X.gram_sums(self.words), self.suffix, self.lead))
        self.bitmap = np.zeros(1 << _FILTER_BITS, bool)
        self.bitmap[self.heads >> np.uint64(64 - _FILTER_BITS)] = True


def test_block(item_ids: list[int], hashed: list[np.ndarray], window: int) -> TestBlock:
    """The block of these items; `hashed` holds the word hashes of each."""
    parts, suffix, length, item, offset, base = [], [], [], [], [], 0
    for k, words in enumerate(hashed):
        n = len(words)
        if n == 0:
            continue
        starts = np.arange(max(1, n - window + 1))
        parts.append(words)
        suffix.append(base + starts)
        length.append(np.full(len(starts), min(n, window)))
        item.append(np.full(len(starts), k))
        offset.append(starts)
        base += n
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    return TestBlock(
        np.array(item_ids, np.int64),
        cat(parts, np.uint64),
        cat(suffix, np.int64),
        cat(length, np.int64),
        cat(item, np.int64),
        cat(offset, np.int64),
    )


class SuffixArray:
    """Suffixes of a shard's documents, in the order of their words, up to `depth` words deep.

    A suffix is kept only if its first words begin some test window; the others
    cannot be found by any search. The order is that of the word hashes.
    """

    def __init__(self, words: X.Words, block: TestBlock, depth: int):
        n = len(words.hash)
        self.depth, lead = depth, block.lead
        # a sentinel after the last word; document ends are checked by `left`
        self.words = np.concatenate([words.hash, np.zeros(depth, np.uint64)])
        heads = X.gram_hashes(words.hash, lead)
        at = np.flatnonzero(block.bitmap[heads >> np.uint64(64 - _FILTER_BITS)])
        at = at[np.isin(heads[at], block.heads)] if len(at) else at
        doc_end = np.repeat(words.first[1:], np.diff(words.first)) if n else np.empty(0, np.int64)
        self.left = np.minimum(doc_end[at] - at, depth)
        keep = self.left >= lead
        at, self.left = at[keep], self.left[keep]
        # words past the end of the document sort first and match nothing
        columns = [np.where(self.left > k, self.words[at + k], np.uint64(0)) for k in range(depth)]
        order = np.lexsort(columns[::-1]) if len(at) else np.empty(0, np.int64)
        self.at = at[order]
        self.columns = np.stack([c[order] for c in columns], axis=1) if len(at) else np.empty((0, depth), np.uint64)

    def search(self, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the array whose suffixes begin with the first `length` words of each query row."""
        return self._bound(query, length, False), self._bound(query, length, True)

    def _bound(self, query: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.at), np.int64)
        used = np.arange(self.depth)[None, :] < length[:, None]
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                return lo
            mid = (lo[todo] + hi[todo]) >> 1
            mine, theirs = self.columns[mid], query[todo]
            differs = (mine != theirs) & used[todo]
            first = differs.argmax(axis=1)
            rows = np.arange(len(todo))
            less = differs[rows, first] & (mine[rows, first] < theirs[rows, first])
            if after:
                less |= ~differs.any(axis=1)
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]


def _matches(words: X.Words, block: TestBlock, window: int) -> tuple[np.ndarray, ...]:
    """(position, window index) of every occurrence of a test window in the shard."""
    array = SuffixArray(words, block, window)
    if not len(array.at) or not len(block.suffix):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    reach = np.minimum(block.suffix[:, None] + np.arange(window)[None, :], len(block.words) - 1)
    query = block.words[reach]
    lo, hi = array.search(query, block.length)
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    rank = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    return array.at[rank], which


def _scan(block, window: int):
    """For each row: its words, the hit words, and the maximal verbatim matches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestBlock = block.value
        for batch in batches:
            for lo, hi, data, bounds in X.text_slices(batch.column(batch.num_columns - 1)):
                words = X.find_words(data, bounds, X.ALNUM, lower=True)
                at, which = _matches(words, test, window)
                docs = np.searchsorted(words.first, at, side="right") - 1
                yield _result(batch.slice(lo, hi - lo), words, at, which, docs, test)

    return rows


def _result(batch, words, at, which, docs, test) -> pa.RecordBatch:
    n = len(batch)
    matches, hits = [[] for _ in range(n)], [None] * n
    item, offset, length = test.item[which], test.offset[which], test.length[which]
    # matches of one item on one diagonal, one word apart, are one longer verbatim match
    order = np.lexsort((at, at - offset, item, docs))
    docs, at, item, offset, length = docs[order], at[order], item[order], offset[order], length[order]
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(offset) != 1) | (np.diff(item) != 0) | (np.diff(docs) != 0)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(at)) - 1
        for s, e in zip(start, last):
            d = docs[s]
            matches[d].append(
                {
                    "item_id": int(test.items[item[s]]),
                    "word": int(at[s] - words.first[d]),
                    "item_word": int(offset[s]),
                    "n_words": int(at[e] - at[s] + length[e]),
                }
            )
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(k) for k in range(batch.num_columns - 1)],
            pa.array(np.diff(words.first).astype(np.int64)),
            pa.array(matches, pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "word", "item_word", "n_words")]))),
        ],
        [*batch.schema.names[:-1], "n_words", "matches"],
    )


def _hashed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in X.text_slices(batch.column(1)):
            words = X.find_words(data, bounds, X.ALNUM, lower=True)
            n = np.diff(words.first)
            hashes = [words.hash[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "n", "words"])


@dataclass
class TestSet:
    """The hashed words of the test items, written in blocks of about `block_words` words."""

    items: DataFrame  # item_id, n, words, block
    n_blocks: int
    window: int

    def blocks(self) -> Iterator[TestBlock]:
        """One block after the other; only one is in the driver at a time, and an empty set has one empty block."""
        for k in range(self.n_blocks):
            rows = self.items.filter(F.col("block") == k).select("item_id", "words").collect()
            rows.sort(key=lambda r: (r.item_id, bytes(r.words)))
            yield test_block([r.item_id for r in rows], [np.frombuffer(r.words, np.uint64) for r in rows], self.window)


def test_set(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> TestSet:
    """Hashes the test items in tasks and deals them to blocks by id; an item is never cut."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("item_id IS NOT NULL").mapInArrow(_hashed_rows, "item_id long, n long, words binary")
    hashed = written(rows.filter("n > 0").distinct())
    total = hashed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    if n_blocks == 1:
        return TestSet(hashed.withColumn("block", block), 1, window)
    path = scratch_path(benchmark.sparkSession, "test-blocks")
    hashed.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(path)
    return TestSet(benchmark.sparkSession.read.parquet(path), n_blocks, window)


def verbatim_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keys: list[str] | None = None,
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(keys..., n_words, matches) for every row of `docs`, once for each block of the test set.

    `matches` lists the maximal verbatim matches of at least `window` words (or
    of a whole shorter item): item_id, first word in the document, first word
    in the item, and length in words. Words are runs of digits, letters a-z
    (A-Z lower-cased) and bytes beyond ASCII. Null, empty and wordless texts
    and items match nothing; items with a null id are left out; an empty test
    set gives one row per document without matches.
    """
    keys = keys or ["doc_id"]
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(*keys, F.col(text_col).cast("string").alias("__text"))
    test = test_set(benchmark, "item_id", "text", window, block_words)
    if test.n_blocks > 1:  # several passes: the matches of a text are brought together by its keys and content
        source = source.select(*keys, F.xxhash64("__text").alias("__content"), "__text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = f"{fields}, n_words long, matches array<{MATCH}>"
    parts = []
    for block in test.blocks():
        sent = spark.sparkContext.broadcast(block)
        found = source.mapInArrow(given_back(_scan(sent, window)), schema)
        if test.n_blocks == 1:
            return found
        # each pass is written before the next block is read, so one block is in memory at a time
        parts.append(written(found))
        sent.unpersist()
    found = reduce(DataFrame.unionAll, parts).groupBy(*keys, "__content", "n_words")
    found = found.agg(
        F.flatten(F.collect_list("matches")).alias("matches"),
        F.count("*").alias("__rows"),
    )
    # equal rows were brought together as well: each is returned, with the matches of one
    again = F.explode(F.sequence(F.lit(1), (F.col("__rows") / len(parts)).cast("int")))
    return found.select(*keys, "n_words", F.array_distinct("matches").alias("matches"), again).drop("col")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of `docs`.

    A word is hit if it lies in an occurrence of a window. items_sha256 is over
    the item ids with an occurring window, sorted as strings and comma-joined
    (of the empty string if there are none). See verbatim_matches for nulls.
    """
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = verbatim_matches(row, benchmark, window, ["doc_id"], **options)
    # hit words: the union of the matches, from their sorted starts and the furthest end so far
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["word"].alias("s"), (m["word"] + m["n_words"]).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def grow(state, m):
        fresh = F.greatest(F.lit(0).cast("long"), m["e"] - F.greatest(m["s"], state["to"]))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["to"], m["e"]).alias("to"))

    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(ordered, start, grow, lambda s: s["n"]).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without the rows whose text holds a verbatim window of the test set; same columns."""
    spark = docs.sparkSession
    small_batches(spark)
    test, out = test_set(benchmark, "item_id", "text", window, block_words), docs
    for block in test.blocks():
        sent = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(given_back(_clean_rows(sent, window, docs.columns.index("text"))), docs.schema)
        if test.n_blocks > 1:
            out = written(out)
            sent.unpersist()
    return out


def _clean_rows(block, window: int, column: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in X.text_slices(batch.column(column)):
                words = X.find_words(data, bounds, X.ALNUM, lower=True)
                at, _ = _matches(words, block.value, window)
                clean = np.ones(hi - lo, bool)
                clean[np.searchsorted(words.first, at, side="right") - 1] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))

    return rows
