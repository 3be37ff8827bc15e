"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected (minimiser) positions are kept: in every
window of MIN_WORDS words, the position whose GRAM-word start has the smallest
hash. Equal windows select the same position, so two copies of a passage of
MIN_WORDS words always share a kept suffix whose first GRAM words are equal.

1. `sparse_suffixes`: every kept suffix as (gram, context, text, position),
   where gram is the hash of its first GRAM words and context that of the whole
   stretch, left and right, that its windows reach. They are written once.
2. `sorted_neighbours`: the suffix array, sorted by (gram, context) over ranges of
   sampled splitters and in each range. A suffix is compared with its two neighbours
   and dropped if neither starts with the same words; the two at the ends
   of a range, whose other neighbour is in the next range, stay until step 3.
   A gram that a third of all suffixes share is spread over several ranges.
   Where all suffixes of a gram have the same context, they repeat as they
   stand. Equal contexts never need more work than one of them.
3. Of grams with several contexts, one suffix for each context is extended left
   and right, word by word, over the windows that selected it; these windows
   are compared over the corpus.
4. The repeated windows of each text are joined into spans.

The order is that of hashes instead of letters: any order that puts equal
starts side by side does. The steps after the sort are partial-aggregated groups or joins
of the suffixes that are left; a passage that a third of all texts share is one
row per task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as X
from churnlens.llm.tables import dealt_anew, given_back, if_short, small_batches, stored, unused, written

MIN_WORDS, GRAM = 50, 25

SPANS = "array<struct<start:int,end:int>>"


def kept_suffixes(grams: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each kept suffix of one text.

    Window p takes the leftmost smallest of grams[p : p + reach].
    """
    order = X.mix(grams ^ np.uint64(0x2545F4914F6CDD1D))
    picked = sliding_window_view(order, reach).argmin(axis=1) + np.arange(len(grams) - reach + 1)
    first = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
    last = np.append(first[1:], len(picked)) - 1
    return picked[first], first, last


def _per_text(words: X.Words, data_rows: int, min_words: int, gram: int):
    """For each text with a window: its row, word sums, and kept suffixes."""
    reach = min_words - gram + 1
    for d in range(data_rows):
        lo, hi = words.first[d], words.first[d + 1]
        if hi - lo < min_words:
            continue
        sums = X.gram_sums(words.hash[lo:hi])
        grams = X.range_hashes(sums, np.arange(hi - lo - gram + 1), gram)
        yield d, sums, grams, *kept_suffixes(grams, reach)


def _suffix_rows(min_words: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in X.text_slices(batch.column(1)):
                words = X.find_words(data, bounds, X.SPACED)
                out = [[], [], [], [], [], []]
                for d, sums, grams, at, first, last in _per_text(words, hi - lo, min_words, gram):
                    # the stretch of its windows, and where the suffix stands in it
                    stretch = X.range_hashes(sums, first, last - first + min_words)
                    place = (at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
                    out[0].append(grams[at])
                    out[1].append(X.mix(stretch + X.mix(place)))
                    out[2].append(np.full(len(at), uids[lo + d]))
                    out[3].append(at)
                    out[4].append(first - at)
                    out[5].append(last - at)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).view(np.int64)) for x in out[:3]]
                        + [pa.array(np.concatenate(x).astype(np.int32)) for x in out[3:]],
                        ["gram", "context", "uid", "at", "lo", "hi"],
                    )

    return rows


def _equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, those whose gram is that of the row before or after, and the first and last of the task."""
    held = None  # the last row of the batch before, and whether it is known to stay
    for batch in batches:
        if not len(batch):
            continue
        gram = batch.column(0).to_numpy()
        equal = gram[1:] == gram[:-1]
        keep = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        if held is None:
            keep[0] = True
        else:
            row, stays = held
            same = row.column(0)[0].as_py() == gram[0]
            keep[0] |= same
            if stays or same:
                yield row
        yield batch.slice(0, len(batch) - 1).filter(pa.array(keep[:-1]))
        held = batch.slice(len(batch) - 1), bool(keep[-1])
    if held is not None:
        yield held[0]


def _window_rows(min_words: int, gram: int):
    """Extends the chosen suffixes of each text: the hashes of all windows that selected them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = batch.column(2)
            for lo, hi, data, bounds in X.text_slices(batch.column(1)):
                words = X.find_words(data, bounds, X.SPACED)
                out = [[], [], [], [], [], [], []]
                for d, sums, grams, at, first, last in _per_text(words, hi - lo, min_words, gram):
                    picks = chosen[lo + d].values
                    place = np.searchsorted(at, picks.field("at").to_numpy())
                    size = last[place] - first[place] + 1
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    start = np.repeat(first[place], size) + step
                    out[0].append(X.range_hashes(sums, start, min_words))
                    out[1].append(picks.field("context").to_numpy())
                    out[2].append(picks.field("copies").to_numpy())
                    out[3].append(np.full(len(place), uids[lo + d]))
                    out[4].append(first[place])
                    out[5].append(first[place] - at[place])
                    out[6].append(size)
                if out[0]:
                    ends = np.concatenate(([0], np.cumsum(np.concatenate(out[6])))).astype(np.int32)
                    hashes = pa.array(np.concatenate(out[0]).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).view(np.int64)) for x in out[1:4]]
                        + [pa.array(np.concatenate(x).astype(np.int32)) for x in out[4:6]]
                        + [pa.ListArray.from_arrays(pa.array(ends), hashes)],
                        ["context", "copies", "uid", "start", "lo", "windows"],
                    )

    return rows


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the repeated windows of each context to runs with their first occurrence: (context, runs)."""
    for batch in batches:
        found = batch.column(1)
        flat, size = found.flatten(), found.value_lengths().to_numpy()
        own = np.repeat(np.arange(len(batch)), size)
        shift, uid, start = (flat.field(k).to_numpy() for k in ("shift", "uid", "start"))
        order = np.lexsort((shift, own))
        own, shift, uid, start = own[order], shift[order], uid[order], start[order]
        new = np.ones(len(own), bool)
        new[1:] = (np.diff(own) != 0) | (np.diff(shift) != 1) | (np.diff(start) != 1) | (uid[1:] != uid[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(own)) - 1 if len(head) else head
        runs = pa.StructArray.from_arrays(
            [pa.array(shift[head]), pa.array(shift[tail]), pa.array(uid[head]), pa.array(start[head])],
            ["lo", "hi", "uid", "start"],
        )
        ends = np.concatenate(([0], np.cumsum(np.bincount(own[head], minlength=len(batch))))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), runs)], ["context", "runs"])


def _covered(starts: np.ndarray, size: int, min_words: int) -> np.ndarray:
    """Words under windows at the given starts."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + min_words, -1)
    return np.cumsum(steps[:-1]) > 0


def _spans(marked: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def _span_rows(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, cut = [], []
            for uid, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, runs = found.values.field("at").to_numpy(), found.values.field("runs")
                per, flat = runs.value_lengths().to_numpy(), runs.flatten()
                low, high, of, first = (flat.field(k).to_numpy() for k in ("lo", "hi", "uid", "start"))
                size = high - low + 1
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                here = np.repeat(np.repeat(at, per) + low, size) + step
                later = (np.repeat(of, size) != uid) | (np.repeat(first, size) + step != here)
                words = int(here.max()) + min_words
                repeated.append(_spans(_covered(here, words, min_words)))
                kept = _covered(here[~later], words, min_words)
                cut.append(_spans(_covered(here[later], words, min_words) & ~kept))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(repeated, kind), pa.array(cut, kind)], ["uid", "repeated", "cut"]
            )

    return rows


def text_uid(id_col: str = "doc_id", text_col: str = "text"):
    """Key of a row in the steps below: its id and its text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


SUFFIX = "gram long, context long, uid long, at int, lo int, hi int"


def sparse_suffixes(source: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """The kept suffixes of `source` (uid, text), one row each, in the order of the texts."""
    return source.select("uid", "text").mapInArrow(given_back(_suffix_rows(min_words, gram)), SUFFIX)


def sorted_neighbours(suffixes: DataFrame) -> DataFrame:
    """The suffixes that start like a neighbour in the sorted array, and both ends of each of its ranges.

    A number for each row ends the order, so that a gram, or even a stretch, that most suffixes share is split as well.
    """
    order = ["gram", "context", "place"]
    placed = suffixes.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(*suffixes.columns).mapInArrow(_equal_neighbours, SUFFIX)


def repeated_spans(
    docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(uid, repeated, cut): word spans of the texts that hold a repeated passage.

    A passage is `min_words` consecutive words (split at ASCII white space,
    compared byte for byte) that occur at least twice, in two texts or in one.
    `repeated` joins all its occurrences in the text into spans [start, end) of
    word positions; `cut` has the words of occurrences that are not the first of
    their passage, without those of first occurrences, so that cutting them
    everywhere leaves every passage at least once. The first occurrence is the
    smallest by (uid, position), where uid is a hash of id and text: an
    arbitrary but fixed copy. Rows equal in id and text count as occurrences
    of each other and stand at the same place, so neither is cut on account of
    the other. Null, empty and short texts have no passage; ids may be null;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    source = docs.select(text_uid(id_col, text_col).alias("uid"), F.col(text_col).cast("string").alias("text"))
    shared = stored(sorted_neighbours(written(sparse_suffixes(source, min_words, gram))))
    contexts = stored(
        shared.groupBy("gram", "context", "lo", "hi").agg(
            F.count("*").alias("copies"), F.min(F.struct("uid", "at")).alias("one")
        )
    )
    # neighbours that are equal in their whole context repeat as they stand; others have to be extended.
    # An end of a range that has no equal anywhere is a context of its own with one copy, in neither group.
    several = contexts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    several = dealt_anew(several, "gram")
    alone = contexts.filter("copies > 1").join(several, "gram", "left_anti").select(
        "context", F.array(F.struct("lo", "hi", "one.uid", (F.col("one.at") + F.col("lo")).alias("start"))).alias("runs")
    )
    chosen = stored(
        contexts.join(several, "gram", "left_semi")
        .groupBy("one.uid")
        .agg(F.sort_array(F.collect_list(F.struct("one.at", "context", "copies"))).alias("chosen"))
    )
    windows = stored(
        source.join(if_short(chosen.select("uid")), "uid", "left_semi")
        .join(chosen, "uid")
        .dropDuplicates(["uid"])
        .mapInArrow(
            given_back(_window_rows(min_words, gram)),
            "context long, copies long, uid long, start int, lo int, windows array<long>",
        )
    )
    each = windows.select("*", F.posexplode("windows").alias("step", "window"))
    again = (
        each.select("window", "copies", "uid", (F.col("start") + F.col("step")).alias("start"))
        .groupBy("window")
        .agg(F.sum("copies").alias("n"), F.min(F.struct("uid", "start")).alias("first"))
        .filter("n > 1")
        .select("window", "first.uid", "first.start")
    )
    extended = (
        each.select("window", "context", (F.col("lo") + F.col("step")).alias("shift"))
        .join(dealt_anew(again, "window"), "window")
        .groupBy("context")
        .agg(F.collect_list(F.struct("shift", "uid", "start")).alias("found"))
        .mapInArrow(_run_rows, "context long, runs array<struct<lo:int,hi:int,uid:bigint,start:int>>")
    )
    per_text = (
        shared.select("uid", "at", "context")
        .distinct()
        .join(dealt_anew(alone.unionByName(extended), "context"), "context")
        .groupBy("uid")
        .agg(F.collect_list(F.struct("at", "runs")).alias("found"))
    )
    return per_text.mapInArrow(given_back(_span_rows(min_words)), f"uid long, repeated {SPANS}, cut {SPANS}")


def _word_count(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_spans, n_repeated_words, n_cut_words, repeated, cut) for the documents with a repeated passage."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_uid(id_col, text_col).alias("uid"))
    return rows.join(repeated_spans(docs, **options), "uid").select(
        "doc_id",
        F.size("repeated").cast("long").alias("n_spans"),
        _word_count("repeated").alias("n_repeated_words"),
        _word_count("cut").alias("n_cut_words"),
        "repeated",
        "cut",
    )


def _cut_rows(column: int, schema_names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(schema_names))
            texts = batch.column(column)
            touched = np.flatnonzero(spans.value_lengths().fill_null(0).to_numpy())
            fresh = {}
            for row in touched:
                raw = np.frombuffer((texts[row].as_py() or "").encode(), np.uint8)
                words = X.find_words(raw, np.array([0, len(raw)]), X.SPACED)
                keep, at = [], 0
                for span in spans[row].as_py():
                    # the words of the span and the white space after them
                    keep.append(raw[at : words.start[span["start"]]].tobytes())
                    at = words.start[span["end"]] if span["end"] < len(words.start) else len(raw)
                keep.append(raw[at:].tobytes())
                fresh[row] = b"".join(keep).decode()
            if fresh:
                whole = texts.to_pylist()
                for row, value in fresh.items():
                    whole[row] = value
                texts = pa.array(whole, texts.type)
            columns = [texts if k == column else batch.column(k) for k in range(len(schema_names))]
            yield pa.RecordBatch.from_arrays(columns, schema_names)

    return rows


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with all repeated passages but their first occurrence cut from the texts; same columns.

    Every row stays. A text that is cut as a whole becomes empty.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    uid, cut = unused(docs, "uid"), unused(docs, "cut")
    spans = spans.filter(F.size("cut") > 0).select(F.col("uid").alias(uid), F.col("cut").alias(cut))
    joined = docs.withColumn(uid, text_uid(id_col, text_col)).join(spans, uid, "left")
    return joined.select(*docs.columns, cut).mapInArrow(
        given_back(_cut_rows(docs.columns.index(text_col), docs.columns)), docs.schema
    )
