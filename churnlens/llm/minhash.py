"""MinHash near-duplicate classes over word shingles.

1. Every document gets its set of five-word shingles, a signature of universal
   hash minima, and two hashes of the whole set. Documents with equal sets are
   one class from here on, whatever their number.
2. Bands of minima put class representatives into buckets. The chance that a
   pair at the similarity of 0.85 shares none of the 24 bands of 5 minima is
   (1 - 0.85^5)^24 = 8e-7 (7e-5 at 0.8), and falls quickly above it.
3. In each bucket every member is checked against one hub (the member with the
   largest buckets): signatures first, then the full sets. Components by
   large-star / small-star.
4. Buckets that still hold several components are checked block by block, so
   that no candidate link is lost: members are cut into blocks by set size,
   block pairs whose sizes rule a link out are skipped, and the rest are
   compared on signatures and then on full sets. Only real links are emitted.

A task holds at most two blocks of bounded size, whatever the size of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as X
from churnlens.llm.components import connected_components
from churnlens.llm.tables import dealt_anew, given_back, if_short, small_batches, stored, unused

BANDS, ROWS = 24, 5
#: A block holds about this many members and, unless one set is larger, this many shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1 << 20
#: A pair's signatures may agree this much less than the similarity asked for (over six standard deviations).
SLACK = 0.22

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = _rng.integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def document_shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted in each document) and each document's bounds in them."""
    words = X.find_words(data, bounds, X.SPACED, lower=True)
    counts = np.diff(words.first)
    sums = X.gram_sums(words.hash)
    grams = X.gram_hashes(words.hash, width)
    sets = []
    for d, n in enumerate(counts):
        lo = words.first[d]
        if n == 0:
            sets.append(np.empty(0, np.uint64))
        elif n < width:
            # marked by its length: a short text never equals a full shingle
            sets.append(X.mix(X.range_hashes(sums, np.array([lo]), n) + np.uint64(n)))
        else:
            s = np.sort(grams[lo : lo + n - width + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _minima(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signature of each non-empty set."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((shingles * _A[k] + _B[k]) >> np.uint64(32), at)
    return out


def _band_keys(minima: np.ndarray) -> np.ndarray:
    """One key for each band: band k has the minima k * ROWS and on."""
    key = np.broadcast_to(X.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(minima), BANDS))
    for r in range(ROWS):
        key = X.mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS].astype(np.uint64))
    return key


def _sketch_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in X.text_slices(batch.column(1)):
                shingles, first = document_shingles(data, bounds, width)
                n = np.diff(first)
                some = np.flatnonzero(n)
                h1, h2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                keys = np.empty((0, BANDS), np.uint64)
                if len(some):
                    h1[some] = np.add.reduceat(X.mix(shingles + np.uint64(1)), first[some])
                    h2[some] = np.add.reduceat(X.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), first[some])
                    keys = _band_keys(_minima(shingles, first))
                ends = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return rows


def _set_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in X.text_slices(batch.column(1)):
                shingles, first = document_shingles(data, bounds, width)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                whole = shingles.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                        pa.array([m.tobytes() for m in _minima(shingles, first)], pa.binary()),
                        pa.array([whole[8 * first[d] : 8 * first[d + 1]] for d in some], pa.binary()),
                    ],
                    ["rep", "signature", "shingles"],
                )

    return rows


def _agreement(sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """Share of equal minima for every pair of rows of two signature blocks."""
    same = np.zeros((len(sig_a), len(sig_b)), np.uint16)
    for k in range(sig_a.shape[1]):
        same += sig_a[:, k, None] == sig_b[None, :, k]
    return same / sig_a.shape[1]


def _links(left: pd.DataFrame, right: pd.DataFrame, same: bool, num: int, den: int) -> pd.DataFrame:
    """Links (a, b) between two blocks: signatures, then sizes, then full sets (as bit rows)."""
    none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if not len(left) or not len(right):
        return none
    sig = [np.stack([np.frombuffer(s, np.uint32) for s in part["signature"]]) for part in (left, right)]
    sets = [[np.frombuffer(s, np.uint64) for s in part["shingles"]] for part in (left, right)]
    size = [np.array([len(s) for s in part], np.int64) for part in sets]
    small, large = np.minimum.outer(*size), np.maximum.outer(*size)
    near = (_agreement(*sig) >= num / den - SLACK) & (den * small >= num * large)
    near &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
    if same:
        near &= left["rep"].to_numpy()[:, None] < right["rep"].to_numpy()[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return none
    rows = [np.unique(i), np.unique(j)]
    flat = [np.concatenate([sets[k][x] for x in rows[k]]) for k in (0, 1)]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    bits = []
    for k in (0, 1):
        block = np.zeros((len(size[k]), (len(common) + 7) // 8), np.uint8)
        for x in rows[k]:
            present = np.zeros(block.shape[1] * 8, bool)
            present[np.searchsorted(common, np.intersect1d(sets[k][x], common, assume_unique=True))] = True
            block[x] = np.packbits(present)
        bits.append(block)
    step = max(1, (1 << 24) // max(1, bits[0].shape[1]))
    shared = np.concatenate(
        [
            np.bitwise_count(bits[0][i[s : s + step]] & bits[1][j[s : s + step]]).sum(axis=1, dtype=np.int64)
            for s in range(0, len(i), step)
        ]
    )
    union = size[0][i] + size[1][j] - shared
    real = den * shared >= num * union
    return pd.DataFrame({"a": left["rep"].to_numpy()[i[real]], "b": right["rep"].to_numpy()[j[real]]})


def _check_pairs(blocks: DataFrame, sets: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Links between the two sides of each group of `blocks` (keys..., side, rep, component); without a side 1, within side 0."""

    def check(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        return _links(left, right if len(right) else left, not len(right), num, den)

    return blocks.join(sets, "rep").groupBy(*keys).applyInPandas(check, "a long, b long")


def near_duplicate_classes(
    docs: DataFrame, num: int = 85, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Two texts are linked when den * |A & B| >= num * |A | B| over their sets of
    `width`-word shingles (A-Z lower-cased, words split at ASCII white space);
    a text with fewer words has its whole sequence as one shingle. Null, empty
    and blank texts have an empty set and are linked with nothing. A row with a
    null id is linked with nothing: its component is null and it is kept. Rows
    that repeat an id are one node, even on different texts; each of them is returned. A very long text is one set. Other columns of
    `docs` are ignored, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    columns = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"
    sketch = stored(source.mapInArrow(given_back(_sketch_rows(width)), columns))
    twice = (
        sketch.filter("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("doc_id")
        .agg(F.count("*").alias("c"), F.min("h1").alias("x"), F.max("h1").alias("y"))
        .filter("c > 1 AND x <> y")
        .select("doc_id")
    )
    if twice.isEmpty():
        return _classes(source, sketch, None, num, den, width)
    # ids on several texts: each such text is a node of its own, linked to the others of its id
    twice = stored(twice)
    node = F.when(F.col("shared"), -1 - F.abs(F.xxhash64("doc_id", "text") % (1 << 62))).otherwise(F.col("doc_id"))
    marked = source.join(if_short(twice.withColumn("shared", F.lit(True))), "doc_id", "left")
    source = stored(marked.select(F.col("doc_id").alias("id"), node.alias("doc_id"), "text", "shared"))
    ids = source.filter("shared").select("id", F.col("doc_id").alias("node")).distinct()
    centre = ids.groupBy("id").agg(F.min("node").alias("b"))
    links = ids.join(centre, "id").select(F.col("node").alias("a"), "b").filter("a <> b")
    source = source.select("doc_id", "text")
    found = stored(_classes(source, stored(source.mapInArrow(given_back(_sketch_rows(width)), columns)), links, num, den, width))
    named = found.join(ids, found["doc_id"] == ids["node"], "left").select(
        F.coalesce("id", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("top")
    )
    least = named.filter("top IS NOT NULL").groupBy("top").agg(F.min("doc_id").alias("component_id"))
    return named.join(dealt_anew(least, "top"), "top", "left").select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _classes(source: DataFrame, sketch: DataFrame, same_id: DataFrame | None, num: int, den: int, width: int) -> DataFrame:
    """near_duplicate_classes() of rows (doc_id, text) whose ids stand on one set each; `same_id` are further links."""
    linked = sketch.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linked.groupBy("h1", "h2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")
    )
    reps = stored(classes.withColumnRenamed("n_shingles", "n"))

    bands = reps.select(F.explode("bands").alias("bucket"), "rep", "n")
    counts = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = stored(bands.join(dealt_anew(counts, "bucket"), "bucket"))

    # the hub of a bucket: the member whose buckets are the largest
    weight = members.groupBy("rep").agg(F.sum("members").alias("weight"))
    ranked = members.join(dealt_anew(weight, "rep"), "rep")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("weight", -F.col("rep"))).alias("top"))
    hubs = dealt_anew(hubs.select("bucket", (-F.col("top.col2")).alias("hub")), "bucket")
    pairs = stored(members.join(hubs, "bucket").filter("rep <> hub").select("hub", "rep", "n").distinct())
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(
        source.join(if_short(wanted), "doc_id", "left_semi")
        .mapInArrow(given_back(_set_rows(width)), "rep long, signature binary, shingles binary")
        .join(reps.select("rep", F.col("n").alias("size")), "rep")
        .filter(F.length("shingles") == 8 * F.col("size"))
        .dropDuplicates(["rep"])
        .drop("size")
    )
    per_hub = pairs.groupBy("hub").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts")
    )
    spokes = pairs.join(dealt_anew(per_hub, "hub"), "hub").withColumn("part", F.expr("pmod(xxhash64(rep), parts)"))
    centre = spokes.select("hub", "part").distinct().withColumn("rep", F.col("hub"))
    stars = spokes.select("hub", "part", F.lit(1).alias("side"), "rep").unionByName(
        centre.select("hub", "part", F.lit(0).alias("side"), "rep")
    )
    star_links = _check_pairs(stars.withColumn("component", F.col("rep")), sets, ["hub", "part"], num, den)
    if same_id is not None:
        rep_of = linked.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep").distinct()
        ends = same_id.join(rep_of.toDF("a", "x"), "a").join(rep_of.toDF("b", "y"), "b")
        star_links = star_links.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = stored(connected_components(star_links))

    # buckets whose members, the hub aside, are of several components: compare them in blocks
    spare = members.filter("members > 2").join(hubs, "bucket").filter("rep <> hub").drop("members", "hub")
    named = spare.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    open_buckets = (
        named.groupBy("bucket")
        .agg(
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"),
        )
        .filter("lo < hi")
    )
    # size classes of half an octave, each in `parts` hashed parts
    block = F.when(F.col("parts") <= 1, F.lit(0)).otherwise(
        F.floor(2 * F.log2("n")) * F.col("parts") + F.expr("pmod(xxhash64(rep), parts)")
    )
    placed = stored(
        named.join(dealt_anew(open_buckets, "bucket"), "bucket").select("bucket", "rep", "n", "component", block.alias("block"))
    )
    ranges = placed.groupBy("bucket", "block").agg(
        F.min("n").alias("n_lo"),
        F.max("n").alias("n_hi"),
        F.min("component").alias("c_lo"),
        F.max("component").alias("c_hi"),
    )
    other = ranges.select("bucket", *[F.col(c).alias(f"o_{c}") for c in ranges.columns if c != "bucket"])
    work = (
        ranges.join(other, "bucket")
        .filter("block <= o_block AND NOT (c_lo = c_hi AND o_c_lo = o_c_hi AND c_lo = o_c_lo)")
        .filter(f"{den} * n_hi >= {num} * o_n_lo AND {den} * o_n_hi >= {num} * n_lo")
        .select("bucket", F.col("block").alias("left_block"), F.col("o_block").alias("right_block"))
    )
    left = placed.withColumnRenamed("block", "left_block").join(work, ["bucket", "left_block"])
    right = placed.withColumnRenamed("block", "right_block").join(
        work.filter("left_block < right_block"), ["bucket", "right_block"]
    )
    keys = ["bucket", "left_block", "right_block"]
    more = _check_pairs(
        left.select(*keys, F.lit(0).alias("side"), "rep", "component").unionByName(
            right.select(*keys, F.lit(1).alias("side"), "rep", "component")
        ),
        sets,
        keys,
        num,
        den,
    )
    ends = nodes.select(F.col("node"), F.col("component"))
    lifted = (
        more.distinct()
        .join(ends.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(ends.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    merged = connected_components(lifted).select(F.col("node").alias("component"), F.col("component").alias("top"))
    # a hot component is split by the left join; members that no star had linked come from the other side
    alone = merged.join(dealt_anew(nodes.select(F.col("node").alias("component")), "component"), "component", "left_anti")
    found = stored(
        nodes.join(dealt_anew(merged, "component"), "component", "left")
        .select(F.col("node").alias("rep"), F.coalesce("top", "component").alias("component"))
        .union(alone.select("component", "top"))
    )
    of_class = reps.select("h1", "h2", "rep").join(found, "rep", "left")
    return (
        sketch.select("doc_id", "n_shingles", "h1", "h2")
        .join(
            of_class.select("h1", "h2", F.coalesce("component", "rep").alias("component")), ["h1", "h2"], "left"
        )
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"),
        )
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the smallest id of each class only, same columns; of repeated rows of that id, equal in words, one stays.

    Rows with a null id stay, and so do different texts under the id that is kept.
    """
    classes = stored(near_duplicate_classes(docs, **options).select("doc_id", "kept"))
    key, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    dropped = classes.filter("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    out = docs.join(if_short(dropped), key, "left_anti").select(docs.columns)
    twice = classes.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if twice.isEmpty():
        return out
    words = unused(docs, "words")
    named = out.filter(F.col(key).isNotNull())
    named = named.withColumn(words, F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[ \t-\r]+", " "))))
    return named.dropDuplicates([key, words]).drop(words).unionByName(out.filter(F.col(key).isNull()))
