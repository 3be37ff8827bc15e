"""Source divergence audit: how far the term use of the sources of a language lies apart.

A translate table lower-cases A-Z and blanks every separator byte in one pass
(`bytes.translate`), `bytes.split` gives the terms, and a Counter of each document
its term frequencies. Tasks merge the counters by (language, source) and emit
them sparsely, with the number of documents beside the occurrences; Spark sums.

A language keeps the terms of at least LEAST_DOCUMENTS of its documents. Every
group (language, source) then has a smoothed share of each kept term, as an
integer out of 10^9, and two shares p, q differ by floor((p - q)^2 / (p + q)).
All arithmetic is on integers. Terms that neither of two sources has all add the
same number, so they are counted, not visited.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import text as X
from churnlens.llm.tables import if_short, small_batches, stored

#: A term is kept in a language if so many of the language's documents have it.
LEAST_DOCUMENTS = 10
#: Terms that a group reports.
TOP_TERMS = 10
#: (group, term) entries that a worker merges before it emits them.
MOST_ENTRIES = 200_000
#: Rows of (source, term) that one bucket of terms holds, about.
BUCKET_ROWS = 400_000
#: Sources of a language that one task compares with as many others.
SOURCE_BLOCK = 512
#: Numbers of a dense slice (sources x terms) that a task holds.
SLICE_NUMBERS = 1 << 20

#: A-Z to a-z; all other bytes below 0x80 but a-z to a blank.
TERMS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in groups.items():
            # the row without a term says that the group occurs
            n = len(times) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array([None, *times], pa.string()),
                    pa.array([0, *times.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in times)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, data, bounds in X.text_slices(batch.column(2)):
            blanked = data.tobytes().translate(TERMS)
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]), lo):
                key = (langs[k], sources[k])
                if key not in groups:
                    groups[key] = Counter(), Counter()
                times, docs = groups[key]
                size -= len(times)
                found = Counter(blanked[a:b].split())
                times.update(found)
                docs.update(found.keys())
                size += len(times)
                if size > MOST_ENTRIES:
                    yield from merged()
                    size = 0
    yield from merged()


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a null term for the group itself.

    Null lang, source and text are ''.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count_rows, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)) of SQL expressions, exactly; null without kept terms."""
    top = f"CAST({n} + 2 AS DECIMAL(27, 0)) * 1000000000BD"
    return F.expr(f"1L + ({top}) div nullif(CAST({total} + 2 * {kept} AS DECIMAL(27, 0)), 0BD)")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares; at most 10^18 before the division, so longs hold it."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_rows(group: pa.Table) -> pa.Table:
    """Sums of distances over the terms of one bucket, for the pairs of one or two blocks of sources."""
    names, source = np.unique(np.array(group["source"].to_pylist(), dtype=object), return_inverse=True)
    terms = group["term"].combine_chunks().dictionary_encode() if group.num_rows else None
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    seen = len(terms.dictionary)
    least, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    least[source] = group["least"].to_numpy()
    block[source] = group["block"].to_numpy()
    one, other = group["one"][0].as_py(), group["other"][0].as_py()
    first = np.flatnonzero(block == one)
    sums = np.zeros((len(first), len(names)), np.int64)
    has = terms.is_valid().to_numpy(zero_copy_only=False)
    at, who = terms.indices.fill_null(0).to_numpy()[has], source[has]
    p = group["p"].to_numpy(zero_copy_only=False)[has].astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, who, p = at[order], who[order], p[order]
    width = max(1, SLICE_NUMBERS // len(names))
    for lo in range(0, seen, width):
        a, b = np.searchsorted(at, (lo, lo + width))
        shares = np.repeat(least[:, None], min(width, seen - lo), axis=1)
        shares[who[a:b], at[a:b] - lo] = p[a:b]
        for k, i in enumerate(first):
            apart = shares - shares[i]
            sums[k] += (apart * apart // (shares + shares[i])).sum(axis=1)
    i, j = np.meshgrid(np.arange(len(first)), np.arange(len(names)), indexing="ij")
    wanted = (names[first][:, None] < names[None, :]) if one == other else np.broadcast_to(block == other, i.shape)
    i, j = i[wanted], j[wanted]
    return pa.table(
        {
            "lang": pa.array([group["lang"][0].as_py()] * len(i), pa.string()),
            "a": pa.array(names[first][i].tolist(), pa.string()),
            "b": pa.array(names[j].tolist(), pa.string()),
            "f": pa.array(sums[i, j], pa.int64()),
            "seen": pa.array(np.full(len(i), seen, np.int64)),
        }
    )


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two different sources of a language, both ways.

    `groups` is stored and has (lang, source, kept, least); `shares` is stored and has
    (lang, source, term, p, least). Terms are dealt to buckets by hash, sources to
    blocks; each bucket also gets one row of every source, which may have none of its terms.
    """
    rows = shares.count()
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    buckets, blocks = max(8, -(-rows // BUCKET_ROWS)), max(1, -(-most // SOURCE_BLOCK))
    everyone = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "least")
    everyone = everyone.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    dealt = shares.select("lang", "source", "term", "p", "least", F.expr(f"pmod(xxhash64(term), {buckets}L)").alias("bucket"))
    both = everyone.unionByName(dealt).withColumn("least", F.coalesce("least", F.lit(1).cast("long")))
    both = both.withColumn("block", F.expr(f"pmod(xxhash64(source), {blocks}L)"))
    both = both.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = both.select("*", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other")).drop("with")
    summed = (
        both.groupBy("lang", "bucket", "one", "other")
        .applyInArrow(_pair_rows, "lang string, a string, b string, f long, seen long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"))
    )
    ends = groups.select("lang", "source", "least", "kept")
    left, right = ends.toDF("lang", "a", "p", "kept"), ends.drop("kept").toDF("lang", "b", "q")
    whole = summed.join(left, ["lang", "a"]).join(right, ["lang", "b"])
    # terms that no source of the two blocks has
    rest = F.when(F.col("kept") > 0, (F.col("kept") - F.col("seen")) * distance("p", "q")).otherwise(0)
    whole = whole.withColumn("value", F.col("f") + rest)
    turned = [whole.selectExpr("lang", f"{a} AS source", f"{b} AS item", "value") for a, b in (("a", "b"), ("b", "a"))]
    return turned[0].unionByName(turned[1])


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for rows (text, lang, source); other columns are not read.

    part 'pair': every other source of the language with the summed distance of its
    shares over all kept terms (0 if none are kept). part 'term': the kept terms that
    the group uses more than its language, by distance, the first TOP_TERMS of them.
    Ranks count from 1 in each group and part, larger values first, then by the
    bytes of the item. Nulls are ''; repeated rows count as often as they stand
    there; a very long text is one Counter; an empty table gives an empty result,
    a language of one source no pairs.
    """
    counts = stored(group_counts(docs))
    terms = counts.filter("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = kept.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    used = stored(terms.drop("docs").join(kept, ["lang", "term"]))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = groups.join(by_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = stored(groups.withColumn("least", share("0L", "total", "kept")))

    shares = used.join(if_short(groups), ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    shares = stored(shares.select("lang", "source", "term", "p", "least", share("in_lang", "lang_total", "kept").alias("q")))
    own = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(groups, shares).withColumn("rank", F.row_number().over(by))
    own = own.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP_TERMS)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(own.withColumn("part", F.lit("term")).select(columns))
