"""Language identification by Bayesian evidence fusion.

log P(l | row) = log P(l | host) + log P(declared | l) + weighted log P(text | l) + const

* P(text | l): multinomial over hashed letter trigrams, counted over all rows
  whose declared language is known (a noisy label, outvoted by the corpus).
* P(declared | l): how often rows whose text reads as l declare each language,
  counted over all rows and smoothed.
* P(l | host): counts of text languages by host, smoothed towards the counts of
  the address suffix, and those towards the counts of all rows.

l is one of the languages that the rows declare, however rarely, or unknown: a
text of unknown language has every trigram bucket with the same probability. It
competes like a language, so a text that no language explains better than chance
is rejected; a declared language is trusted up to a margin for each trigram.

All counts are grouped aggregations over whole tables. Only tables of languages x
buckets and languages^2 reach the driver (a tag has two or three letters, so
there are 18,252 at most); priors of hosts and suffixes are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as X
from churnlens.llm.tables import given_back, if_short, small_batches, stored, unused

#: Languages of rows that declare none at all.
LANGUAGES = ("de", "en", "es", "fr")
#: The class of texts in none of the languages.
UNKNOWN = "und"
#: A row that declares one of the languages is of none of them only if all explain its trigrams by so many nats each worse than
#: chance. Codes and boilerplate in a known language cost up to 0.95 on the given tables, letter noise and other scripts 3.6 and more.
UNKNOWN_MARGIN = 1.1
BUCKETS = 1 << 13
#: Trigrams of a text depend on each other: together they weigh as so many independent ones at most.
MOST_TRIGRAMS = 300
#: Rows that a suffix's (host's) counts need to weigh as much as those above them.
PRIOR_ROWS = 20.0
#: A row is rejected with fewer letter trigrams than this, or a smaller posterior of its language.
LEAST_TRIGRAMS, LEAST_POSTERIOR = 1, 0.5

# letters are bytes beyond ASCII and a-z; everything else is one kind of space
_LETTER = np.zeros(256, np.uint32)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_LETTER[0x41:0x5B] = np.arange(1, 27)
_LETTER[0x80:] = np.arange(27, 155)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of each text, and the bounds of each text in them.

    A trigram is three bytes around a letter, with everything that is no letter as a space.
    """
    n = len(data)
    code = np.zeros(n + 2, np.uint32)
    code[1:-1] = _LETTER[data]
    before, after = code[:-2].copy(), code[2:].copy()
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = 0
    after[edges - 1] = 0
    at = np.flatnonzero(code[1:-1])
    whole = (before[at] << 16) | (code[1:-1][at] << 8) | after[at]
    return ((whole * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64), np.searchsorted(at, bounds)


def _count_rows(languages: tuple[str, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        index = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            label = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, data, bounds in X.text_slices(batch.column(1)):
                bucket, first = trigrams(data, bounds)
                of = np.repeat(label[lo:hi], np.diff(first))
                known = of >= 0
                counts += np.bincount(of[known] * BUCKETS + bucket[known], minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])],
            ["l", "bucket", "n"],
        )

    return rows


def declared_languages(rows: DataFrame) -> tuple[str, ...]:
    """The languages that `rows` (declared) state, by name; LANGUAGES if they state none."""
    tags = rows.filter(F.col("declared").isNotNull() & (F.col("declared") != UNKNOWN)).select("declared").distinct()
    return tuple(sorted(r["declared"] for r in tags.collect())) or LANGUAGES  # tags of two or three letters


def trigram_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """log P(bucket | language) from all rows that declare one of `languages`; (languages x BUCKETS) numbers."""
    counted = rows.select("declared", "text").mapInArrow(given_back(_count_rows(languages)), "l int, bucket int, n long")
    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in counted.groupBy("l", "bucket").agg(F.sum("n").alias("n")).collect():  # at most languages x BUCKETS rows
        counts[r.l, r.bucket] += r.n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _score_rows(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            last = batch.num_columns - 1
            for lo, hi, data, bounds in X.text_slices(batch.column(last)):
                bucket, first = trigrams(data, bounds)
                n = np.diff(first)
                scores = np.zeros((hi - lo, len(table)))
                some = np.flatnonzero(n)
                if len(some):
                    for k, logs in enumerate(table):
                        scores[some, k] = np.add.reduceat(logs[bucket], first[some])
                scores *= np.minimum(1.0, MOST_TRIGRAMS / np.maximum(n, 1))[:, None]
                scores = pa.FixedSizeListArray.from_arrays(pa.array(scores.reshape(-1)), len(table))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(lo, hi - lo) for k in range(last)],
                        pa.array(n.astype(np.int64)),
                        scores.cast(pa.list_(pa.float64())),
                    ],
                    [*batch.schema.names[:last], "trigrams", "evidence"],
                )

    return rows


def _argmax(values: Column, names: tuple[str, ...]) -> Column:
    """Name of the largest of `values`; the first of equals."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(values, F.array_max(values)).cast("int"))


def primary_tag(tag: Column) -> Column:
    """`en` of `en-US`, `EN_us` and ` en `; null if there is none."""
    out = F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(out != "", out)


def host_suffix(host: Column) -> Column:
    """Last label of an address: `org` of `a.example.org`; null if it has no dot."""
    out = F.lower(F.regexp_extract(host, r"\.([A-Za-z][A-Za-z0-9-]*)\.?$", 1))
    return F.when(out != "", out)


def _counts(rows: DataFrame, keys: list[str], classes: tuple[str, ...]) -> DataFrame:
    sums = [F.sum((F.col("reads") == name).cast("double")) for name in classes]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("counts"))


def _smooth(counts: Column, above: Column) -> Column:
    """(counts + PRIOR_ROWS * above) / total, or `above` where there are no counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(
        F.zip_with(counts, above, lambda n, p: (n + F.lit(PRIOR_ROWS) * p) / (total + F.lit(PRIOR_ROWS))), above
    )


def identify(rows: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(id, language, posterior, text_language, declared, trigrams, kept) for rows (id, text, declared, host).

    `declared` is the language that the markup or the metadata states, `host` an
    address or source name. Any of them may be null: a missing piece of evidence
    weighs nothing. A text without letters (null, empty, digits or symbols) has
    no language (null), posterior 0, and is not kept. A text that is most
    probably in none of `languages` has none either; its posterior is that of the
    most probable language. `kept` also asks for a posterior of LEAST_POSTERIOR.
    Without `languages` they are the declared ones. Of equal posteriors the first
    language of `languages` wins. Every row gives one row; repeated rows give equal ones;
    an empty table gives an empty result.
    """
    spark = rows.sparkSession
    small_batches(spark)
    source = rows.select(
        F.col("id").cast("long").alias("id"),
        primary_tag(F.col("declared").cast("string")).alias("declared"),
        F.lower(F.col("host").cast("string")).alias("host"),
        F.col("text").cast("string").alias("text"),
    )
    languages = languages or declared_languages(source)
    classes = (*languages, UNKNOWN)
    chance = np.full((1, BUCKETS), -np.log(BUCKETS))
    model = spark.sparkContext.broadcast(np.vstack([trigram_model(source, languages), chance]))
    scored = source.mapInArrow(
        given_back(_score_rows(model)), "id long, declared string, host string, trigrams long, evidence array<double>"
    )
    scored = stored(
        scored.withColumn("reads", F.when(F.col("trigrams") > 0, _argmax(F.col("evidence"), classes))).withColumn(
            "suffix", host_suffix(F.col("host"))
        )
    )

    read = scored.filter("reads IS NOT NULL")
    totals = dict(read.groupBy("reads").count().collect())  # at most one row for each class
    everywhere = [totals.get(name, 0) + 1.0 for name in classes]
    everywhere = F.array(*[F.lit(n / sum(everywhere)) for n in everywhere])
    # one row for each pair of languages; other declared tags count as one kind
    said = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.lit(""))
    stated = {(r.said, r.reads): r.n for r in read.filter("declared IS NOT NULL").groupBy(said.alias("said"), "reads").agg(F.count("*").alias("n")).collect()}
    kinds = [*languages, ""]
    sums = {name: sum(stated.get((kind, name), 0) + 1.0 for kind in kinds) for name in classes}
    weights = [
        (kind, [float(np.log((stated.get((kind, name), 0) + 1.0) / sums[name])) for name in classes]) for kind in kinds
    ]
    weights = spark.createDataFrame(weights, "said string, weight array<double>")  # one row for each language
    scored = scored.withColumn("said", F.when(F.col("declared").isNotNull(), said)).join(F.broadcast(weights), "said", "left")
    weight = F.coalesce("weight", F.array(*[F.lit(0.0) for _ in classes]))

    by_suffix = _counts(read.filter("suffix IS NOT NULL"), ["suffix"], classes)
    by_suffix = by_suffix.select("suffix", _smooth(F.col("counts"), everywhere).alias("suffix_prior"))
    hosts = _counts(read.filter("host IS NOT NULL"), ["host"], classes).withColumn("suffix", host_suffix(F.col("host")))
    by_host = hosts.join(by_suffix, "suffix", "left").select(
        "host", _smooth(F.col("counts"), F.coalesce("suffix_prior", everywhere)).alias("prior")
    )
    joined = scored.join(by_host, "host", "left").withColumn("prior", F.coalesce("prior", everywhere))
    fused = F.zip_with(
        F.zip_with("evidence", weight, lambda a, b: a + b), F.col("prior"), lambda a, p: a + F.log(p)
    )
    trusted = F.when(F.col("said") != "", F.least(F.col("trigrams"), F.lit(MOST_TRIGRAMS)) * UNKNOWN_MARGIN).otherwise(0.0)
    unknown = F.element_at(fused, -1) - trusted
    fused = F.concat(F.slice(fused, 1, len(languages)), F.array(unknown))
    out = joined.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    total = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = out.withColumn("posterior", F.exp(F.array_max(F.slice("fused", 1, len(languages))) - F.col("top")) / total)
    some = F.col("trigrams") >= LEAST_TRIGRAMS
    return out.select(
        "id",
        F.when(some, F.nullif(_argmax(F.col("fused"), classes), F.lit(UNKNOWN))).alias("language"),
        F.when(some, F.col("posterior")).otherwise(0.0).alias("posterior"),
        F.nullif("reads", F.lit(UNKNOWN)).alias("text_language"),
        "declared",
        "trigrams",
        (some & (F.col("posterior") >= LEAST_POSTERIOR)).alias("kept"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """Rows for identify() from `documents`: the stated language and the source stand in for markup and host."""
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")
    )


def page_evidence(pages: DataFrame, text: Column) -> DataFrame:
    """Rows for identify() from `pages` (page_id, url, html); `text` is what a reader sees of the html."""
    tag = F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    return pages.select(
        F.col("page_id").alias("id"),
        text.alias("text"),
        tag.alias("declared"),
        F.expr("try_parse_url(url, 'HOST')").alias("host"),
    )


def drop_unidentified(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """`docs` without the rows whose language can't be told; same columns. Rows with a null id are judged by text alone."""
    uid = unused(docs, "uid")
    judged = docs.withColumn(uid, F.xxhash64("doc_id", "text", "lang", "source"))
    rows = judged.select(F.col(uid).alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    rejected = stored(identify(rows, languages).filter("NOT kept").select(F.col("id").alias(uid)).distinct())
    return judged.join(if_short(rejected), uid, "left_anti").select(*docs.columns)
