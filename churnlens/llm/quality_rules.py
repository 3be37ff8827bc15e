"""Quality rules by distribution divergence, with DataFrame and SQL functions only.

A text's histogram of character classes and of common words is compared with
the mean histogram of its language by the Jensen-Shannon distance (base 2, so
between 0 and 1). References are grouped averages over all rows. Texts of fewer
than LEAST_WORDS words are too short for a divergence to mean anything: for
them, only the base rules count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.tables import stored

# Sixteen of the commonest words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "auf", "des", "für", "ist", "nicht", "dem"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con", "su", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui", "par", "dans"],
}

SPACE = " \t\n\x0b\x0c\r"
#: The characters that the base rules count as symbols.
SYMBOLS = "#*$%&|<>"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
OTHER_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in SYMBOLS)
#: Character classes: one letter stands for each member of a class; the rest (beyond ASCII, controls) is a class too.
CLASSES = {"a": LOWER, "A": UPPER, "0": DIGITS, " ": SPACE, "#": SYMBOLS, ".": OTHER_MARKS}

WINDOW = 5
LEAST_WORDS = 30
#: Distances beyond which a text is rejected.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.33, 0.5


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, counts...) for every row: the base rules' numbers and both histograms.

    Each step is a projection of its own, so that no array is built twice.
    """
    marked = F.translate("text", "".join(CLASSES.values()), "".join(k * len(v) for k, v in CLASSES.items()))
    language = F.lower(F.trim(F.col("lang").cast("string")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(language.isin(*COMMON_WORDS), language).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("doc_id", "lang", "text", F.length("text").cast("long").alias("n"), marked.alias("marked"))
    counts = [(F.col("n") - F.length(F.replace("marked", F.lit(k)))).cast("long") for k in CLASSES]
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    rows = rows.select(
        "doc_id",
        "lang",
        "n",
        F.array(*counts).alias("known"),
        lines.alias("lines"),
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
    )
    common = sorted({w for words in COMMON_WORDS.values() for w in words})
    rows = rows.select(
        "doc_id",
        "lang",
        F.concat("known", F.array(F.col("n") - F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + x))).alias("classes"),
        (F.col("n") - F.col("known")[list(CLASSES).index(" ")]).alias("word_chars"),
        F.col("known")[list(CLASSES).index("#")].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", lambda w: F.translate(w, UPPER, LOWER)), lambda w: w.isin(common)).alias("common"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
        ),
    )
    same = ["doc_id", "lang", "classes", "word_chars", "n_symbols", "n_dup_lines", "n_words"]
    rows = rows.select(*same, _word_counts(), windows.alias("windows"))
    others = F.col("n_words") - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    # only texts in which a window repeats go through the sort; the others have null here
    sorted_windows = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    rows = rows.select(*same, F.concat("found", F.array(others)).alias("words"), sorted_windows.alias("sorted"))
    same.append("words")
    repeated = F.transform(
        "sorted",
        lambda w, k: F.struct(
            w["i"].alias("i"),
            (
                F.coalesce(F.get("sorted", k - 1)["h"] == w["h"], F.lit(False))
                | F.coalesce(F.get("sorted", k + 1)["h"] == w["h"], F.lit(False))
            ).alias("again"),
        ),
    )
    places = F.array_sort(F.transform(F.filter(repeated, lambda w: w["again"]), lambda w: w["i"]))
    rows = rows.select(*same, places.alias("places"))
    # words under windows at the sorted places: WINDOW for the last, and no more than the gap for each other
    gaps = F.zip_with("places", F.slice("places", F.lit(2), F.size("places")), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda n, gap: n + F.coalesce(gap, F.lit(WINDOW)))
    return rows.select(*same, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _word_counts() -> Column:
    """How often each common word of the row's language stands in the text, and all other words together."""
    out = F.lit(None).cast("array<long>")
    for lang, words in COMMON_WORDS.items():
        counts = F.array(
            *[(F.size("common") - F.size(F.array_remove("common", w))).cast("long") for w in words],
        )
        out = F.when(F.col("lang") == lang, counts).otherwise(out)
    return out.alias("found")


def _share(counts: Column) -> Column:
    """Counts as shares of their sum; null if there is nothing to share."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, base 2) of two histograms; null if one is."""

    def part(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    # greatest() skips nulls
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))


def references(counted: DataFrame) -> DataFrame:
    """(lang, class_reference, word_reference): mean histograms of the rows of each language; lang null: of all others.

    At most one row for each language of COMMON_WORDS and one more.
    """
    shares = counted.filter(F.col("n_words") >= LEAST_WORDS).select(
        "lang", _share(F.col("classes")).alias("c"), _share(F.col("words")).alias("w")
    )
    n_words = len(next(iter(COMMON_WORDS.values()))) + 1
    return shares.groupBy("lang").agg(
        F.array(*[F.avg(F.get("c", F.lit(k))) for k in range(len(CLASSES) + 1)]).alias("class_reference"),
        F.array(*[F.avg(F.get("w", F.lit(k))) for k in range(n_words)]).alias("word_reference"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance).

    For rows (doc_id, text, lang); one result per row, repeated rows too. A null
    text has no words and fails the base rules. A language without a word list
    (or null) is compared by character classes only, with the rows alike. A
    distance is null where a histogram is empty or there is no reference; a
    null distance rejects nothing. An empty table gives an empty result.
    """
    counted = stored(base_counts(docs))
    # at most one row for each language and one more: bounded by COMMON_WORDS
    known = F.broadcast(references(counted).withColumnRenamed("lang", "of"))
    joined = counted.join(known, F.col("lang").eqNullSafe(F.col("of")), "left")
    long_enough = F.col("n_words") >= LEAST_WORDS
    rows = joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.when(long_enough, jensen_shannon(_share(F.col("classes")), F.col("class_reference"))).alias("class_distance"),
        F.when(long_enough, jensen_shannon(_share(F.col("words")), F.col("word_reference"))).alias("word_distance"),
    )
    far = F.coalesce(F.col("class_distance") > MOST_CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MOST_WORD_DISTANCE, F.lit(False)
    )
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )
