"""Licence scan: Dice coefficient over word bigrams, with DataFrame and SQL functions only.

Lines, paragraphs, runs of adjacent sentences and the whole of a text are normalised (A-Z lower-cased, runs of other
ASCII characters than letters and digits are one space) and compared with
licence templates: dice = 2 |A & B| / (|A| + |B|) over their sets of word
bigrams. A set of a bigrams can reach a coefficient t only with sets of
a t / (2 - t) to a (2 - t) / t bigrams; these bounds prune first segments, then
the templates that a segment is compared with. Texts without a word that every
match of some template has (`markers`) are left before all that.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices as they stand at the end or head of a file, and licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 short": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "all rights reserved": "Copyright. All rights reserved.",
}

#: ASCII characters that are neither letters nor digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Blank lines, and the gaps between sentences; a blank line ends a sentence.
BLANK = r"\n[ \t\r]*\n"
SENTENCE = r"(?<=[.!?])[\"')\]]*\s+|" + BLANK
#: Words that mark no licence: they stand in any text.
COMMON = frozenset("a all an and any as at be by copy following for from in is it not of on or person source that the this to under use with without work you".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\u0080-\U0010FFFF]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_bigrams(text: str) -> list[str]:
    words = _split(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def markers(known: dict[str, list[str]], threshold: float) -> str:
    """A pattern of words, one of which stands in every text that reaches `threshold` with a template.

    A match shares at least the lower size bound of the template's bigrams, so it meets any
    larger rest of them; the words, rare and long ones first, are taken until they are in such a rest.
    """
    words: set[str] = set()
    for _, grams in sorted(known.items(), key=lambda x: (len(x[1]), x[0])):
        rest = len(grams) - max(1, size_bounds(len(grams), threshold)[0]) + 1
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w not in words, w in COMMON, -len(w), w)):
            if sum(not words.isdisjoint(g.split()) for g in grams) >= rest:
                break
            words.add(word)
    return f"(?:^|{GAP[:-1]})(?:{'|'.join(sorted(words))})(?:$|{GAP[:-1]})"


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of the sets that can reach `threshold` with a set of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _keep(value: Column | str, condition) -> Column:
    """The value of the rows that meet the condition; the others are dropped.

    As a generator, so that the value is built once: a filter would be pushed
    below the projection and build it again, in a lambda even once per element.
    """
    return F.explode(F.filter(F.array(value), condition))


def _words(piece: Column) -> Column:
    return F.array_remove(F.split(piece, GAP), "")


def _bigrams(words: Column) -> Column:
    """Distinct bigrams; none of fewer than two words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def lines_and_paragraphs(rows: DataFrame, marked) -> DataFrame:
    """(doc_id, kind, segment, words): lines, and paragraphs of several lines, by their place in the text."""
    parts = []
    for kind, split in (("line", r"\n"), ("paragraph", BLANK)):
        pieces = rows.select("doc_id", F.posexplode(F.split("text", split)).alias("segment", "piece")).filter(marked(F.col("piece")))
        if kind == "paragraph":
            pieces = pieces.filter(F.contains("piece", F.lit("\n")))
        parts.append(pieces.select("doc_id", F.lit(kind).alias("kind"), F.col("segment").cast("long").alias("segment"), _words(F.col("piece")).alias("words")))
    return parts[0].unionByName(parts[1])


def runs_and_texts(rows: DataFrame, marked, most: int, longest: int) -> DataFrame:
    """(doc_id, kind, segment, words, inner, listed): runs of adjacent sentences of `longest` words at most, and longer texts.

    `inner` are the words of a run without its first and without its last sentence,
    `listed` those of the lines and paragraphs that may name the same licence.
    """
    pieces = F.filter(F.concat(F.split("text", r"\n"), F.split("text", BLANK)), marked)
    listed = F.filter(F.transform(F.array_distinct(pieces), _words), lambda w: F.size(F.array_distinct(w)) <= most + 1)
    units = F.transform(F.split("text", SENTENCE), lambda u: F.struct(_words(u).alias("w"), marked(u).alias("m")))
    rows = rows.select("doc_id", listed.alias("listed"), _keep(units, lambda u: F.size(u) > 0).alias("units"))
    rows = rows.select("doc_id", "listed", _keep(F.filter("units", lambda u: F.size(u["w"]) > 0), lambda u: F.size(u) > 0).alias("units"))
    none = F.array().cast("array<array<string>>")
    total = F.aggregate("units", F.lit(0), lambda a, u: a + F.size(u["w"]))
    texts = rows.filter(total > longest).select(
        "doc_id", F.lit("text").alias("kind"), F.lit(0).cast("long").alias("segment"),
        F.flatten(F.transform("units", lambda u: u["w"])).alias("words"), none.alias("inner"), "listed",
    )
    # every run holds a sentence with a marker: it is built around the first of them
    at = F.filter(F.transform("units", lambda u, i: F.when(u["m"], i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "listed", "units", at.alias("marks"))
    # the lists that are exploded are made by lambdas: rows then go on one by one, while generated code holds all of an input row's
    low = lambda at, k: F.greatest(F.coalesce(F.get("marks", k - 1) + 1, F.lit(0)), at - longest)
    mark = F.explode(F.transform("marks", lambda at, k: F.struct(at.alias("at"), low(at, k).alias("low"))))
    rows = rows.select("doc_id", "listed", "units", mark.alias("m")).select("doc_id", "listed", "units", "m.at", "m.low")

    def fit(units: Column) -> Column:
        """The first of the units that have `longest` words together at most."""
        start = F.struct(F.lit(0).alias("t"), F.lit(0).alias("n"))
        step = lambda a, w: F.struct((a["t"] + F.size(w)).alias("t"), (a["n"] + (a["t"] + F.size(w) <= longest).cast("int")).alias("n"))
        return F.slice(units, F.lit(1), F.aggregate(units, start, step)["n"])

    side = lambda start, n: F.transform(F.slice("units", start, n), lambda u: u["w"])
    before, after = F.reverse(side(F.col("low") + 1, F.col("at") - F.col("low"))), side(F.col("at") + 1, F.lit(longest))
    rows = rows.select("doc_id", "listed", "at", _keep(F.struct(fit(before).alias("b"), fit(after).alias("a")), lambda x: F.size(x["a"]) > 0).alias("x"))
    some = F.transform(F.sequence(F.lit(0), F.size("x.b")), lambda i: i)
    rows = rows.select("doc_id", "listed", "at", "x", F.explode(some).alias("i"))
    run = lambda j: F.concat(F.reverse(F.slice("x.b", F.lit(1), F.col("i"))), F.slice("x.a", F.lit(1), j))
    short = lambda r: F.aggregate(r, F.lit(0), lambda n, w: n + F.size(w)) <= longest
    runs = F.filter(F.transform(F.sequence(F.lit(1), F.size("x.a")), run), short)
    rows = rows.select("doc_id", "listed", (F.col("at") - F.col("i")).cast("long").alias("segment"), F.explode(runs).alias("run"))
    n = F.size("run")
    inner = F.when(n > 1, F.array(F.flatten(F.slice("run", F.lit(2), n - 1)), F.flatten(F.slice("run", F.lit(1), n - 1)))).otherwise(none)
    runs = rows.select("doc_id", F.lit("sentences").alias("kind"), "segment", F.flatten("run").alias("words"), inner.alias("inner"), "listed")
    return runs.unionByName(texts)


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, kind, segment, license, n_bigrams, n_shared, dice) for every segment that matches.

    Of several templates the one with the largest coefficient is named, of
    equals the first by name. `kind` is line, paragraph, sentences (a run of
    adjacent sentences, over blank lines too, with as many words as the size
    bounds give the longest template) or text (a whole text of more words).
    `segment` counts lines (paragraphs; sentences with words, for the first of a
    run) from 0. A run is left out if it is as near to its template without its
    first or last sentence; runs and texts are left out if a line or paragraph
    that holds their words, or that they hold, reaches the same template. Null
    and empty texts have no match; repeated rows give repeated results; an
    empty table gives an empty result. Templates of one word match nothing.
    """
    known = {name: grams for name, text in (templates or TEMPLATES).items() if (grams := template_bigrams(text))}
    bounds = {name: size_bounds(len(grams), threshold) for name, grams in known.items()}
    least, most = min(lo for lo, _ in bounds.values()), max(hi for _, hi in bounds.values())
    longest = max(len(_split(text)) for text in (templates or TEMPLATES).values())
    longest = math.floor(longest * (2 - threshold) / threshold)
    pattern = markers(known, threshold)
    marked = lambda piece: piece.rlike(pattern)
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _keep(text, marked).alias("text"))
    none = F.array().cast("array<array<string>>")
    rows = lines_and_paragraphs(source, marked).select("*", none.alias("inner"), none.alias("listed"))
    rows = rows.unionByName(runs_and_texts(source, marked, most, longest))
    # n distinct words make n - 1 distinct bigrams at least: long segments go before their bigrams are built
    fits = lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) <= most + 1)
    rows = rows.select("doc_id", "kind", "segment", "inner", "listed", _keep("words", fits).alias("words"))
    grams = _keep(_bigrams(F.col("words")), lambda g: F.size(g).between(least, most))
    rows = rows.select("doc_id", "kind", "segment", "words", "inner", "listed", grams.alias("grams"))
    rows = rows.select("doc_id", "kind", "segment", "words", "inner", "listed", "grams", F.size("grams").alias("n"))
    shared = {
        name: F.when(F.col("n").between(*bounds[name]), F.size(F.array_intersect("grams", F.array(*map(F.lit, known[name])))))
        for name in sorted(known)
    }
    rows = rows.select("doc_id", "kind", "segment", "words", "inner", "listed", "n", F.array(*shared.values()).alias("shared"))
    sizes = F.array(*[F.lit(len(known[name])) for name in shared])
    # ordered by coefficient, then by name: the place is negative so that the first of equals is the largest
    matches = F.zip_with("shared", sizes, lambda c, a: F.struct((2.0 * c / (a + F.col("n"))).alias("dice"), c.alias("c")))
    matches = F.transform(matches, lambda m, k: F.struct(m["dice"].alias("dice"), (-k).alias("place"), m["c"].alias("c")))
    best = F.array_max(F.filter(matches, lambda m: m["dice"] >= threshold))
    rows = rows.select("doc_id", "kind", "segment", "words", "inner", "listed", "n", _keep(best, lambda m: m.isNotNull()).alias("best"))
    # few rows are left: a run or text has to add something to what is listed besides it
    template = F.element_at(F.array(*[F.array(*map(F.lit, known[name])) for name in shared]), 1 - F.col("best.place"))

    def reached(words: Column) -> Column:
        own = _bigrams(words)
        return 2.0 * F.size(F.array_intersect(own, template)) / (F.size(own) + F.size(template))

    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    mine = spaced(F.col("words"))
    same = F.exists("listed", lambda w: (F.contains(mine, spaced(w)) | F.contains(spaced(w), mine)) & (reached(w) >= threshold))
    rows = rows.filter(~F.exists("inner", lambda w: reached(w) >= F.col("best.dice")) & ~same)
    return rows.select(
        "doc_id",
        "kind",
        "segment",
        F.element_at(F.array(*map(F.lit, shared)), 1 - F.col("best.place")).alias("license"),
        F.col("n").cast("long").alias("n_bigrams"),
        F.col("best.c").cast("long").alias("n_shared"),
        F.col("best.dice").alias("dice"),
    )
