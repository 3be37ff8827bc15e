
import random
import re

import pytest

import corpus_pipeline
from churnlens.llm import langid, licenses, minhash
from churnlens.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_pipeline_links_from_a_similarity_of_four_fifths(spark):
    """104 words are 100 shingles; a changed word inside takes five of them, the last word one, the last but one two."""
    rows = []
    for d, changed in ((10, (30, 60)), (20, (30, 60, 103)), (30, (30, 60, 102)), (40, (30,))):  # 0.818, 0.802, 0.786, 0.905
        words = [f"f{d}w{k}" for k in range(104)]
        rows.append((d, " ".join(words)))
        rows.append((d + 1, " ".join("other" if k in changed else w for k, w in enumerate(words))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [10, 20, 30, 31, 40]
    # the contract of op4 stays at 0.85
    kept = minhash.near_duplicate_classes(df).filter("kept").collect()
    assert sorted(r.doc_id for r in kept) == [10, 11, 20, 21, 30, 31, 40]


OTHER_TEXTS = {
    "it": "La casa era piccola e vicino al fiume, dove ogni mattina i ragazzi andavano a giocare con il vecchio cane. Nessuno sapeva perché il signore della bottega avesse deciso di chiudere prima della fine dell'estate.",
    "pl": "Dom był mały i stał nad rzeką, gdzie każdego ranka chłopcy chodzili bawić się ze starym psem. Nikt nie wiedział, dlaczego właściciel sklepu postanowił zamknąć go przed końcem lata.",
    "ru": "Дом был маленький и стоял у реки, куда каждое утро мальчики ходили играть со старой собакой. Никто не знал, почему хозяин лавки решил закрыть её до конца лета.",
    "zh": "这所房子很小，靠近河边，每天早上男孩们都去那里和老狗玩耍。没有人知道店主为什么决定在夏天结束之前关门。",
    "noise": " ".join("".join(random.Random(k).choices("bcdfghjklmnpqrstvwxz", k=6)) for k in range(50)),
}


def test_texts_of_other_languages_and_letter_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(-1 - k, t, None, None) for k, t in enumerate(OTHER_TEXTS.values())], docs.schema)
    got = langid.identify(langid.document_evidence(docs.unionByName(more))).collect()
    assert {(r.language, r.kept) for r in got if r.id < 0} == {(None, False)} and all(r.kept for r in got if r.id >= 0)
    left = [r.doc_id for r in langid.drop_unidentified(docs.unionByName(more)).select("doc_id").collect()]
    assert len(left) == docs.count() and min(left) >= 0


def test_languages_are_the_declared_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(-1 - k, OTHER_TEXTS["it"], "it-IT", None) for k in range(3)], docs.schema)
    got = langid.identify(langid.document_evidence(docs.unionByName(more))).collect()
    assert {(r.language, r.text_language, r.kept) for r in got if r.id < 0} == {("it", "it", True)}


GPL_NOTICE = """Some tool of ours, and what it does in one line.

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


def test_licences_over_paragraphs_and_inside_lines(spark):
    inline = "A short text about cats and dogs that ends here. Released under the MIT License. And it goes on " + "and on " * 300
    two = "Before it all. " * 40 + licenses.TEMPLATES["Apache-2.0 header"] + " After it all, other words " + " ".join(f"w{k}" for k in range(90))
    again = "\n\n".join(["Licensed under the"] * 60 + ["MIT License."])
    rows = [(1, GPL_NOTICE), (2, BSD_NOTICE), (3, inline), (4, two), (5, "Released under the MIT License.\n\nok"), (6, again), (7, "no notice. " * 50)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.license))
    assert got[1] == {("sentences", "GPL-3.0 header")} and got[2] == {("sentences", "BSD-2-Clause text")}
    assert got[3] == {("sentences", "MIT")} and ("sentences", "Apache-2.0 header") in got[4]
    assert got[5] == {("line", "MIT")} and 7 not in got


def test_every_match_holds_a_marker():
    known = {name: licenses.template_bigrams(text) for name, text in licenses.TEMPLATES.items()}
    words = re.compile(licenses.markers(known, 0.8))
    for name, grams in known.items():
        without = [g for g in grams if not words.search(g)]
        assert 2 * len(without) / (len(grams) + len(without)) < 0.8, name
