"""Operators on words and shingles against brute force: near-dedup, repeats, decontamination, language ID."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from churnlens.llm import decontaminate, langid, minhash, repeats
from churnlens.llm import text as X
from churnlens.llm.components import connected_components
from churnlens.session import ship_package

SF = "/root/testdata/sf0.001"
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def spaced(text, lower=False):
    raw = (text or "").encode()
    return SPACED.findall(raw.translate(LOWER) if lower else raw)


def alnum(text):
    return ALNUM.findall((text or "").encode().translate(LOWER))


def odd_docs(spark):
    """Nulls, empty, blank, short, very long, repeated and near rows."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    near = list(base)
    near[200] = "other"
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(60_000))
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, "  ".join(base).upper()), (4, None), (5, ""), (6, " \n\t "),
        (7, "three short words"), (8, "Three  short WORDS"), (9, "three short words here and"), (10, long),
        (11, long + " tail"), (None, "three short words"), (12, " ".join(base[:60] + [str(i) for i in range(90)])),
        (12, " ".join(base[:60] + [str(i) for i in range(90)])), (13, "a " * 300), (14, "a " * 120),
    ]
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts], DOCS)


def test_words_and_hashes():
    texts = ["Hello  wörld\tfoo", None, "", " a b", "x" * 9 + " b", "foo Hello"]
    got = []
    for lo, hi, data, bounds in X.text_slices(pa.array(texts), 8):
        w = X.find_words(data, bounds, X.SPACED)
        for d in range(hi - lo):
            part = slice(w.first[d], w.first[d + 1])
            got.append([bytes(data[s:e]) for s, e in zip(w.start[part], w.end[part])])
    assert got == [spaced(t) for t in texts]
    raw = np.frombuffer(b"foo bar foo bar foo", np.uint8)
    h = X.find_words(raw, np.array([0, len(raw)]), X.SPACED).hash
    grams = X.gram_hashes(h, 2)
    assert h[0] == h[2] != h[1] and grams[0] == grams[2] != grams[1] == grams[3]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (7, None), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(rows, num=85, den=100):
    sets = {}
    for d, t in rows:
        w = spaced(t, lower=True)
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(s)
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    by_shingle = defaultdict(set)
    for d in ids:
        for s in sets[d]:
            for x in s:
                by_shingle[x].add(d)
    for d in ids:
        for s in sets[d]:
            for o in {o for x in s for o in by_shingle[x] if o < d}:
                if any(den * len(s & p) >= num * len(s | p) for p in sets[o]):
                    a, b = find(d), find(o)
                    root[max(a, b)] = min(a, b)
    return sorted(
        ((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, many in sets.items() for s in many), key=str
    )


def near_rows(df):
    return sorted([tuple(r) for r in minhash.near_duplicate_classes(df).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def test_near_duplicates_odd_rows(spark):
    df = odd_docs(spark)
    assert near_rows(df) == brute_near([(r.doc_id, r.text) for r in df.collect()])
    assert near_rows(df.limit(0)) == []
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted([r.doc_id for r in kept.collect()], key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 9, 10, 12, 13, None], key=str)


def test_near_duplicates_of_a_chain_whose_hub_is_not_the_smallest(spark):
    """Edited copies of one text: linked to it, not to each other; more members than a block holds."""
    rng = random.Random(1)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for d in range(330):
        words = list(base)
        for place in rng.sample(range(0, 200, 6), 3):
            words[place] = f"e{d}x{place}"
        rows.append((d, " ".join(words)))
    rows.append((1000, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(df) == brute_near(rows)


def brute_repeats(rows, size=50):
    """(repeated, cut) word sets of each row (uid, words), by counting all windows."""
    seen = defaultdict(list)
    for uid, w in rows:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])].append((uid, i))
    again, later, first = defaultdict(set), defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for uid, i in set(places):
                span = set(range(i, i + size))
                again[uid] |= span
                (first if (uid, i) == min(places) else later)[uid] |= span
    return {uid: (words, later[uid] - first[uid]) for uid, words in again.items()}


def covered(spans):
    return {i for s in spans for i in range(s.start, s.end)}


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_repeats(spark, which):
    df = odd_docs(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    keyed = df.select(repeats.text_uid().alias("uid"), "text").collect()
    want = brute_repeats([(r.uid, spaced(r.text)) for r in keyed])
    got = {r.uid: (covered(r.repeated), covered(r.cut)) for r in repeats.repeated_spans(df).collect()}
    assert got == want and len(want) > 2
    cut = repeats.cut_repeats(df)
    assert cut.schema == df.schema
    expected = Counter(tuple(w for i, w in enumerate(spaced(r.text)) if i not in want.get(r.uid, ((), ()))[1]) for r in keyed)
    assert Counter(tuple(spaced(r.text)) for r in cut.collect()) == expected
    assert repeats.repeated_spans(df.limit(0)).count() == 0


def brute_hits(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        n = min(len(w), size)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        listed = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def hit_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("block_words", [10**6, 2])
def test_contamination_odd_rows(spark, block_words):
    docs = [
        (1, "a b c d The"), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten eleven TWELVE"),
        (None, "the x"), (5, "the the the THE"), (5, "the the the THE"), (6, "x foo-bar y foo"), (7, "é1 ü " * 20),
    ]
    items = [
        (1, "the"), (2, "foo bar"), (3, None), (4, ""), (5, "two three four five six seven eight nine ten eleven"),
        (7, "nine ten eleven twelve"), (10, "É1 é1 ü é1 ü é1 ü é1 ü é1 ü é1"), (9, "the"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([*items, (None, "a")], "item_id long, text string")
    assert hit_rows(decontaminate.contamination(d, i, block_words=block_words)) == brute_hits(docs, items)
    clean = decontaminate.drop_contaminated(d, i, block_words=block_words)
    assert sorted([r.doc_id for r in clean.collect()]) == [2, 3] and clean.columns == d.columns
    assert decontaminate.contamination(d.limit(0), i).count() == 0
    assert decontaminate.contamination(d, i.limit(0)).filter("contaminated").count() == 0


def test_contamination_of_the_tables(spark):
    d, i = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_hits([(r.doc_id, r.text) for r in d.collect()], [tuple(r) for r in i.select("item_id", "text").collect()])
    assert hit_rows(decontaminate.contamination(d, i)) == want and any(r[5] for r in want)


def test_longest_matches_and_places(spark):
    item = " ".join(f"q{k}" for k in range(30))
    d = spark.createDataFrame([(1, "lead in " + " ".join(f"q{k}" for k in range(4, 25)) + " out")], "doc_id long, text string")
    row = decontaminate.verbatim_matches(d, spark.createDataFrame([(8, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in row.matches] == [(8, 2, 4, 21)]


def test_language_odd_rows(spark):
    rows = [
        (1, None, None, None), (2, "", "en", "a.b.org"), (3, "12 %", "fr", None), (None, "der die das und nicht", None, "x"),
        (4, "the and of", "en-US", "h.org"), (4, "the and of", "en-US", "h.org"), (5, "le la les des", "FR", "h.org"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.identify(langid.document_evidence(df)).collect()
    assert len(got) == len(rows)
    assert {(r.id, r.language, r.kept) for r in got if r.id in (1, 2, 3)} == {(k, None, False) for k in (1, 2, 3)}
    assert {r.language for r in got if r.id == 4} == {"en"} and {r.language for r in got if r.id == 5} == {"fr"}
    assert sorted(map(str, (r.doc_id for r in langid.drop_unidentified(df).collect()))) == ["4", "4", "5", "None"]
    assert langid.identify(langid.document_evidence(df.limit(0))).count() == 0


def test_language_of_the_tables_and_of_wrong_labels(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(langid.document_evidence(d)).collect()
    assert len(got) == d.count() and sum(r.language == r.declared and r.kept for r in got) >= 0.99 * len(got)
    # one in ten declares a wrong language: the text outvotes it
    wrong = d.selectExpr("doc_id", "text", "CASE WHEN doc_id % 10 = 3 THEN 'es' ELSE lang END AS lang", "source", "lang AS is")
    truth = {r.doc_id: r["is"] for r in wrong.collect()}
    found = langid.identify(langid.document_evidence(wrong)).collect()
    assert sum(r.language == truth[r.id] for r in found) >= 0.97 * len(found)
