"""Spelling variants, packing and source divergence against brute force."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from churnlens.llm import divergence, packing, spelling
from churnlens.llm.queries import op11_spelling_variants, op12_packing, op13_source_divergence
from churnlens.session import ship_package

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def given(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def odd_rows():
    """Nulls, empty, repeated, very long texts and words, ties."""
    rng = random.Random(11)
    stems = ["separate", "received", "calendar", "schönheit", "ÉTUDIANTE", "committee", "z" * 300, "x" * 40]
    rows = []
    for k in range(60):
        words = [rng.choice(stems[:6]) for _ in range(40)]
        for _ in range(4):
            w = rng.choice(stems)
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "é" + w[at + 1 :], w.upper()]))
        rows.append((k, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "ü"])))
    rows += [(7, None, "en", "a"), (7, "", "de", "only"), (None, "calendar calender 1separate-received", "en", "a")] * 2
    rows.append((1000, " ".join(rng.choice(stems) for _ in range(60_000)), "en", "b"))
    rows.append((1001, "\x00 ½ ___ 12 aa×bb÷cc " * 30, "zz", ""))
    return rows


# ---- op11


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    ends = defaultdict(set)  # one edit leaves the first three or the last three code points as they are
    for w in n:
        ends["first", w[:3]].add(w)
        ends["last", w[-3:]].add(w)
    out = {}
    for w in n:
        others = [x for x in ends["first", w[:3]] | ends["last", w[-3:]] if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, len(others))
    result = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.append((w, form, root, n[w], k, n[form] if form else None))
    return sorted(result)


def spelling_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_odd_rows(spark):
    rows = odd_rows()
    want = brute_spelling(rows)
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS).withColumnRenamed("n_chars", "word")
    assert spelling_rows(spelling.spelling_variants(docs)) == want
    # shards of few words, several parts of queries and of equal counts
    assert spelling_rows(spelling.spelling_variants(docs, most=3, part_queries=7)) == want
    assert any(r[1] for r in want) and any(len(r[0]) > 32 for r in want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_spelling_given_table(spark):
    want = brute_spelling(given(spark))
    assert spelling_rows(op11_spelling_variants(spark, SF)) == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert spelling_rows(spelling.spelling_variants(docs, most=40, part_queries=200)) == want


def test_spelling_chain(spark):
    texts = ["abcdefgh " * 2 + "abcdefgi " * 20 + "abcdefhi " * 200 + "bbcdefgh bbcdefgh "]
    rows = [(d, t, None, None) for d, t in zip(range(50, 51), texts)]
    got = spelling_rows(spelling.spelling_variants(spark.createDataFrame([(*r, 0) for r in rows], DOCS)))
    assert got == brute_spelling(rows)
    assert {r[0]: r[2] for r in got}["abcdefgh"] == "abcdefhi"


def test_equal_counts_in_parts():
    shards = spelling.Shards({bytes([1]): 5, bytes([2]): 1}, 3)
    assert list(shards.number.values()) == [0] and shards.children[b""] == [(1, b"\x01"), (2, b"\x02")]
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(300)} | {"a" * 40, "a" * 41})
    raw = [w.encode("latin-1") for w in words]
    pairs = np.array([(i, j) for i in range(len(raw)) for j in range(len(raw))])
    got = spelling.Verifier(raw).check(pairs[:, 0], pairs[:, 1])
    assert got.tolist() == [near(words[i], words[j]) for i, j in pairs]
    assert [spelling.one_edit(raw[i], raw[j]) for i, j in pairs] == got.tolist()


# ---- op12


def check_pieces(pieces, sizes, limits, loss=None):
    """Every token in one piece, sequences gapless, within limits, of full length or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, total, sequence, offset in pieces:
        assert length > 0
        by_doc[doc].append((start, length, total))
        by_sequence[sequence].append((offset, length, doc, start))
    assert set(by_doc) == {d for d, n in sizes.items() if n}
    for doc, parts in by_doc.items():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at and total == sizes[doc]
            at += length
        assert at == sizes[doc]
    for parts in by_sequence.values():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == limits.tokens or at & (at - 1) == 0
        assert at <= limits.tokens and len(parts) <= limits.segments
        if loss:
            assert sum(sum(loss[d][s : s + n]) for _, n, d, s in parts) <= limits.loss_tokens
    return by_sequence


def test_packing_given_table(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = given(spark)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t, _, _ in rows}
    got = op12_packing(spark, SF).collect()
    check_pieces([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in got], {d: len(x) for d, x in ids.items()}, packing.Limits())
    for r in got:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes())
    whole = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    for r in whole.collect():
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length]


def test_packing_limits(spark):
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        n = rng.choice([0, 1, 1, 3, 17, 200, 1023, 1024, 1025, 5000])
        share = rng.choice([0.0, 0.1, 0.9, 1.0])
        loss = None if rng.random() < 0.2 else [rng.random() < share for _ in range(n)]
        rows.append((k, [rng.randrange(50_000) for _ in range(n)], loss))
    rows.append((9000, None, None))
    frame = spark.createDataFrame(rows, "id long, ids array<int>, loss array<boolean>")
    limits = packing.Limits(1024, 8, 300)
    got = packing.pack(frame.coalesce(2), limits).collect()
    loss = {k: [True] * len(i or []) if b is None else b for k, i, b in rows}
    sequences = check_pieces([(r.id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in got], {k: len(i or []) for k, i, _ in rows}, limits, loss)
    ids = {k: i for k, i, _ in rows}
    assert all(r.ids == ids[r.id][r.start : r.start + r.length] for r in got) and len(sequences) > 100
    assert packing.pack(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame, packing.Limits(0, 1, 1))


def test_packing_odd_texts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    long = " ".join(f"word{k}  it's,\n x{k} über tail" for k in range(30_000))
    texts = [(1, None), (2, ""), (None, "a b"), (3, long), (4, "<|endoftext|> <|endoftext|>"), (5, "\x00\U0001f600 " * 50)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts], DOCS).withColumnRenamed("n_chars", "ids").coalesce(1)
    parts = packing.safe_parts(long)
    assert len(parts) > 3 and "".join(parts) == long and max(map(len, parts)) < packing.PART_CHARS + 100
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    back = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        back[r.doc_id] += r.ids
    assert dict(back) == want


def test_packing_other_tokenizer_file(spark):
    """A file that is not byte-level goes through its own library; the byte-level one gives that library's ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as spec:
        assert packing.byte_ranks(json.load(spec)) is None
    tokenizer = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(1, "Some words, here"), (2, "")], "doc_id long, text string")
    got = {(r.doc_id, r.start): r.ids for r in packing.pack_documents(docs.coalesce(1), path, end_id=1).collect()}
    want = [*tokenizer.encode("Some words, here", add_special_tokens=False).ids, 1]
    assert [i for (d, _), ids in sorted(got.items()) if d == 1 for i in ids] == want
    assert packing.byte_of_letter()["\u0120"] == 0x20


# ---- op13


def brute_divergence(rows):
    term = re.compile(b"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    times, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        found = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in term.findall((text or "").encode())]
        times[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= 10)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(sum((times[lang, s] for s in sources), Counter()))
        p = {s: shares(times[lang, s]) for s in sources}
        for s in sources:
            apart = {o: sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept) for o in sources if o != s}
            own = {t: (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]) for t in kept if times[lang, s][t] and p[s][t] > q[t]}
            own = {t.decode(): v for t, v in own.items()}
            for part, values, most in (("pair", apart, None), ("term", own, 10)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_given_table(spark):
    assert divergence_rows(op13_source_divergence(spark, SF)) == brute_divergence(given(spark))


def test_divergence_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    want = brute_divergence(rows)
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS).withColumnRenamed("n_chars", "term")
    assert divergence_rows(divergence.audit(docs)) == want
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 1)  # several blocks of sources
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 5)
    assert divergence_rows(divergence.audit(docs)) == want
    assert divergence.audit(docs.limit(0)).count() == 0
