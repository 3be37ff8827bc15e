"""Operators on whole texts: licences, BPE, HTML, chat, quality rules, quality classifier."""

import hashlib
import json
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from churnlens.llm import bpe, chat, html_text, licenses, quality_model, quality_rules
from churnlens.session import ship_package

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


# --- licences -------------------------------------------------------------------------------------------------------


def brute_licenses(rows, threshold=0.8):
    norm = lambda t: [w for w in re.split(licenses.GAP, t.translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if w]
    grams = lambda t: {f"{a} {b}" for a, b in zip(norm(t), norm(t)[1:])}
    known = {name: grams(t) for name, t in licenses.TEMPLATES.items()}
    out = []
    for d, text in rows:
        parts = [("line", k, s) for k, s in enumerate((text or "").split("\n"))]
        parts += [("paragraph", k, s) for k, s in enumerate(re.split(r"\n[ \t\r]*\n", text or "")) if "\n" in s]
        for kind, k, part in parts:
            g = grams(part)
            best = max(((2 * len(g & a) / (len(g) + len(a)), [-ord(c) for c in name], name, len(g & a)) for name, a in known.items() if g), default=None)
            if best and best[0] >= threshold:
                ties = sorted(n for n, a in known.items() if 2 * len(g & a) / (len(g) + len(a)) == best[0])
                out.append((d, kind, k, ties[0], len(g), len(g & known[ties[0]]), round(best[0], 12)))
    return sorted(out, key=str)


def license_rows(df):
    return sorted([(*tuple(r)[:6], round(r.dice, 12)) for r in licenses.scan(df).collect()], key=str)


def test_licenses(spark):
    rows = [
        (1, None), (2, ""), (3, "The MIT License\n\nRELEASED under (the) MIT-License!\nfoo"), (4, "word"), (5, "x\n" * 3000),
        (None, "a\n" + licenses.TEMPLATES["MIT text"].replace(", ", ",\n") + "\n \n" + licenses.TEMPLATES["GPL-3.0"]),
        (6, licenses.TEMPLATES["CC-BY-SA-4.0"]), (6, licenses.TEMPLATES["CC-BY-SA-4.0"]), (7, "the same words " * 20000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert license_rows(df) == brute_licenses(rows) and len(brute_licenses(rows)) >= 5
    assert license_rows(df.limit(0)) == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert license_rows(docs) == brute_licenses([(r.doc_id, r.text) for r in docs.collect()])


# --- byte-level BPE -------------------------------------------------------------------------------------------------


def test_perfect_hash_is_minimal(vocab):
    assert sorted(vocab.hash.slot.tolist()) == list(range(len(vocab.ranks)))
    strangers = bpe.bytes_hashes(*bpe._flat([b"nosuchtokenatall%d" % k for k in range(5000)]))
    assert (vocab.hash.lookup(strangers) < 0).all()


def test_encode_like_tiktoken(vocab, reference):
    rng = random.Random(3)
    odd = ["", " ", "\n\n  \n", "don't I'LL we've", "a" * 3000, "ab" * 2000 + " " * 500, "é" * 999, "\u0000\u001c\u0085\u200b\u3000x 1²½"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(60))) for _ in range(400)]
    ids, bounds = vocab.encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [reference.encode_ordinary(t) for t in odd]
    data, ends = vocab.decode(ids, bounds)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == odd


def test_token_digests(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (None, ""), (-2, "x y"), (-2, "x y")], "doc_id long, text string"))
    got = Counter(tuple(r) for r in bpe.token_digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect())
    want = Counter()
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[(r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert got == want
    coded = bpe.encode(docs.selectExpr("doc_id", "text", "1 AS ids", "'z' AS decoded"), VOCABULARY, public_tokenizers.PATTERN)
    back = bpe.decode(coded, VOCABULARY, public_tokenizers.PATTERN)
    assert back.filter("decode(decoded, 'UTF-8') <> coalesce(text, '')").count() == 0
    assert bpe.token_digests(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


# --- HTML -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &lt;text&gt; <", "plain <text> <"), ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a <b>b</b> c</div>d", "a b c\nd"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<p>x<div>y</div>z", "x\n\ny\nz"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>end", "* a\n* b\n  3. c\n\nend"),
        ("<table><tr><th>A<th>Long<tr><td>12<td>3<br>4</table>", "A   Long\n12  3\n    4"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab     c\n1   2  3"),
        ("<title>t</title><script>if (a<b) '</p>'</script><style>p{}</style>s", "s"),
        ("<div hidden>no</div><p style='x:y; DISPLAY : none'>no<p>yes", "yes"), ("<!-- a > b --><pre> x\n  y</pre>", " x\n  y"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("<p>un<b>closed <i>x<p>next</i>", "unclosed x\n\nnext"), ("a</div></p>b", "ab"),
        ("<a title='x>y'>l</a> <img alt=no>r", "l r"), ("<b " + "a" * 50, "<b " + "a" * 50),
    ],
)
def test_visible_text(page, text):
    assert html_text.visible_text(page) == text


def test_deep_and_long_pages():
    assert html_text.visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_text.visible_text("<p>" + "word " * 50000).count("word") == 50000


def test_extract_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("*", "1 AS visible_text")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and all(r.visible_text == html_text.visible_text(r.html) for r in got)
    body = re.compile(r"<p>([^<>&]{20,})</p>")
    for r in got:
        assert "track(" not in r.visible_text
        for m in body.findall(r.html):
            assert " ".join(m.split()) in r.visible_text
    assert html_text.extract(pages.limit(0)).count() == 0


# --- chat -----------------------------------------------------------------------------------------------------------


def test_layouts_give_the_same_turns(spark):
    same = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}], "id": 5},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a", "meta": {"x": [1]}}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
    ]
    rows = [json.dumps(x) for x in same] + [None, "", "{", "[1]", '{"what": 1}']
    df = spark.createDataFrame([(k, r, "clash") for k, r in enumerate(rows)], "id int, record string, turns string")
    got = {r.id: r.turns for r in chat.to_turns(df).collect()}
    for k in range(len(same)):
        assert [tuple(t) for t in got[k]] == [("user", "q"), ("assistant", "a")]
    assert all(got[k] is None for k in range(len(same), len(rows)))


def test_escapes_are_reversible():
    for text in ["", "\\", "\\\\### x </turn>", "### Assistant: </turn> ok", "####\\#</turn>\n </turn>\n", "\\</turn>", "a\n### user: b </turn>\n"]:
        assert chat.unescape(chat.escape(text)) == text
        turns = [{"role": "a:b\\", "text": text}, {"role": "assistant", "text": text}, {"role": "", "text": ""}]
        out, spans = chat.write_turns(turns)
        assert chat.read_turns(out) == [(t["role"], t["text"]) for t in turns]
        assert [chat.unescape(out[s["start"] : s["end"]]) for s in spans] == [text]


def test_conversation_digests(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 1, "assistant", None), (-1, 0, "user", "é </turn>"), (-2, 0, None, "x"), (None, 0, "assistant", "\\### "), (-3, 0, "assistant", "a"), (-3, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(chat.table_records(df))
    got = {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(out).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, r, t in sorted(((n, r, t) for c, n, r, t in rows if c == conv), key=lambda x: x[0])]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert {k: v[:4] for k, v in got.items()} == want
    assert chat.conversation_digests(chat.format_conversations(chat.table_records(df.limit(0)))).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(again)


def test_quality_rules(spark):
    rng = random.Random(2)
    odd = [
        (-1, None, "en"), (-2, "", None), (-3, "a b c d e a b c d e", "xx"), (-4, "x\nx\n \n\nx y", "FR "), (-4, "x\nx\n \n\nx y", "FR "),
        (-5, "one\x0btwo\x0cthree é€ #*$", "de"), (None, " ".join(rng.choice("abc") for _ in range(20000)), "en"),
        (-6, "THE AND OF!! " * 40, "en"), (-7, "the and of to a in " + " ".join(f"w{k}" for k in range(80)), "en"),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    got = quality_rules.judge(df).collect()
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *[r[n] for n in numbers]) for r in got) == Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
        for d in (r.class_distance, r.word_distance):
            assert d is None or 0 <= d <= 1
        assert (r.class_distance is None) == (r.n_words < quality_rules.LEAST_WORDS)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r for r in got if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good) > 0
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(-1, None), (-2, ""), (None, "the and of it"), (-3, "x " * 30000)], "doc_id long, text string")
    got = quality_model.score(docs.select("doc_id", "text").unionByName(more), labels).collect()
    assert len(got) == docs.count() + 4 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) >= 0.95 * len(test) > 0
    flat = quality_model.score(more, labels.limit(0)).collect()
    assert {r.score for r in flat} == {0.5}
    assert quality_model.score(docs.limit(0), labels).count() == 0
