"""corpus_pipeline.run() against the stages by brute force, and the registered queries."""

from collections import Counter

import public_tokenizers
import tiktoken

import __spark_entry__ as E
import corpus_pipeline
from churnlens.llm import bpe, repeats
from test_words_ops import alnum, brute_hits, brute_near, brute_repeats, spaced

SF = "/root/testdata/sf0.001"


def test_names_and_stages():
    names = list(E.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, r.text) for r in docs if any(c.isalpha() for c in r.text or "")]
    kept = {d for d, _, _, keep in brute_near(rows, 80) if keep}
    rows = [(d, t) for d, t in rows if d in kept]
    uid = {
        r.doc_id: r.uid
        for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", repeats.text_uid().alias("uid")).collect()
    }
    found = brute_repeats([(uid[d], spaced(t)) for d, t in rows])
    cut = {d: [w for i, w in enumerate(spaced(t)) if i not in found.get(uid[d], ((), ()))[1]] for d, t in rows}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    hits = brute_hits([(d, b" ".join(w).decode()) for d, w in cut.items()], items)
    clean = {r[0] for r in hits if not r[5]}
    assert set(got) == clean and len(clean) < len(rows) < len(docs)
    enc = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY),
        special_tokens={},
    )
    for d, r in got.items():
        assert spaced(r.text) == cut[d] and r.ids == enc.encode_ordinary(r.text) and r.n_tokens == len(r.ids)
    assert Counter(map(type, got)) == Counter({int: len(got)}) and alnum("A b") == [b"a", b"b"]
