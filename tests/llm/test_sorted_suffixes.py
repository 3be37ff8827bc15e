"""The sorted suffix array of repeated passages: ranges, their ends, and grams that most suffixes share."""

from collections import Counter

import pytest
from churnlens.llm import repeats
from test_words_ops import brute_repeats, covered, spaced


def suffix_frame(spark, grams):
    rows = [(g, i % 3, i, i, -2, 0) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, repeats.SUFFIX.replace("long", "bigint"))


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_keep_all_shared_grams(spark, parts):
    grams = [5] * 400 + [k // 2 for k in range(100, 160)] + list(range(1000, 1300)) + [-(2**62)] * 2
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [tuple(r) for r in repeats.sorted_neighbours(suffix_frame(spark, grams)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    count = Counter(grams)
    want = {i for i, g in enumerate(grams) if count[g] > 1}
    kept = [r[2] for r in got]
    assert len(kept) == len(set(kept)) and want <= set(kept)
    # besides them only ends of ranges
    assert len(kept) - len(want) <= 2 * parts


def test_neighbours_over_small_batches(spark):
    import pyarrow as pa

    grams = [1, 1, 2, 3, 3, 3, 4, 5, 5, 6]
    whole = pa.RecordBatch.from_arrays([pa.array(grams), pa.array(range(10))], ["gram", "place"])
    for cuts in ([0, 10], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [0, 4, 4, 5, 10], [0, 2, 8, 10]):
        parts = (whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))
        out = [i for b in repeats._equal_neighbours(parts) for i in b.column(1).to_pylist()]
        assert out == [0, 1, 3, 4, 5, 7, 8, 9]  # 9 as the end of the range
    assert list(repeats._equal_neighbours(iter([]))) == []


def test_shared_start_with_many_contexts(spark):
    """A start that all texts share, too short to be a passage, between words of their own; and one real passage."""
    start = [f"s{k}" for k in range(45)]
    passage = [f"p{k}" for k in range(60)]
    rows = [(d, " ".join([f"l{d}x{k}" for k in range(30)] + start + [f"r{d}x{k}" for k in range(30)])) for d in range(60)]
    rows += [(100 + d, " ".join([f"a{d}"] * 3 + passage + [f"b{d}"] * 3)) for d in range(3)]
    rows += [(200, " ".join(start + passage))] * 2 + [(300, None), (301, ""), (302, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = df.select(repeats.text_uid().alias("uid"), "text").collect()
    want = brute_repeats([(r.uid, spaced(r.text)) for r in keyed])
    got = {r.uid: (covered(r.repeated), covered(r.cut)) for r in repeats.repeated_spans(df).collect()}
    assert got == want and len(got) == 4
