"""Ranks, prefix sums, AUC, bands and quantiles over ranges: skewed values, ties, nulls, empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import evaluate as EV
from churnlens.operators import features as FE
from churnlens.operators import ordering as OR


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows, nine in ten with the same value, some nulls."""
    value = F.when(F.col("id") % 10 > 0, 0.5).when(F.col("id") % 500 == 0, None).otherwise(F.rand(3))
    y = (F.rand(4) < F.coalesce("v", F.lit(0.1))).cast("int")
    return spark.range(20_000).withColumn("v", value).withColumn("y", y).checkpoint()


def test_ranks_of_a_table_with_one_heavy_value(spark, skewed):
    ranked = OR.global_rank(skewed, "v", parts=16)
    rows = ranked.select("v", "rank").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 20_001))
    order = [r.v for r in sorted(rows, key=lambda r: r["rank"])]
    known = [v for v in order if v is not None]
    assert known == sorted(known) and order[: len(known)] == known  # nulls last
    # the heavy value is split: no range holds more than twice the median
    ranges = skewed.repartitionByRange(16, F.asc_nulls_last("v"), F.xxhash64("id", "v", "y"))
    sizes = sorted(Counter(r[0] for r in ranges.select(F.spark_partition_id()).collect()).values())
    assert len(sizes) >= 15 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert OR.global_rank(skewed.limit(0), "v").count() == 0


def test_prefix_sums(spark, skewed):
    weighed = skewed.withColumn("w", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5))
    rows = OR.prefix_sums(weighed, [F.asc_nulls_first("v"), F.col("id")], "w", 16).collect()
    assert len(rows) == 20_000
    total = 0
    for r in sorted(rows, key=lambda r: (r.v is not None, r.v or 0.0, r.id)):
        assert r.before == total
        total += r.w or 0
    assert OR.prefix_sums(weighed.limit(0), ["v"], "w").count() == 0


def test_auc_with_ties(spark, skewed):
    known = skewed.filter("v IS NOT NULL")
    got = known.select(EV.auc_value(known, "v", "y", 16)).first()[0]
    rows = known.select("v", "y").toPandas()
    ranks = rows.v.rank().to_numpy()
    p = rows.y.sum()
    want = (ranks[rows.y == 1].sum() - p * (p + 1) / 2) / (p * (len(rows) - p))
    assert abs(got - want) < 1e-12


def test_quantile_equals_percentile(spark, skewed):
    frames = [skewed, spark.range(200_000).select(F.rand(1).alias("v")), skewed.filter("v <> 0.5").limit(1), skewed.limit(2)]
    for df in frames:
        for q in (0.0, 0.25, 0.75, 0.9999, 1.0):
            assert OR.exact_quantile(df, "v", q) == df.agg(F.percentile("v", q)).first()[0]
    assert OR.exact_quantile(skewed.limit(0), "v", 0.5) is None
    money = skewed.select(F.col("v").alias("MonthlyCharges"))
    flags = [FE.HighValueThreshold(unbounded=u).flag(money).alias("f") for u in (False, True)]
    assert [money.select(f).groupBy("f").count().orderBy("f").collect() for f in flags][0] == money.select(flags[1]).groupBy("f").count().orderBy("f").collect()


def test_bands_of_many_groups(spark):
    df = spark.range(3_000).select((F.col("id") % 40).cast("string").alias("g"), F.col("id").cast("string").alias("k"))
    df = df.withColumn("g", F.when(F.col("g") != "7", F.col("g")))
    order = F.md5(F.concat(F.lit("s:"), "k"))
    got = OR.hash_bands(df, "g", order, "k", OR.equal_folds(3), "fold")
    want = {}
    groups = {}
    for r in df.withColumn("o", order).collect():
        groups.setdefault(r.g, []).append((r.o, r.k))
    for g, rows in groups.items():
        cuts = OR.equal_folds(3)(len(rows))
        for rank, (_, k) in enumerate(sorted(rows)):
            want[k] = sum(cut <= rank for cut in cuts)
    assert {r.k: r.fold for r in got.collect()} == want and len(want) == 3_000
    assert np.unique(list(want.values())).tolist() == [0, 1, 2]
