"""Spread of feature impacts from mergeable sketches: exact parts, rank error, merging, empty input."""

import numpy as np
import pytest
from churnlens.operators import explain as EX
from pyspark.sql import functions as F

SHARES = dict(zip(("q1_impact", "median_impact", "q3_impact"), EX.QUANTILES))


class Given:
    """An explainer whose impacts are columns of the table."""

    def __init__(self, *names):
        self.names = names

    def contributions(self):
        rows = [
            F.struct(F.lit(i).alias("idx"), F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(c).alias("impact"))
            for i, c in enumerate(self.names)
        ]
        return F.array(*rows)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two features over 120,000 customers: a long tail, and one with 90 % equal values and some nulls."""
    df = spark.range(120_000, numPartitions=6).select(
        F.col("id").alias("customerID"),
        F.exp(F.randn(3) * 2).alias("tail"),
        F.when(F.col("id") % 10 > 0, F.lit(0.25)).when(F.col("id") % 100 > 0, F.rand(5) - 0.5).alias("tied"),
    )
    return df.checkpoint()


def rank_range(values, v):
    """Share of values below v, and at or below it."""
    return np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)


@pytest.mark.parametrize("k, error", [(200, 0.02), (2048, 0.003)])
def test_quantiles_within_rank_error(skewed, k, error):
    explainer = Given("tail", "tied")
    whole = EX.impact_states(skewed, explainer, "customerID", k)
    thirds = [EX.impact_states(skewed.filter(F.col("customerID") % 3 == r), explainer, "customerID", k) for r in range(3)]
    merged = EX.merge_states(thirds[0].unionByName(thirds[1]).unionByName(thirds[2]))
    for states in (whole, merged):
        rows = {r.feature: r for r in EX.importance_distribution(states, 12).collect()}
        assert set(rows) == {"tail", "tied"}
        for name, row in rows.items():
            values = np.sort([r[0] for r in skewed.select(name).filter(f"{name} IS NOT NULL").collect()])
            assert row.n == len(values)
            assert abs(row.mean_abs_impact - np.abs(values).mean()) < 1e-9
            assert abs(row.min_impact - values[0]) < 1e-9 and abs(row.max_impact - values[-1]) < 1e-9
            for column, share in SHARES.items():
                low, high = rank_range(values, values[np.abs(values - row[column]).argmin()])
                assert low - error <= share <= high + error


def test_small_tables_are_exact(spark, skewed):
    few = skewed.filter("customerID < 1000")
    row = EX.importance_distribution(EX.impact_states(few, Given("tail"), "customerID"), 12).first()
    values = np.sort([r.tail for r in few.collect()])
    for column, share in SHARES.items():
        assert abs(row[column] - values[int(np.ceil(share * len(values))) - 1]) < 1e-9
    assert EX.importance_distribution(EX.impact_states(few.limit(0), Given("tail"), "customerID")).count() == 0
    nulls = few.withColumn("tail", F.lit(None).cast("double"))
    assert EX.importance_distribution(EX.impact_states(nulls, Given("tail"), "customerID")).count() == 0


def test_sketches_are_built_before_the_shuffle(skewed):
    plan = EX.impact_states(skewed, Given("tail", "tied"), "customerID")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("ObjectHashAggregate") == 2
