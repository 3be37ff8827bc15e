"""Time findings of FINDINGS_r03.md: each test fails on the code before its finding was settled."""

import math
import threading

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from churnlens import schema as S
from churnlens.operators import shapley as SH
from churnlens.operators import train as TR
from churnlens.operators import trees as TX
from churnlens.operators.linear import LinearScorer
from churnlens.plans.catalog import clean_tbl
from churnlens.session import ship_package
from test_plans import plan_text

SF = "/root/testdata/sf0.001"
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    made = [("k1", 1.0, 0.0, 2.0, 5.0), ("k2", None, 1.0, 3.0, 5.0), ("k3", 0.5, None, None, None), ("k1", 4.0, 1.0, 0.0, 5.0),
            (None, 2.0, 2.0, 2.0, 2.0), ("k4", float("nan"), 0.0, 1.0, 1.0)]
    return spark.createDataFrame(made, "customerID string, a double, b double, c double, d double")


@pytest.mark.parametrize("space", ["logit", "probability"])
@pytest.mark.parametrize("missing", [False, True])
def test_blocks_of_coalitions_equal_coalition_rows(spark, rows, space, missing):
    """no row for each coalition, and the same values with nulls, NaN, repeated and null keys."""
    score = SH.linear_array_score(LinearScorer(0.3, [("a", 0.7), ("b", -1.1), ("c", 0.4), ("d", 0.0)], NAMES, {"a": (1.0, 2.0)}, "s"), space)
    background = spark.createDataFrame([(0.0, 1.0, 1.0, 0.0), (2.0, None if missing else 0.5, 3.0, 1.0)], "a double, b double, c double, d double")
    got = SH.sampled_shapley(rows, NAMES, score, background, m=3, seed=5)
    assert "explode(sequence" not in plan_text(got)
    want = SH.sampled_shapley(rows, NAMES, lambda df, arr, out: score(df, arr, out), background, m=3, seed=5)
    found, wanted = ({(r[S.KEY], r["feature"], r["idx"]): r["phi"] for r in x.collect()} for x in (got, want))
    assert found.keys() == wanted.keys() and len(found) == 5 * len(NAMES)
    for k, phi in wanted.items():
        if phi is None or math.isnan(phi):
            assert str(found[k]) == str(phi), k
        else:
            assert abs(found[k] - phi) < 1e-12, k


def test_candidates_are_fitted_side_by_side(spark, monkeypatch):
    """The runs keep the order of the candidates."""
    together = threading.Barrier(len(TR.CANDIDATES))

    def fit(name, ts, trees, rounds):
        together.wait(timeout=20)
        return TR.FittedModel(name, None, False, 0.0)

    monkeypatch.setattr(TR, "fit", fit)
    monkeypatch.setattr(TR, "evaluate_model", lambda fm, ts: dict.fromkeys(S.METRIC_NAMES, 0.5))
    runs, fitted = TR.compare_models(spark, None)
    assert [r["model"] for r in runs.orderBy("position").collect()] == list(fitted) == TR.CANDIDATES


def test_folds_of_a_search_are_ranked_once(spark, monkeypatch):
    """The rows that the search takes are cut off from the ranking of their folds."""
    seen = []

    class Search:
        def __init__(self, **args):
            seen.append(args["parallelism"])

        def fit(self, vec):
            seen.append(plan_text(vec))
            raise KeyError("stop")

    monkeypatch.setattr(TR, "CrossValidator", Search)
    ts = TR.prepare(clean_tbl(spark, SF))
    for name, most in (("RandomForest", 4), ("GBT", max(4, spark.sparkContext.defaultParallelism))):
        with pytest.raises(KeyError):
            TR.tune(ts, name, {}, n_iter=1)
        assert seen[-2] == most and "Window" not in seen[-1] and "Join" not in seen[-1] and "ExistingRDD" in seen[-1]


def test_tree_values_are_dealt_to_all_tasks(spark, monkeypatch):
    """Rows of one file are explained by all cores, and runs of cases give what one run gives."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (300, 4)) / 2.0
    made = [(k, float(r[0] * r[1] > r[2] + rng.random()), *map(float, r)) for k, r in enumerate(x)]
    frame = spark.createDataFrame(made, "id long, label double, a double, b double, c double, d double").coalesce(1).checkpoint()
    vec = VectorAssembler(inputCols=NAMES, outputCol="features").transform(frame)
    model = RandomForestClassifier(numTrees=4, maxDepth=6, seed=2).fit(vec)
    explainer = TX.TreeExplainer.fit(model, NAMES, frame.limit(25))
    assert TX.tree_shapley(frame, explainer, "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    whole = explainer.ensemble.explain(x)
    monkeypatch.setattr(TX, "PAIRS", 7)
    monkeypatch.setattr(TX, "SLICE_NUMBERS", 500)
    assert np.abs(explainer.ensemble.explain(x) - whole).max() < 1e-12
    cases = []
    monkeypatch.setattr(TX, "_bits", lambda m: cases.append(len(m)) or np.bitwise_count(m).astype(np.int64))
    explainer.ensemble.explain(x)
    assert max(cases) <= max(7, 25)
