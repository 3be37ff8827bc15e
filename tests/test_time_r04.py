"""Time findings of FINDINGS_r04.md: each test fails on the code before its finding was worked on."""

import threading

import numpy as np
import pytest
from pyspark.ml import tuning
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler

from churnlens.operators import train as TR
from churnlens.operators import trees as TX
from churnlens.session import ship_package

NAMES = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def frame(spark):
    ship_package(spark)
    rng = np.random.default_rng(11)
    x = rng.integers(0, 8, (500, len(NAMES))) / 2.0
    made = [(k, float(r[0] * r[1] + r[4] > r[2] + r[3] * rng.random()), *map(float, r)) for k, r in enumerate(x)]
    made.append((len(x), 1.0, *[float("nan")] * len(NAMES)))
    made.append((len(x) + 1, 0.0, *[float("-inf")] * len(NAMES)))
    rows = spark.createDataFrame(made, "id long, label double, " + ", ".join(f"{n} double" for n in NAMES))
    return VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(rows).coalesce(1).checkpoint()


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_values_of_sets_equal_pairs_with_background_rows(frame, monkeypatch, kind):
    """no customer meets a background row; the looked-up values are those of all pairs."""
    made = {"rf": RandomForestClassifier(numTrees=5, maxDepth=8, seed=2), "gbt": GBTClassifier(maxIter=5, maxDepth=6, seed=2)}[kind]
    model = made.fit(frame.where("id < 500"))
    explainer = TX.TreeExplainer.fit(model, NAMES, frame.limit(40))
    x = np.array([list(r) for r in frame.select(*NAMES).collect()])
    monkeypatch.setattr(TX, "TABLE_BITS", 0)
    pairs = explainer.ensemble.explain(x)
    monkeypatch.setattr(TX, "TABLE_BITS", 3)
    mixed = explainer.ensemble.explain(x)
    monkeypatch.setattr(TX, "TABLE_BITS", 12)
    monkeypatch.setattr(TX.Ensemble, "_add_cases", None)
    whole = explainer.ensemble.explain(x)
    monkeypatch.setattr(TX, "TABLE_NUMBERS", 1)
    monkeypatch.setattr(TX, "SLICE_NUMBERS", 100)
    for got in (pairs, mixed, explainer.ensemble.explain(x)):
        assert np.abs(got - whole).max() < 1e-12
    gaps = whole.sum(axis=1) - (explainer.ensemble.score(x) - explainer.baseline)
    assert np.abs(gaps).max() < 1e-12 and np.abs(whole).max() > 0.01


def test_a_task_a_core_explains(spark, frame):
    """every task works out the tables of the trees, so there are no more than cores."""
    assert TX.dealt_to_tasks(frame).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_forest_keeps_the_nodes_of_rows(frame):
    """Rows go one step down each tree for a level; the forest is the same."""
    one = TR.estimator("RandomForest", trees=6).setLabelCol("label").setWeightCol("weight")
    assert one.getCacheNodeIds()
    rows = frame.where("id < 500").selectExpr("*", "1.0 AS weight")
    kept, not_kept = (one.copy({one.cacheNodeIds: x}).fit(rows).toDebugString.split("\n", 1)[1] for x in (True, False))
    assert kept == not_kept


def test_batches_of_a_task_are_explained_together(spark, frame, monkeypatch):
    """the tables of the trees serve many batches, and every row keeps its values."""
    model = GBTClassifier(maxIter=2, maxDepth=3, seed=2).fit(frame.where("id < 500"))
    explainer = TX.TreeExplainer.fit(model, NAMES, frame.limit(10))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        got = {r.id: list(r.phi) for r in frame.select("id", explainer.impacts().alias("phi")).collect()}
        assert frame.limit(0).select(explainer.impacts()).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = {r.id: [r[n] for n in NAMES] for r in frame.collect()}
    want = explainer.ensemble.explain(np.array(list(rows.values())))
    assert got.keys() == rows.keys()
    assert all(np.abs(np.array(got[k]) - phi).max() < 1e-12 for k, phi in zip(rows, want))
    assert TX.HELD_ROWS >= 40_000


def test_folds_of_a_search_share_one_pool(frame, monkeypatch):
    """The fits of all folds run side by side, equal draws once, with the metrics of pyspark.ml."""
    rows = frame.where("id < 500").selectExpr("*", "int(id % 3) AS part")
    est = GBTClassifier(maxIter=1, seed=3)
    grid = [{est.maxDepth: d, est.maxIter: m} for d, m in ((2, 2), (4, 1), (2, 2))]
    args = dict(estimator=est, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=3, foldCol="part", parallelism=6, seed=1)
    want = tuning.CrossValidator(**args).fit(rows)
    together, begun, plain = threading.Barrier(6), [], GBTClassifier._fit

    def fit(self, data):
        begun.append(data.rdd.getNumPartitions())
        if len(begun) <= 6:
            together.wait(timeout=60)
        return plain(self, data)

    monkeypatch.setattr(GBTClassifier, "_fit", fit)
    got = TR.CrossValidator(**args).fit(rows.repartition(5, "id").checkpoint())
    assert len(begun) == 7 and begun[:6] == [2 if rows.sparkSession.sparkContext.defaultParallelism > 6 else 1] * 6
    monkeypatch.setattr(GBTClassifier, "_fit", plain)
    got = TR.CrossValidator(**args).fit(rows)
    assert np.abs(np.array(got.avgMetrics) - want.avgMetrics).max() < 1e-12
    assert got.bestModel.toDebugString.split("\n", 1)[1] == want.bestModel.toDebugString.split("\n", 1)[1]
    bad = rows.withColumn("part", rows.part + 1)
    with pytest.raises(Exception):
        TR.CrossValidator(**args).fit(bad)
