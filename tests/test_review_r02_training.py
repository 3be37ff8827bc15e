
import inspect

from churnlens.operators import train as TR
from churnlens.plans import catalog_ml as ML

SF = "/root/testdata/sf0.001"


def test_registered_training_has_the_size_of_the_reference():
    compared, tuned = (inspect.signature(f).parameters for f in (TR.compare_models, TR.tune))
    assert (ML.QUERY_TREES, ML.QUERY_ROUNDS) == (compared["trees"].default, compared["rounds"].default) == (300, 300)
    assert (ML.TUNE_DRAWS, ML.TUNE_ITER_SCALE) == (tuned["n_iter"].default, tuned["scale_iters"].default) == (15, 1.0)
    assert ML.FOREST_BG == 100  # the forest's values are exact: there are no permutations


def test_reasons_and_saved_scores_are_of_every_customer(spark, monkeypatch):
    ts = ML.training(spark, SF)
    assert ts.n_train + ts.n_test == 150
    reasons = ML.q_lr_reasons(spark, SF).groupBy("customerID").count().collect()
    assert len(reasons) == 150 and {r["count"] for r in reasons} == {5}
    # one small tree stands in for the tuned winner: only the rows are looked at
    fm = TR.fit("DecisionTree", ts)
    runs = spark.createDataFrame([("DecisionTree", 0.5, 0.5, 0.5, 0.5, 0.5)], "model string, " + ", ".join(f"{m} double" for m in ML.S.METRIC_NAMES))
    monkeypatch.setattr(ML, "tuned", lambda *_: ("DecisionTree", fm, None, {m: 0.5 for m in ML.S.METRIC_NAMES}))
    monkeypatch.setattr(ML, "comparison", lambda *_: (runs, {"RandomForest": fm}))
    rows = ML.q_artifacts_roundtrip(spark, SF).collect()
    assert len({r["customerID"] for r in rows}) == len(rows) == 150 and all(r["identical"] for r in rows)
    monkeypatch.setattr(ML, "fitted_model", lambda *_: fm)
    gaps = ML.q_shapley_efficiency(spark, SF).collect()
    assert len(gaps) == 150 and max(r["gap"] for r in gaps) < 1e-9
