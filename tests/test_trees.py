"""Exact tree attribution against the enumeration of all coalitions; reasons in batch and stream."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlens.operators import explain as EX
from churnlens.operators import train as TR
from churnlens.operators import trees as TX
from churnlens.session import ship_package

NAMES = ["a b", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def frame(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (400, 5)) / 2.0
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 1) | (x[:, 2] * x[:, 3] > rng.random(400) * 2)).astype(float)
    rows = [(k, float(t), *map(float, r)) for k, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, label double, " + ", ".join(f"`{n}` double" for n in NAMES))
    return df.checkpoint()


def fitted(frame, kind):
    made = {
        "dt": DecisionTreeClassifier(maxDepth=5, seed=1),
        "rf": RandomForestClassifier(numTrees=7, maxDepth=5, seed=1),
        "gbt": GBTClassifier(maxIter=6, maxDepth=4, seed=1),
    }[kind]
    from pyspark.ml.feature import VectorAssembler

    renamed = frame.toDF("id", "label", *[f"f{i}" for i in range(5)])
    vec = VectorAssembler(inputCols=[f"f{i}" for i in range(5)], outputCol="features").transform(renamed)
    model = made.fit(vec)
    out = model.transform(vec)
    p = vector_to_array("probability")[1]
    out = out.select("id", (F.log(p / (1 - p)) if kind == "gbt" else p).alias("f"))
    return model, {r.id: r.f for r in out.collect()}


def enumerated(score, x, z):
    n = len(x)
    phi = np.zeros(n)
    for k in range(n):
        others = [j for j in range(n) if j != k]
        for size in range(n):
            for some in combinations(others, size):
                w = factorial(size) * factorial(n - size - 1) / factorial(n)
                without = z.copy()
                without[list(some)] = x[list(some)]
                with_k = without.copy()
                with_k[k] = x[k]
                phi[k] += w * (score(with_k[None])[0] - score(without[None])[0])
    return phi


@pytest.mark.parametrize("kind", ["dt", "rf", "gbt"])
def test_equal_to_all_coalitions(frame, kind):
    model, scores = fitted(frame, kind)
    background = EX.background_sample(frame, 12, 3, key="id")
    explainer = TX.TreeExplainer.fit(model, NAMES, background)
    z = np.array([list(r)[2:] for r in background.collect()])
    long = TX.tree_shapley(frame, explainer, "id").collect()
    phi = {}
    for r in long:
        phi.setdefault(r.id, np.zeros(5))[r.idx] = r.phi
    rows = {r.id: np.array(list(r)[2:]) for r in frame.collect()}
    assert len(phi) == len(rows)
    for k, x in rows.items():  # the model's own output, and efficiency
        assert abs(explainer.ensemble.score(x[None])[0] - scores[k]) < 1e-9
        assert abs(phi[k].sum() - (scores[k] - explainer.baseline)) < 1e-9
    for k in list(rows)[:12]:
        want = np.mean([enumerated(explainer.ensemble.score, rows[k], b) for b in z], axis=0)
        assert np.abs(phi[k] - want).max() < 1e-9


def test_reasons_have_the_linear_interface(frame):
    model, scores = fitted(frame, "gbt")
    explainer = TX.TreeExplainer.fit(model, NAMES, EX.background_sample(frame, 12, 3, key="id"))
    got = EX.reasons_long(frame.limit(7), explainer, 5, key="id").collect()
    assert len(got) == 35 and {r.direction for r in got} <= {"increases", "decreases"}
    by_row = {}
    for r in got:
        by_row.setdefault(r.id, []).append(r)
    for k, reasons in by_row.items():
        assert [abs(r.impact) for r in reasons] == sorted((abs(r.impact) for r in reasons), reverse=True)
        assert abs(sum(r.impact for r in reasons) - (scores[k] - explainer.baseline)) < 5 * 5e-5 + 1e-9
    assert EX.global_importance(frame, explainer, top=3, key="id").count() == 3
    assert EX.reasons_long(frame.limit(0), explainer, 5, key="id").count() == 0


def test_missing_values_and_refusals(spark, frame):
    model, _ = fitted(frame, "rf")
    explainer = TX.TreeExplainer.fit(model, NAMES, frame.limit(3))
    assert np.isfinite(explainer.ensemble.explain(np.full((2, 5), np.nan))).all()
    with pytest.raises(ValueError):
        TX.TreeExplainer.fit(model, NAMES, frame.limit(0))
    with pytest.raises(ValueError):
        TX.TreeExplainer.fit(TR.estimator("LogisticRegression"), NAMES, frame.limit(3))
