"""Every registered query against its DuckDB oracle (sf0.001) and invariants for
the rows-only keys (trained models, stream, Shapley)."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from test_plans import FORBIDDEN, plan_text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.9g}"))
    if isinstance(v, bool):
        return int(v)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 80


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    plan = plan_text(df)
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op} in the physical plan"
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.execute(ORACLES[key])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _bag(cols, rows) == _bag(ocols, orows)


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["column_name", "segment", "avg_risk", "count"]
    rows = df.collect()
    assert len(rows) == 20
    assert sum(r["count"] for r in rows if r["column_name"] == "Contract") == 150


def test_fixture_goldens(spark):
    from churnlens.plans.catalog import clean_tbl, raw, scored_labeled
    from churnlens.operators import evaluate as EV

    assert raw(spark, SF).count() == 152
    cl = clean_tbl(spark, SF)
    assert cl.count() == 150 and cl.agg({"Churn": "sum"}).first()[0] == 32
    auc = EV.roc_auc(scored_labeled(spark, SF)).first()[0]
    assert auc == 0.643


@pytest.fixture
def small_models(monkeypatch):
    """Invariants do not depend on ensemble size: fit 5 trees / rounds in tests."""
    from churnlens.plans import catalog_ml

    monkeypatch.setattr(catalog_ml, "QUERY_TREES", 5)
    monkeypatch.setattr(catalog_ml, "QUERY_ROUNDS", 5)


def test_training_invariants(spark, small_models):
    rows = QUERIES["model_comparison"](spark, SF).collect()
    assert [r["model"] for r in rows] == ["LogisticRegression", "DecisionTree", "RandomForest", "GBTWeighted", "GBT"]
    for r in rows:
        for m in ("accuracy", "precision", "recall", "f1", "roc_auc"):
            assert 0.0 <= r[m] <= 1.0
    best = QUERIES["best_model"](spark, SF).first()
    assert best["roc_auc"] == max(r["roc_auc"] for r in rows)
    assert QUERIES["metrics_long"](spark, SF).count() == 25
    meta = QUERIES["training_metadata"](spark, SF).first()
    assert meta["n_features"] == 55 and meta["train_size"] + meta["test_size"] == 150


def test_artifacts_roundtrip_identical(spark, small_models):
    rows = QUERIES["artifacts_roundtrip"](spark, SF).collect()
    assert rows and all(r["identical"] for r in rows)


def test_shapley_efficiency(spark, small_models):
    rows = QUERIES["shapley_efficiency"](spark, SF).collect()
    assert rows and max(r["gap"] for r in rows) < 1e-9


def test_lr_reasons_shape(spark):
    df = QUERIES["lr_reasons"](spark, SF)
    counts = {r["count"] for r in df.groupBy("customerID").count().collect()}
    assert counts == {5}
