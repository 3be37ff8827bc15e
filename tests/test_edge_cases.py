"""Rows that the fixture never holds: null labels, null ids, missing scores, odd files."""

import json

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import evaluate as EV
from churnlens.operators import report as R
from churnlens.operators import score as SC
from churnlens.operators import train as TR
from churnlens.operators.clean import assign_row_ids, dedup_keep_first
from churnlens.operators.linear import scorecard
from churnlens.plans.catalog import raw
from churnlens.session import scratch_path
from churnlens.sources import files as IO

SF = "/root/testdata/sf0.001"


def test_split_and_folds_keep_rows_with_null_labels(spark):
    rows = spark.range(3000).selectExpr("id AS src_ord", "CAST(id AS STRING) AS customerID", "CAST(nullif(id % 3, 2) AS INT) AS Churn")
    assert EV.stratified_split(rows).count() == 3000
    assert EV.cv_folds(rows).count() == 3000


def test_keyset_pages_equal_offset_pages_with_nulls(spark):
    data = [(None, 0.9), ("A", 0.9), ("B", 0.9), ("C", None), (None, None), ("D", 0.1), ("E", 0.5), ("F", None)]
    rows = spark.createDataFrame(data, "customerID string, ChurnProbability double")
    offset = [tuple(r) for n in range(1, 5) for r in R.page(rows, n, 2).collect()]
    keyset = [tuple(r) for r in R.page(rows, 1, 2).collect()]
    while len(keyset) < len(data):
        keyset += [tuple(r) for r in R.page_after(rows, keyset[-1][1], keyset[-1][0], 2).collect()]
    assert keyset == offset and len(set(keyset)) == len(data)


def test_missing_scores_are_not_safe(spark):
    rows = raw(spark, SF).withColumn("MonthlyCharges", F.when(F.col("src_ord") >= 20, F.col("MonthlyCharges")))
    scored = SC.score_batch(rows, scorecard())
    assert scored.where("p_raw IS NULL AND (Prediction IS NOT NULL OR RiskLevel IS NOT NULL)").count() == 0
    s = R.churn_summary(scored).first()
    assert s["unscored_count"] == 10
    assert s["predicted_churn_count"] + s["predicted_retain_count"] + s["unscored_count"] == s["total_customers"]
    assert R.risk_histogram(scored).agg(F.sum("count")).first()[0] + 10 == s["total_customers"]


def test_json_keeps_null_fields(spark):
    text = IO.to_records_json(spark.createDataFrame([(1, None)], "a int, b string")).first()[0]
    assert json.loads(text) == {"a": 1, "b": None}


def test_csv_header_checks(spark):
    empty, mixed = scratch_path(spark, "empty"), scratch_path(spark, "mixed")
    header = "tenure,MonthlyCharges,Contract"
    one = spark.createDataFrame([(header,)], "value string").coalesce(1)
    one.write.text(empty)
    with pytest.raises(IO.MissingColumnsError, match="no rows"):
        IO.read_customers(spark, empty, required=["tenure"])
    for names, row in ((header, "1,20.5,One year"), ("MonthlyCharges,tenure,Contract", "20.5,2,One year")):
        spark.createDataFrame([(names + "\n" + row,)], "value string").coalesce(1).write.mode("append").text(mixed)
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_customers(spark, mixed, required=["tenure"]).collect()


def test_keyless_upload_gets_row_ids(spark):
    rows = raw(spark, SF).drop(S.KEY)
    ids = [r[0] for r in SC.score_batch(rows, scorecard()).select(S.KEY).collect()]
    assert sorted(ids) == sorted(f"ROW-{i + 1}" for i in range(len(ids)))


def test_null_order_is_last(spark):
    rows = spark.createDataFrame([(None, "a", 1), (5, "a", 2), (3, "b", 3), (None, "c", 4)], "src_ord long, customerID string, x int")
    assert {(r["customerID"], r["x"]) for r in dedup_keep_first(rows).collect()} == {("a", 2), ("b", 3), ("c", 4)}
    ranked = assign_row_ids(rows.drop("customerID")).where("src_ord IS NOT NULL").orderBy("src_ord")
    assert [r["customerID"] for r in ranked.collect()] == ["ROW-1", "ROW-2"]


def test_breakdowns_are_sorted(spark):
    scored = SC.score_batch(raw(spark, SF), scorecard())
    counts = [r["count"] for r in R.risk_breakdown(scored).collect()]
    assert counts == sorted(counts, reverse=True)


@pytest.mark.parametrize("name", ["LogisticRegression", "DecisionTree"])
def test_saved_model_scores_like_the_one_in_memory(spark, name):
    from churnlens.plans.catalog import clean_tbl

    ts = TR.prepare(clean_tbl(spark, SF))
    fm = TR.fit(name, ts)
    runs = spark.createDataFrame([(name, 0.5, 0.5, 0.5, 0.5, 0.5)], "model string, " + ", ".join(f"{m} double" for m in S.METRIC_NAMES))
    meta = TR.training_metadata(spark, runs, name, {m: 0.5 for m in S.METRIC_NAMES}, ts)
    path = TR.save_artifacts(spark, scratch_path(spark, "model"), fm, ts, meta)
    scorer = TR.load_scorer(spark, path)
    mine = scorer.score(ts.test).select(S.KEY, F.round("p_raw", 9).alias("p"))
    other = fm.score(ts.test, ts).select(S.KEY, F.round("p_raw", 9).alias("p"))
    assert mine.exceptAll(other).count() == 0 and mine.count() == other.count() > 0


def test_missing_artifacts_are_named(spark):
    with pytest.raises(FileNotFoundError, match="model, scaler, feature_names, metadata"):
        TR.load_artifacts(spark, scratch_path(spark, "nothing"))
