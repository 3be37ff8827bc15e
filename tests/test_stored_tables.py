"""Saved pipelines, file positions, malformed lines, stored pages, lookups and few repeats."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import clean as CL
from churnlens.operators import report as R
from churnlens.operators import stages as SG
from churnlens.operators.evaluate import balanced_weights, pos_weight
from churnlens.operators.features import MAX_VOCAB_LEVELS, OneHotVocabulary
from churnlens.operators.linear import scorecard
from churnlens.operators.score import score_batch
from churnlens.plans.catalog import raw
from churnlens.sources import files as IO

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

FRESH = """
import sys
sys.path.insert(0, {root!r})
from pyspark.ml import PipelineModel
from churnlens.session import build_session
from churnlens.operators.stages import score_customers
spark = build_session(master="local[2]", shuffle_partitions=2)
model = PipelineModel.load({path!r})
score_customers(model, spark.read.parquet({rows!r})).select("customerID", "src_ord", "p_raw").write.parquet({out!r})
spark.stop()
"""


def test_saved_pipeline_scores_raw_customers_in_a_fresh_session(spark, tmp_path):
    path, rows, out = (str(tmp_path / x) for x in ("model", "rows", "out"))
    raw(spark, SF).write.parquet(rows)
    table = spark.read.parquet(rows)
    model = SG.fit_churn_pipeline(table, "DecisionTree")
    model.write().save(path)
    subprocess.run([sys.executable, "-c", FRESH.format(root=ROOT, path=path, rows=rows, out=out)], check=True, timeout=180)
    here = {(r["customerID"], r["src_ord"]): r["p_raw"] for r in SG.score_customers(model, table).collect()}
    there = {(r["customerID"], r["src_ord"]): r["p_raw"] for r in spark.read.parquet(out).collect()}
    assert here == there and len(here) == table.count()
    levels = model.stages[2].vocabulary().levels
    assert levels["Contract"] == sorted(r[0] for r in table.select("Contract").distinct().collect())


@pytest.mark.parametrize("kind, direct", [("balanced", balanced_weights), ("positive", pos_weight)])
def test_class_weights_stage(spark, kind, direct):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], f"{S.TARGET} int")
    got = SG.ClassWeights()._set(kind=kind).fit(df).transform(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in direct(df).collect())


def test_vocabulary_keeps_columns_without_levels_and_its_bound(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "Contract string, Partner string")
    assert OneHotVocabulary.fit(df, ["Contract", "Partner"]).levels == {"Contract": ["a", "b"], "Partner": []}
    many = spark.range(MAX_VOCAB_LEVELS + 1).selectExpr("CAST(id AS STRING) AS Contract")
    with pytest.raises(ValueError, match="bound"):
        OneHotVocabulary.fit(many, ["Contract"])


def test_first_row_is_the_same_for_other_splits(spark, tmp_path):
    path = str(tmp_path / "csv")
    lines = ["customerID,tenure,MonthlyCharges"] + [f"C{i % 50},{i},{i}.5" for i in range(2000)]
    os.mkdir(path)
    for part in ("a", "b"):
        with open(f"{path}/{part}.csv", "w") as f:
            f.write("\n".join(lines) + "\n")
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "600b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = IO.read_customers(spark, path, required=["tenure"])
            first = CL.dedup_keep_first(df)
            seen.append((df.rdd.getNumPartitions(), sorted((r["customerID"], r["tenure"]) for r in first.collect())))
            ids = CL.assign_row_ids(df.where("customerID IS NOT NULL").drop("customerID"))
            assert ids.orderBy(F.substring("customerID", 5, 9).cast("int")).select("tenure").toPandas()["tenure"].tolist() == [*range(2000)] * 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (few, a), (many, b) = seen
    assert many > 20 * few and a == b == sorted((f"C{i}", i) for i in range(50))


def test_malformed_lines_are_a_second_output(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("customerID,tenure,MonthlyCharges\na,1,2.5\nb,x,3.5\nc,4\nd,5,6.5,7\ne,,NA\nf,y,z\n")
    rows, bad = IO.read_customers_checked(spark, str(path), required=["tenure"])
    assert {(r["customerID"], r["tenure"], r["MonthlyCharges"]) for r in rows.collect()} == {
        ("a", 1, 2.5), ("b", None, 3.5), ("e", None, None), ("f", None, None)}
    assert {(r["record"], r["problem"], r["kept"]) for r in bad.collect()} == {
        ("b,x,3.5", "tenure", True), ("c,4", "fields", False), ("d,5,6.5,7", "fields", False),
        ("f,y,z", "tenure", True), ("f,y,z", "MonthlyCharges", True)}
    assert bad.count() == 5 and bad.where("NOT kept").count() == 2


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_stored_pages_equal_offset(spark, tmp_path):
    scored = score_batch(raw(spark, SF), scorecard()).drop("p_raw").persist()
    path = R.write_pages(scored, str(tmp_path / "pages"), ranges=12)
    index = spark.read.parquet(f"{path}/index").orderBy("first_row").collect()
    assert len(index) > 6 and sum(r["n_rows"] for r in index) == scored.count()
    last = -(-scored.count() // 7)
    for number in (1, 2, 9, last, last + 1):
        assert _rows(R.read_page(spark, path, number, 7)) == _rows(R.page(scored, number, 7))
    plan = R.read_page(spark, path, 9, 7)._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().head().metrics().get("numFiles").get().value() <= 2 < len(index)
    by_contract = R.write_pages(scored, str(tmp_path / "contract"), key="Contract", descending=False, ranges=4)
    assert _rows(R.read_page(spark, by_contract, 3, 20)) == _rows(R.sort_customers(scored, "Contract", False).offset(40).limit(20))
    empty = R.write_pages(scored.limit(0), str(tmp_path / "empty"))
    assert R.read_page(spark, empty, 1).count() == 0 and R.read_page(spark, empty, 1).columns == scored.columns


def test_lookup_skips_files_by_bloom_filter(spark, tmp_path):
    scored = score_batch(raw(spark, SF), scorecard()).drop("p_raw").persist()
    path = R.write_pages(scored, str(tmp_path / "pages"), ranges=12, distinct_ids=1000)
    stored = R.stored_customers(spark, path)
    hit = stored.where(F.col(S.KEY) == "C-000000042")
    plan = hit._jdf.queryExecution().executedPlan()
    hit_rows = plan.executeCollect()
    read = plan.collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert len(hit_rows) == 1 and read <= scored.count() / 6  # one or two of twelve ranges
    assert _rows(R.find_customer(stored, "C-000000042")) == _rows(R.find_customer(scored, "C-000000042"))
    assert R.find_customer(stored, "nobody").count() == 0


def test_few_repeats_equal_keep_first(spark):
    rows = [("a", 5, "x"), ("a", 3, "y"), (None, 9, "n"), (None, 8, "m"), ("b", None, "b"), ("b", 7, "c"), ("c", 1, "d"), ("t", 2, "s"), ("t", 2, "s")]
    df = spark.createDataFrame(rows, "customerID string, src_ord long, x string")
    got = CL.dedup_few(df)
    assert sorted(map(str, _rows(got))) == sorted(map(str, _rows(CL.dedup_keep_first(df))))
    assert {r["x"] for r in got.collect()} == {"y", "m", "c", "d", "s"} and got.count() == 5
    assert CL.dedup_few(df.limit(0)).count() == 0
