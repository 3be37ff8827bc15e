"""One query feeds both sinks; a replayed batch leaves each row once; trees give reasons on streams."""

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import explain as EX
from churnlens.operators import train as TR
from churnlens.operators import trees as TX
from churnlens.operators.linear import scorecard
from churnlens.plans import catalog_ml as ML
from churnlens.plans.catalog import features_tbl, raw
from churnlens.session import scratch_path, ship_package
from churnlens.streaming import scorer as ST

SF = "/root/testdata/sf0.001"


def arrivals(spark, files):
    base = scratch_path(spark, "sinks")
    paths = ST.StreamPaths(f"{base}/in", f"{base}/scored", f"{base}/quarantine", f"{base}/ckpt")
    records = raw(spark, SF)
    records = records.withColumn("tenure", F.when(F.col("src_ord") % 10 == 0, F.lit(-5)).otherwise(F.col("tenure")).cast(records.schema["tenure"].dataType))
    records.repartition(files, "src_ord").write.parquet(paths.source)
    return paths, records.count()


def test_stop_between_the_sinks(spark, monkeypatch):
    paths, n = arrivals(spark, 4)
    scorer = scorecard()
    explainer = EX.LinearExplainer.fit(scorer, EX.background_sample(features_tbl(spark, SF), 20, 1))
    schema = spark.read.parquet(paths.source).schema
    real, calls = ST.write_batch, []

    def stopping(batch, batch_id, *args):
        calls.append(batch_id)
        if len(calls) == 2:  # the second batch: one sink is written, then the job stops
            scored, _ = ST.scored_stream(batch, scorer, explainer)
            scored.write.mode("overwrite").parquet(f"{paths.scored}/batch_id={batch_id}")
            raise RuntimeError("stopped")
        real(batch, batch_id, *args)

    monkeypatch.setattr(ST, "write_batch", stopping)
    with pytest.raises(Exception, match="stopped"):
        ST.run_to_completion(ST.start(spark, paths, scorer, explainer, schema=schema, files_per_batch=1))
    good, bad = (ST.read_sink(spark, paths, s) for s in ("scored", "quarantine"))
    before = good.count() + bad.count()
    first = spark.read.parquet(paths.scored).filter("batch_id = 0").count() + spark.read.parquet(paths.quarantine).filter("batch_id = 0").count()
    assert before == first < n  # nothing of the torn batch is seen
    ST.run_to_completion(ST.start(spark, paths, scorer, explainer, schema=schema, files_per_batch=1))
    assert calls.count(1) == 2
    seen = [r.src_ord for s in ("scored", "quarantine") for r in ST.read_sink(spark, paths, s).select("src_ord").collect()]
    assert len(seen) == len(set(seen)) == n
    assert ST.read_sink(spark, paths, "quarantine").count() > 0


def test_tree_reasons_in_batch_and_stream(spark):
    ship_package(spark)
    ts = ML.training(spark, SF)
    fm = TR.fit("GBT", ts, rounds=4)
    scorer = TR.ModelScorer("GBT", fm.model, ts.features)
    explainer = TX.TreeExplainer.fit(fm.model, ts.features, EX.background_sample(ts.train, 10, 1))
    paths, _ = arrivals(spark, 2)
    schema = spark.read.parquet(paths.source).schema
    ST.run_to_completion(ST.start(spark, paths, scorer, explainer, schema=schema))
    rows = ST.read_sink(spark, paths, "scored").collect()
    assert rows and {len(r.top_reasons) for r in rows} == {5}
    # all reasons together are the score less the baseline, in log-odds
    from churnlens.operators import score as SC

    whole = SC.score_batch(raw(spark, SF), scorer, explainer=explainer, top_n=len(ts.features)).collect()
    from math import log

    for r in whole:
        total = sum(x.impact for x in r.top_reasons)
        assert abs(total - (log(r.p_raw / (1 - r.p_raw)) - explainer.baseline)) < len(ts.features) * 5e-5
    assert {S.KEY, "top_reasons", "RiskLevel"} <= set(whole[0].asDict())
