"""Streaming scorer queries: the fixture rows arrive as request files, the stream
drains them (availableNow) into parquet sinks, and the sinks are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import round_half_even
from ..operators import explain as EX
from ..operators.linear import scorecard
from ..session import scratch_path
from ..streaming import scorer as ST
from . import oracle as O
from .catalog import RECORDS_SQL, VALIDATED, _bg_cte, _contrib_sql, _reasons_body, _top_sql, features_tbl, raw, register

_CACHE: dict = {}


def drain(spark: SparkSession, sf: str, scorer, explainer) -> ST.StreamPaths:
    """All raw records, arriving as the files of the tasks that wrote them, scored by a stream."""
    base = scratch_path(spark, "stream")
    paths = ST.StreamPaths(f"{base}/in", f"{base}/scored", f"{base}/quarantine", f"{base}/ckpt")
    raw(spark, sf).write.mode("overwrite").parquet(paths.source)
    schema = spark.read.parquet(paths.source).schema
    ST.run_to_completion(ST.start(spark, paths, scorer, explainer, schema=schema, high_value="single"))
    return paths


def run_stream(spark: SparkSession, sf: str) -> ST.StreamPaths:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        sc = scorecard()
        explainer = EX.LinearExplainer.fit(sc, EX.background_sample(features_tbl(spark, sf), 100, 1))
        _CACHE[key] = drain(spark, sf, sc, explainer)
    return _CACHE[key]


@register("score_stream", RECORDS_SQL)
def q_score_stream(spark, sf):
    paths = run_stream(spark, sf)
    return ST.read_sink(spark, paths, "scored").drop("top_reasons", "p_raw")


@register(
    "score_stream_quarantine",
    O.with_ctes("SELECT src_ord, customerID, errors FROM vd WHERE errors <> ''", VALIDATED, upto=1),
)
def q_score_stream_quarantine(spark, sf):
    paths = run_stream(spark, sf)
    bad = ST.read_sink(spark, paths, "quarantine")
    return bad.select("src_ord", "customerID", F.array_join("errors", "; ").alias("errors"))


def _stream_reasons_sql() -> str:
    from .catalog import _records_sql  # noqa: F401  (same record path as score_records)

    clean_cols = [c for c in O.RAW_COLS if c not in ("TotalCharges", "Churn")]
    rec = (
        "rc AS (SELECT " + ", ".join(clean_cols)
        + ", coalesce(TRY_CAST(trim(TotalCharges) AS DOUBLE), MonthlyCharges * greatest(tenure, 1)) AS TotalCharges FROM vd WHERE errors = '')"
    )
    feats = O.features_cte("rf", "rc", hv_mode="single")
    oh = O.onehot_cte("ro", "rf", ["src_ord AS customerID", "src_ord"])
    return O.with_ctes(
        _reasons_body(5).replace("SELECT customerID,", "SELECT customerID AS src_ord,"),
        VALIDATED, rec, feats, oh,
        _bg_cte("bg", 100, 1),
        f"ct AS ({_contrib_sql('ro', 'bg')})",
        _top_sql(5),
    )


@register("score_stream_reasons", _stream_reasons_sql())
def q_score_stream_reasons(spark, sf):
    paths = run_stream(spark, sf)
    out = ST.read_sink(spark, paths, "scored").select("src_ord", F.posexplode("top_reasons").alias("pos", "r"))
    return out.select(
        "src_ord",
        (F.col("pos") + 1).alias("rank"),
        F.col("r.feature").alias("feature"),
        F.col("r.value").alias("value"),
        F.col("r.impact").alias("impact"),
        F.col("r.direction").alias("direction"),
    )


@register("score_stream_trees", None)
def q_score_stream_trees(spark, sf):
    """Every record scored by the boosted trees on a stream, with its five main reasons in log-odds."""
    from .catalog_ml import boosted_scorer

    scorer, explainer = boosted_scorer(spark, sf)
    out = ST.read_sink(spark, drain(spark, sf, scorer, explainer), "scored")
    return out.select("src_ord", "ChurnProbability", "Prediction", "RiskLevel", F.posexplode("top_reasons").alias("pos", "r")).select(
        "src_ord", "ChurnProbability", "Prediction", "RiskLevel", (F.col("pos") + 1).alias("rank"), "r.*"
    )
