"""Training-side queries (rows-only checks: fitted models are not SQL-expressible).

Tree and boosting-round counts are parameters of the operators; the registered
queries use the reference's values, as the defaults do. One training run is shared per (session,
input) by the keys that read its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import round_half_even
from ..operators import evaluate as EV
from ..operators import explain as EX
from ..operators import train as TR
from ..operators import trees as TX
from ..session import scratch_path
from .catalog import clean_tbl, register

QUERY_TREES = 300
QUERY_ROUNDS = 300
TUNE_DRAWS = 15
TUNE_ITER_SCALE = 1.0

_CACHE: dict = {}


def _key(spark: SparkSession, sf: str):
    return (spark.sparkContext.applicationId, sf)


def training(spark: SparkSession, sf: str) -> TR.TrainingSet:
    k = ("ts",) + _key(spark, sf)
    if k not in _CACHE:
        _CACHE[k] = TR.prepare(clean_tbl(spark, sf))
    return _CACHE[k]


def customers(ts: TR.TrainingSet) -> DataFrame:
    """Every customer of both splits."""
    return ts.train.unionByName(ts.test)


def comparison(spark: SparkSession, sf: str):
    k = ("cmp",) + _key(spark, sf)
    if k not in _CACHE:
        ts = training(spark, sf)
        runs, fitted = TR.compare_models(spark, ts, trees=QUERY_TREES, rounds=QUERY_ROUNDS)
        _CACHE[k] = (runs.cache(), fitted)
    return _CACHE[k]


def _single(name: str):
    def fn(spark, sf):
        ts = training(spark, sf)
        fm = TR.fit(name, ts, trees=QUERY_TREES, rounds=QUERY_ROUNDS)
        m = TR.evaluate_model(fm, ts)
        row = [(name, m["accuracy"], m["precision"], m["recall"], m["f1"], m["roc_auc"], round(fm.seconds, 3))]
        return spark.createDataFrame(
            row, "model string, accuracy double, precision double, recall double, f1 double, roc_auc double, train_seconds double"
        )

    return fn


register("train_lr", None)(_single("LogisticRegression"))
register("train_dt", None)(_single("DecisionTree"))
register("train_rf", None)(_single("RandomForest"))
register("train_gbt_weighted", None)(_single("GBTWeighted"))
register("train_gbt", None)(_single("GBT"))


@register("model_comparison", None)
def q_model_comparison(spark, sf):
    runs, _ = comparison(spark, sf)
    return runs.drop("params")


@register("best_model", None)
def q_best_model(spark, sf):
    runs, _ = comparison(spark, sf)
    return TR.select_best(runs).drop("params")


@register("metrics_long", None)
def q_metrics_long(spark, sf):
    runs, _ = comparison(spark, sf)
    return TR.metrics_long(runs)


@register("models_ranked", None)
def q_models_ranked(spark, sf):
    runs, _ = comparison(spark, sf)
    return TR.models_ranked(runs)


def tuned(spark, sf):
    k = ("tune",) + _key(spark, sf)
    if k not in _CACHE:
        ts = training(spark, sf)
        runs, fitted = comparison(spark, sf)
        best = TR.select_best(runs).first()["model"]
        fm, info = TR.tune(ts, best, fitted, n_iter=TUNE_DRAWS, scale_iters=TUNE_ITER_SCALE)
        metrics = TR.evaluate_model(fm, ts)
        _CACHE[k] = (best, fm, info, metrics)
    return _CACHE[k]


@register("tune", None)
def q_tune(spark, sf):
    best, fm, info, metrics = tuned(spark, sf)
    row = [(best, info is not None, float(info["cv_auc"]) if info else None,
            TR.params_json(info["params"]) if info else "{}", *[float(metrics[m]) for m in S.METRIC_NAMES])]
    return spark.createDataFrame(
        row, "model string, tuned boolean, cv_roc_auc double, best_params string, "
        + ", ".join(f"{m} double" for m in S.METRIC_NAMES)
    )


@register("training_metadata", None)
def q_training_metadata(spark, sf):
    ts = training(spark, sf)
    runs, _ = comparison(spark, sf)
    best, _, _, metrics = tuned(spark, sf)
    return TR.training_metadata(spark, runs, best, metrics, ts)


@register("artifacts_roundtrip", None)
def q_artifacts_roundtrip(spark, sf):
    """Save the tuned winner with scaler, names and metadata; reload; score every customer with both."""
    ts = training(spark, sf)
    best, fm, _, metrics = tuned(spark, sf)
    runs, _ = comparison(spark, sf)
    meta = TR.training_metadata(spark, runs, best, metrics, ts)
    path = scratch_path(spark, "artifacts")
    TR.save_artifacts(spark, path, fm, ts, meta)
    model, scaler, names, _meta = TR.load_artifacts(spark, path)
    reloaded = TR.FittedModel(best, model.stages[0], fm.scaled, 0.0)
    before = fm.score(customers(ts), ts).select(S.KEY, F.col("p_raw").alias("p_before"))
    after = reloaded.score(customers(ts), ts).select(S.KEY, F.col("p_raw").alias("p_after"))
    joined = before.join(after, S.KEY)
    return joined.select(
        S.KEY,
        round_half_even(F.col("p_before"), 6).alias("p_before"),
        round_half_even(F.col("p_after"), 6).alias("p_after"),
        (F.col("p_before") == F.col("p_after")).alias("identical"),
    )


@register("score_from_artifacts", None)
def q_score_from_artifacts(spark, sf):
    """Every customer scored by the saved and reloaded winner (linear or trees)."""
    from ..operators import score as SC
    from .catalog import public, raw

    ts = training(spark, sf)
    best, fm, _, metrics = tuned(spark, sf)
    runs, _ = comparison(spark, sf)
    path = scratch_path(spark, "artifacts")
    TR.save_artifacts(spark, path, fm, ts, TR.training_metadata(spark, runs, best, metrics, ts))
    return public(SC.score_batch(raw(spark, sf), TR.load_scorer(spark, path)))


@register("run_log", None)
def q_run_log(spark, sf):
    """The run table: every candidate and the tuned winner, with parameters and metrics."""
    runs, _ = comparison(spark, sf)
    best, fm, info, metrics = tuned(spark, sf)
    path = scratch_path(spark, "runs")
    TR.log_run(runs, path, "candidates")
    TR.log_run(TR.tuned_run(spark, best, fm, info, metrics), path, "tuned")
    return spark.read.parquet(path).withColumn("params", F.to_json("params"))


@register("lr_reasons", None)
def q_lr_reasons(spark, sf):
    """Trained logistic model as expressions: top-5 linear SHAP reasons for every customer."""
    ts = training(spark, sf)
    fm = TR.fit("LogisticRegression", ts)
    scorer = TR.to_linear_scorer(fm, ts)
    explainer = EX.LinearExplainer.fit(scorer, EX.background_sample(ts.train, 100, 1))
    return EX.reasons_long(customers(ts), explainer, 5)


@register("tune_rf", None)
def q_tune_rf(spark, sf):
    """Randomized search + stratified 3-fold CrossValidator for a forest (seeded draws)."""
    ts = training(spark, sf)
    _, fitted = comparison(spark, sf)
    fm, info = TR.tune(ts, "RandomForest", fitted, n_iter=TUNE_DRAWS, scale_iters=TUNE_ITER_SCALE)
    metrics = TR.evaluate_model(fm, ts)
    row = [("RandomForest", float(info["cv_auc"]), TR.params_json(info["params"]),
            *[float(metrics[m]) for m in S.METRIC_NAMES])]
    return spark.createDataFrame(
        row, "model string, cv_roc_auc double, best_params string, " + ", ".join(f"{m} double" for m in S.METRIC_NAMES)
    )


# ---------------------------------------------------------------------------------------
# F5 sampled Shapley
# ---------------------------------------------------------------------------------------
from ..operators import shapley as SH  # noqa: E402
from ..operators.features import CANONICAL_FEATURES  # noqa: E402
from ..operators.linear import scorecard  # noqa: E402
from .catalog import _contrib_sql, features_tbl  # noqa: E402
from . import oracle as O  # noqa: E402

#: sampled_shapley's background is the one of its SQL.
SHAPLEY_BG, SHAPLEY_PERMS = 10, 2
FOREST_BG = 100


@register(
    "sampled_shapley",
    O.with_ctes(
        f"SELECT customerID, feature, {O.rnd('impact', 4)} AS phi FROM ct",
        f"bg AS (SELECT * FROM oh ORDER BY {O.md5_key(3)}, customerID LIMIT {SHAPLEY_BG})",
        f"ct AS ({_contrib_sql('oh', 'bg')})",
        upto=5,
    ),
)
def q_sampled_shapley(spark, sf):
    """Permutation Shapley of the scorecard in log-odds space over every customer.

    For an additive model this must equal the closed-form linear contributions
    against the same background, which is what the oracle computes."""
    feats = features_tbl(spark, sf)
    bg = EX.background_sample(feats, SHAPLEY_BG, 3)
    phi = SH.sampled_shapley(feats, CANONICAL_FEATURES, SH.linear_array_score(scorecard(), "logit"), bg,
                             m=SHAPLEY_PERMS, seed=7)
    return phi.select("customerID", "feature", round_half_even(F.col("phi"), 4).alias("phi"))


def fitted_model(spark, sf, name: str) -> TR.FittedModel:
    """The candidate of this name: from the comparison if that has run, else fitted alone."""
    done = _CACHE.get(("cmp",) + _key(spark, sf))
    if done:
        return done[1][name]
    k = ("fit", name) + _key(spark, sf)
    if k not in _CACHE:
        _CACHE[k] = TR.fit(name, training(spark, sf), trees=QUERY_TREES, rounds=QUERY_ROUNDS)
    return _CACHE[k]


def _forest(spark, sf):
    """The forest, its exact explainer against FOREST_BG training rows, and those rows."""
    ts = training(spark, sf)
    rf = fitted_model(spark, sf, "RandomForest")
    bg = EX.background_sample(ts.train, FOREST_BG, 3)
    return ts, rf, TX.TreeExplainer.fit(rf.model, ts.features, bg), bg


@register("shapley_forest", None)
def q_shapley_forest(spark, sf):
    """Exact Shapley values of the forest's probability for every customer and feature."""
    ts, _, explainer, _ = _forest(spark, sf)
    phi = TX.tree_shapley(customers(ts), explainer, S.KEY)
    return phi.select("customerID", "feature", round_half_even(F.col("phi"), 6).alias("phi"))


@register("shapley_efficiency", None)
def q_shapley_efficiency(spark, sf):
    """Sum of the exact values against the model's own scores of customers and background."""
    ts, rf, explainer, bg = _forest(spark, sf)
    phi = TX.tree_shapley(customers(ts), explainer, S.KEY)
    return SH.efficiency_gap(phi, customers(ts), ts.features, SH.ml_array_score(rf.model), bg)


def boosted_scorer(spark, sf) -> tuple[TR.ModelScorer, TX.TreeExplainer]:
    """The boosted trees as scorer and explainer, both from saved artifacts."""
    ts = training(spark, sf)
    gbt = fitted_model(spark, sf, "GBT")
    path = scratch_path(spark, "artifacts")
    runs = spark.createDataFrame([("GBT", *[0.0] * len(S.METRIC_NAMES))], "model string, " + ", ".join(f"{m} double" for m in S.METRIC_NAMES))
    TR.save_artifacts(spark, path, gbt, ts, TR.training_metadata(spark, runs, "GBT", {}, ts))
    scorer = TR.load_scorer(spark, path)
    bg = EX.background_sample(ts.train, 100, 1)
    return scorer, TX.TreeExplainer.fit(scorer.model, scorer.feature_names, bg)


@register("score_batch_trees", None)
def q_score_batch_trees(spark, sf):
    """Every customer scored by the boosted trees with its five main reasons in log-odds."""
    from ..operators import score as SC
    from .catalog import raw

    scorer, explainer = boosted_scorer(spark, sf)
    out = SC.score_batch(raw(spark, sf), scorer, explainer=explainer)
    return out.select("customerID", "ChurnProbability", "Prediction", "RiskLevel", F.posexplode("top_reasons").alias("pos", "r")).select(
        "customerID", "ChurnProbability", "Prediction", "RiskLevel", (F.col("pos") + 1).alias("rank"), "r.*"
    )


@register("score_batch_lr", None)
def q_score_batch_lr(spark, sf):
    """Batch scoring of every customer with the trained logistic model as expressions."""
    from ..operators import score as SC
    from .catalog import public, raw

    ts = training(spark, sf)
    fm = TR.fit("LogisticRegression", ts)
    scorer = TR.to_linear_scorer(fm, ts)
    return public(SC.score_batch(raw(spark, sf), scorer))


@register("saved_pipeline", None)
def q_saved_pipeline(spark, sf):
    """Preparation and model as one saved pipeline: every raw row scored by it before saving and after loading."""
    from pyspark.ml import PipelineModel

    from ..operators import stages as SG
    from .catalog import raw

    table = scratch_path(spark, "pipeline-raw")
    raw(spark, sf).write.parquet(table)
    rows = spark.read.parquet(table)
    model = SG.fit_churn_pipeline(rows, "LogisticRegression")
    path = scratch_path(spark, "pipeline-model")
    model.write().overwrite().save(path)
    key = [S.KEY, S.ORDER_COL]
    before = SG.score_customers(model, rows).select(*key, F.col("p_raw").alias("p_before"))
    after = SG.score_customers(PipelineModel.load(path), rows).select(*key, F.col("p_raw").alias("p_after"))
    joined = before.join(after, key)
    same = F.col("p_before").eqNullSafe(F.col("p_after")).alias("identical")
    return joined.select(*key, round_half_even(F.col("p_after"), 6).alias("p"), same)
