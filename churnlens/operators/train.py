"""Model training, comparison, tuning and artifacts on ``pyspark.ml``.

* Five candidates: weighted logistic regression on population-scaled features,
  decision tree, random forest and two gradient-boosted tree variants.
  Tree/round counts are parameters (reference values are the defaults).
* Class weights come from scalar subqueries (no join, no collect of rows).
* Candidates are fitted side by side; their jobs share the cores.
* Tuning is a ``CrossValidator`` over seeded random draws with a stratified,
  precomputed ``foldCol`` and ``parallelism`` for concurrent fits, which no end of a fold interrupts.
* A fitted logistic model converts into a ``LinearScorer`` so scoring and
  explanations run as plain column expressions (batch and stream).

Driver-side state is bounded: the runs table has one row per fitted model.
"""

from __future__ import annotations

import json
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, tuning
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.exprs import c
from . import evaluate as EV
from .features import CANONICAL_FEATURES, add_features, encode_for
from .linear import LinearScorer

CANDIDATES = ["LogisticRegression", "DecisionTree", "RandomForest", "GBTWeighted", "GBT"]
SCALED = {"LogisticRegression"}

# Randomized-search spaces on the parameters that pyspark.ml has; values equal the reference's where the
# parameter is the same (depth, learning rate, rounds, row and column sampling, trees, leaf size).
# maxBins and minInfoGain are Spark's own.
SEARCH_SPACES = {
    "GBTWeighted": {
        "maxDepth": [3, 4, 5, 6, 8],
        "stepSize": [0.01, 0.03, 0.05, 0.1],
        "maxIter": [200, 300, 400, 600],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
        "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
    },
    "GBT": {
        "maxDepth": [3, 4, 5, 6, 8, 12],
        "stepSize": [0.01, 0.03, 0.05, 0.1],
        "maxIter": [200, 300, 400, 600],
        "maxBins": [15, 31, 63],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    },
    "RandomForest": {
        "numTrees": [200, 300, 400, 600],
        "maxDepth": [6, 8, 10, 14, 20],
        "minInstancesPerNode": [1, 2, 4],
        "minInfoGain": [0.0, 0.001, 0.01],
    },
}


#: Rows of a partition of the folds of a search, if there are so many.
SEARCH_ROWS = 50_000


@dataclass
class TrainingSet:
    train: DataFrame
    test: DataFrame
    features: list[str]
    scaler: EV.PopulationScaler
    n_train: int = 0
    n_test: int = 0


def prepare(clean_df: DataFrame, test_size: float = 0.2, seed: int = 42) -> TrainingSet:
    """Features (quantile and levels fitted before the split, as the reference does),
    exact stratified split, population scaler fitted on train rows only."""
    split = EV.stratified_split(clean_df, test_size, seed)
    feats = encode_for(add_features(split), CANONICAL_FEATURES, keep=[S.KEY, S.ORDER_COL, S.TARGET, "split"])
    # fits iterate over the data many times: cut the lineage once into the shared
    # checkpoint folder (also what a lost executor recomputes from)
    feats = feats.checkpoint(eager=True)
    train = feats.where(F.col("split") == "train").drop("split")
    test = feats.where(F.col("split") == "test").drop("split")
    scaler = EV.PopulationScaler.fit(train, CANONICAL_FEATURES)
    counts = feats.groupBy("split").count().collect()  # two rows
    sizes = {r["split"]: r["count"] for r in counts}
    return TrainingSet(train, test, list(CANONICAL_FEATURES), scaler, sizes.get("train", 0), sizes.get("test", 0))


def with_vector(df: DataFrame, ts: TrainingSet, scaled: bool, out: str = "features") -> DataFrame:
    """Assemble the model input vector; scaling is done as column expressions first."""
    cols = []
    for f in ts.features:
        x = c(f).cast("double")
        if scaled:
            mean, scale = ts.scaler.stats[f]
            x = (x - F.lit(mean)) / F.lit(scale)
        cols.append(x.alias(f"_f{len(cols)}"))
    keep = [F.col(k) for k in (S.KEY, S.ORDER_COL, S.TARGET, "weight", "_fold") if k in df.columns]
    staged = df.select(*keep, *cols)
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(cols))], outputCol=out, handleInvalid="keep")
    return assembler.transform(staged).drop(*[f"_f{i}" for i in range(len(cols))])


def estimator(name: str, trees: int = 300, rounds: int = 300, n_train: int | None = None, seed: int = 42):
    label, weight = S.TARGET, "weight"
    if name == "LogisticRegression":
        reg = 1.0 / n_train if n_train else 0.0
        return LogisticRegression(
            labelCol=label, featuresCol="features", weightCol=weight, maxIter=1000, regParam=reg,
            elasticNetParam=0.0, standardization=False, tol=1e-4,
        )
    if name == "DecisionTree":
        return DecisionTreeClassifier(labelCol=label, weightCol=weight, maxDepth=6, seed=seed)
    if name == "RandomForest":
        return RandomForestClassifier(
            labelCol=label, weightCol=weight, numTrees=trees, maxDepth=10, featureSubsetStrategy="sqrt", seed=seed,
            cacheNodeIds=True,  # rows do not go down every tree from its root again for each level
        )
    if name == "GBTWeighted":
        return GBTClassifier(labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=5, stepSize=0.05, seed=seed)
    if name == "GBT":
        return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=6, stepSize=0.05, seed=seed)
    raise ValueError(f"unknown model {name}")


def add_weights(df: DataFrame, name: str) -> DataFrame:
    if name in ("LogisticRegression", "DecisionTree", "RandomForest"):
        return EV.balanced_weights(df.withColumn(S.TARGET, F.col(S.TARGET).cast("int")))
    if name == "GBTWeighted":
        return EV.pos_weight(df)
    return df.withColumn("weight", F.lit(1.0))


def probability(df: DataFrame, out: str = "p_raw") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col("probability"))[1])


@dataclass
class FittedModel:
    name: str
    model: object
    scaled: bool
    seconds: float
    params: dict = field(default_factory=dict)

    def score(self, df: DataFrame, ts: TrainingSet) -> DataFrame:
        vec = with_vector(df, ts, self.scaled)
        return probability(self.model.transform(vec))


def fit(name: str, ts: TrainingSet, trees: int = 300, rounds: int = 300, seed: int = 42) -> FittedModel:
    train = add_weights(ts.train, name)
    # the fit scans its input several times before caching it itself: persist the
    # assembled vectors once so weights (scalar subqueries) are computed once
    vec = with_vector(train, ts, name in SCALED).persist()
    est = estimator(name, trees, rounds, ts.n_train, seed)
    t0 = time.time()
    try:
        model = est.fit(vec)
    finally:
        vec.unpersist()
    secs = time.time() - t0
    params = {p.name: v for p, v in est.extractParamMap().items() if isinstance(v, (int, float, str, bool))}
    return FittedModel(name, model, name in SCALED, secs, params)


RUN_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("train_seconds", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)


def evaluate_model(fm: FittedModel, ts: TrainingSet) -> dict:
    # one model pass over the test rows; the metric passes reuse it
    scored = fm.score(ts.test, ts).select(S.KEY, S.TARGET, "p_raw").persist()
    try:
        row = EV.evaluate(scored).first().asDict()
    finally:
        scored.unpersist()
    return {k: row[k] for k in S.METRIC_NAMES}


def compare_models(spark: SparkSession, ts: TrainingSet, names=None, trees: int = 300, rounds: int = 300):
    """Fit every candidate, evaluate on the test split; returns (runs DataFrame, fitted models).

    The candidates run side by side, so ``train_seconds`` is the time until each was fitted, not its share of the cores.
    """
    names = list(names or CANDIDATES)

    def run(name: str) -> tuple[FittedModel, dict]:
        fm = fit(name, ts, trees, rounds)
        return fm, evaluate_model(fm, ts)

    with ThreadPoolExecutor(max(1, len(names))) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(run), name) for name in names]
        done = [r.result() for r in runs]
    rows, fitted = [], {}
    for i, (name, (fm, m)) in enumerate(zip(names, done, strict=True)):
        fitted[name] = fm
        rows.append((i, name, m["accuracy"], m["precision"], m["recall"], m["f1"], m["roc_auc"],
                     round(fm.seconds, 3), {k: str(v) for k, v in fm.params.items()}))
    return spark.createDataFrame(rows, RUN_SCHEMA), fitted


def select_best(runs: DataFrame) -> DataFrame:
    """Highest ROC-AUC; the earlier candidate wins ties."""
    return runs.orderBy(F.desc("roc_auc"), F.asc("position")).limit(1)


def metrics_long(runs: DataFrame) -> DataFrame:
    return runs.select("model", *S.METRIC_NAMES).unpivot(["model"], S.METRIC_NAMES, "metric", "score")


def models_ranked(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("roc_auc"), F.asc("position")).select("model", *S.METRIC_NAMES)


def random_draws(space: dict, n_iter: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    keys = sorted(space)
    return [{k: rng.choice(space[k]) for k in keys} for _ in range(n_iter)]


class CrossValidator(tuning.CrossValidator):
    """The search of pyspark.ml with precomputed folds, its fits of all folds in one pool: none waits for the last fit of a fold.

    Boosted ensembles start with the longest chain of rounds and levels; forests, whose nodes wait in the driver, come in the
    order of the draws. Equal draws have one fit for each fold, as it would give the same model again.
    """

    def _fit(self, dataset: DataFrame) -> tuning.CrossValidatorModel:
        est, grid, evaluator = self.getEstimator(), self.getEstimatorParamMaps(), self.getEvaluator()
        k = self.getNumFolds()
        draws = [tuple(sorted((p.name, v) for p, v in pm.items())) for pm in grid]
        todo = [(i, j) for i in range(k) for j, draw in enumerate(draws) if draws.index(draw) == j]
        if est.hasParam("maxIter"):
            todo.sort(key=lambda ij: -dict(draws[ij[1]]).get("maxIter", 1) * dict(draws[ij[1]]).get("maxDepth", 1))
        # fits side by side need few tasks each: a level of few rows takes less time than its task
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        few = dataset.coalesce(max(1, -(-dataset.count() // SEARCH_ROWS), -(-cores // self.getParallelism())))
        parts = [(train.persist(), held_out.persist()) for train, held_out in self._kFold(few)]
        try:

            def run(ij: tuple[int, int]) -> float:
                (train, held_out), params = parts[ij[0]], grid[ij[1]]
                return evaluator.evaluate(est.fit(train, params).transform(held_out, params))

            with ThreadPoolExecutor(self.getParallelism()) as pool:
                metrics = dict(zip(todo, pool.map(inheritable_thread_target(dataset.sparkSession)(run), todo), strict=True))
        finally:
            for part in parts:
                for frame in part:
                    frame.unpersist()
        by_fold = np.array([[metrics[i, draws.index(draw)] for draw in draws] for i in range(k)])
        means, spread = by_fold.mean(axis=0), by_fold.std(axis=0)
        best = int(np.argmax(means) if evaluator.isLargerBetter() else np.argmin(means))
        return tuning.CrossValidatorModel(est.fit(dataset, grid[best]), means.tolist(), [], spread.tolist())


def tune(ts: TrainingSet, best: str, fitted: dict, n_iter: int = 15, k: int = 3, seed: int = 42,
         scale_iters: float = 1.0, parallelism: int | None = None):
    """Randomized search with k-fold stratified CV by ROC-AUC; logistic/tree winners are not tuned.

    ``parallelism``: fits at a time; by default 4 forests, whose nodes all wait in the driver, or as many
    boosted ensembles as there are cores.
    """
    if best not in SEARCH_SPACES:
        return fitted[best], None
    space = SEARCH_SPACES[best]
    draws = random_draws(space, n_iter, seed)
    train = EV.cv_folds(add_weights(ts.train, best), k=k, seed=seed)
    # the folds are ranked once, not again for each fold and for the last fit
    vec = with_vector(train.withColumnRenamed("fold", "_fold"), ts, best in SCALED).checkpoint(eager=True)
    if parallelism is None:
        parallelism = 4 if best == "RandomForest" else max(4, vec.sparkSession.sparkContext.defaultParallelism)
    est = estimator(best, seed=seed)
    grid = []
    for d in draws:
        pm = {}
        for name, value in d.items():
            if name in ("maxIter", "numTrees"):
                value = max(1, int(round(value * scale_iters)))
            pm[est.getParam(name)] = value
        grid.append(pm)
    evaluator = BinaryClassificationEvaluator(labelCol=S.TARGET, rawPredictionCol="rawPrediction",
                                              metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=evaluator, numFolds=k,
                        foldCol="_fold", parallelism=parallelism, seed=seed)
    t0 = time.time()
    cvm = cv.fit(vec)
    secs = time.time() - t0
    best_i = max(range(len(cvm.avgMetrics)), key=lambda i: cvm.avgMetrics[i])
    best_params = {p.name: v for p, v in grid[best_i].items()}
    fm = FittedModel(best, cvm.bestModel, best in SCALED, secs, best_params)
    return fm, {"cv_auc": float(cvm.avgMetrics[best_i]), "params": best_params}


def to_linear_scorer(fm: FittedModel, ts: TrainingSet) -> LinearScorer:
    """A fitted logistic model as column expressions (coefficients on scaled inputs)."""
    coefs = fm.model.coefficients.toArray().tolist()
    return LinearScorer(
        intercept=float(fm.model.intercept),
        terms=list(zip(ts.features, coefs)),
        feature_names=list(ts.features),
        scaler=dict(ts.scaler.stats) if fm.scaled else None,
        name=fm.name,
    )


METADATA_SCHEMA = T.StructType(
    [
        T.StructField("best_model", T.StringType()),
        T.StructField("needs_scaling", T.BooleanType()),
        T.StructField("all_model_results", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
        T.StructField("tuned_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("train_size", T.LongType()),
        T.StructField("test_size", T.LongType()),
    ]
)


def training_metadata(spark: SparkSession, runs: DataFrame, best: str, tuned_metrics: dict, ts: TrainingSet) -> DataFrame:
    results = {r["model"]: {k: float(r[k]) for k in S.METRIC_NAMES} for r in runs.collect()}  # one row per model
    row = (best, best in SCALED, results, {k: float(v) for k, v in tuned_metrics.items()},
           len(ts.features), int(ts.n_train), int(ts.n_test))
    return spark.createDataFrame([row], METADATA_SCHEMA)


# ---------------------------------------------------------------------------------------
# artifacts and run log
# ---------------------------------------------------------------------------------------
ARTIFACTS = ["model", "scaler", "feature_names", "metadata"]


def save_artifacts(spark: SparkSession, path: str, fm: FittedModel, ts: TrainingSet, metadata: DataFrame) -> str:
    PipelineModel(stages=[fm.model]).write().overwrite().save(f"{path}/model")
    scaler_rows = [(f, m, s) for f, (m, s) in ts.scaler.stats.items()]
    spark.createDataFrame(scaler_rows, "feature string, mean double, scale double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame([(i, f) for i, f in enumerate(ts.features)], "idx int, feature string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/feature_names")
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_artifacts(spark: SparkSession, path: str):
    """Returns (PipelineModel, scaler stats, feature names, metadata row); lists what is missing."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        where = fs.Path(f"{path}/{name}")
        return where.getFileSystem(conf).exists(where)

    missing = [name for name in ARTIFACTS if not there(name)]
    if missing:
        raise FileNotFoundError("Missing model artifacts: " + ", ".join(missing))
    parts = {name: spark.read.parquet(f"{path}/{name}").collect() for name in ("scaler", "feature_names")}
    parts["model"] = PipelineModel.load(f"{path}/model")
    parts["metadata"] = spark.read.schema(METADATA_SCHEMA).json(f"{path}/metadata").first()
    scaler = {r["feature"]: (r["mean"], r["scale"]) for r in parts["scaler"]}
    names = [r["feature"] for r in sorted(parts["feature_names"], key=lambda r: r["idx"])]
    return parts["model"], scaler, names, parts["metadata"]


@dataclass
class ModelScorer:
    """A fitted pyspark.ml classifier with the interface of a LinearScorer: feature_names and score(features, out)."""

    name: str
    model: object
    feature_names: list[str]
    scaler: dict | None = None

    def score(self, features: DataFrame, out: str = "p_raw") -> DataFrame:
        inputs = []
        for i, f in enumerate(self.feature_names):
            x = c(f).cast("double")
            if self.scaler:
                mean, scale = self.scaler[f]
                x = (x - F.lit(mean)) / F.lit(scale)
            inputs.append(x.alias(f"_f{i}"))
        names = [f"_f{i}" for i in range(len(inputs))]
        assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        staged = assembler.transform(features.select("*", *inputs)).drop(*names)
        scored = probability(self.model.transform(staged), out)
        return scored.drop("features", "rawPrediction", "probability", "prediction")


def load_scorer(spark: SparkSession, path: str) -> LinearScorer | ModelScorer:
    """The saved model, ready for score_batch, score_records and score_stream.

    A logistic model comes back as a LinearScorer (column expressions, reasons
    in closed form), a tree ensemble as a ModelScorer.
    """
    pipeline, scaler, names, metadata = load_artifacts(spark, path)
    model = pipeline.stages[0]
    scaled = scaler if metadata["needs_scaling"] else None
    if isinstance(model, LogisticRegressionModel):
        terms = list(zip(names, model.coefficients.toArray().tolist()))
        return LinearScorer(float(model.intercept), terms, names, scaled, metadata["best_model"])
    return ModelScorer(metadata["best_model"], model, names, scaled)


def tuned_run(spark: SparkSession, best: str, fm: FittedModel, info: dict | None, metrics: dict) -> DataFrame:
    """The run row of the tuned winner: searched parameters and the cross-validated AUC beside its own ones."""
    params = fm.params | ({**info["params"], "cv_roc_auc": info["cv_auc"]} if info else {})
    row = (len(CANDIDATES), f"{best} (tuned)", *[float(metrics[m]) for m in ("accuracy", "precision", "recall", "f1", "roc_auc")],
           round(fm.seconds, 3), {k: str(v) for k, v in params.items()})
    return spark.createDataFrame([row], RUN_SCHEMA)


def log_run(runs: DataFrame, path: str, run_id: str) -> DataFrame:
    """Append the runs of one training job to a run table (one row per candidate)."""
    out = runs.withColumn("run_id", F.lit(run_id)).withColumn("logged_at", F.current_timestamp())
    out.write.mode("append").parquet(path)
    return out


def params_json(params: dict) -> str:
    return json.dumps({k: params[k] for k in sorted(params)}, default=str)
