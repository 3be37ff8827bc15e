"""Preparation as ``pyspark.ml`` stages: records, high-value threshold, levels, scaling, class weights.

``churn_pipeline`` puts them before a classifier, so one saved ``PipelineModel``
holds everything a score depends on and takes raw customers. All stages are
projections of built-in expressions once they are fitted. What a fit brings to
the driver is one threshold, the levels (bounded by ``MAX_VOCAB_LEVELS``), two
numbers a feature and two class counts.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import c
from .clean import clean, coerce_total, impute_total_online, normalize_target
from .evaluate import PopulationScaler
from .features import NUMERIC_FEATURES, HighValueThreshold, OneHotVocabulary, add_features
from .train import SCALED, estimator, probability
from .validate import apply_defaults


class _Stored(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters as JSON beside the class name, the layout of all ``pyspark.ml`` stages."""


class CustomerRecords(Transformer, _Stored):
    """Raw customers to typed rows by the record rules: defaults, monthly x max(tenure, 1) totals, one row in, one out.

    A target that is there becomes 0 / 1; rows without one pass.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df = apply_defaults(dataset)
        if S.TARGET in df.columns:
            df = normalize_target(df)
        df = impute_total_online(coerce_total(df))
        return df.withColumns({n: F.col(n).cast(t) for n, t in (("SeniorCitizen", "int"), ("tenure", "int"), ("MonthlyCharges", "double"))})


class HighValueFeatures(Estimator, _Stored):
    """Learns the high-value threshold (the 0.75 quantile of the charges, by ranges)."""

    def _fit(self, dataset: DataFrame) -> HighValueFeaturesModel:
        value = HighValueThreshold.fit(dataset).threshold
        return HighValueFeaturesModel() if value is None else HighValueFeaturesModel()._set(threshold=value)


class HighValueFeaturesModel(Model, _Stored):
    """Adds the derived features; without a threshold (a fit on no charges) nobody is high-value."""

    threshold = Param(Params._dummy(), "threshold", "charges above this are high-value", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = self.getOrDefault(self.threshold) if self.isSet(self.threshold) else None
        return add_features(dataset, HighValueThreshold(mode="fitted", threshold=value))


class OneHot(Estimator, _Stored):
    """Learns the levels of the categorical columns from their distinct rows."""

    def _fit(self, dataset: DataFrame) -> OneHotModel:
        return OneHotModel()._set(levels=OneHotVocabulary.fit(dataset).levels)


class OneHotModel(Model, _Stored):
    """Adds one 0 / 1 column a level; unseen levels and nulls are 0 in all."""

    levels = Param(Params._dummy(), "levels", "sorted levels of each column")

    def vocabulary(self) -> OneHotVocabulary:
        return OneHotVocabulary(self.getOrDefault(self.levels))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(self.vocabulary().expressions())


class FeatureVector(Estimator, _Stored):
    """Learns mean and population deviation of each feature (if ``scaled``) and their order."""

    scaled = Param(Params._dummy(), "scaled", "scale by population deviation", TypeConverters.toBoolean)

    def _fit(self, dataset: DataFrame) -> FeatureVectorModel:
        dummies = [f"{x}_" for x in S.ENCODED_COLUMNS]
        names = [x for x in NUMERIC_FEATURES if x in dataset.columns]
        names += [x for x in dataset.columns if x not in names and any(x.startswith(d) for d in dummies)]
        stats = PopulationScaler.fit(dataset, names).stats if self.getOrDefault(self.scaled) else {}
        return FeatureVectorModel()._set(names=names, stats={k: list(v) for k, v in stats.items()})


class FeatureVectorModel(Model, _Stored):
    """Assembles ``features`` and drops the dummy columns."""

    names = Param(Params._dummy(), "names", "features in order", TypeConverters.toListString)
    stats = Param(Params._dummy(), "stats", "mean and scale of each feature; empty if unscaled")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, stats = self.getOrDefault(self.names), self.getOrDefault(self.stats)
        inputs = []
        for i, name in enumerate(names):
            mean, scale = stats.get(name, (0.0, 1.0))
            x = c(name).cast("double")
            inputs.append(((x - F.lit(mean)) / F.lit(scale) if stats else x).alias(f"_f{i}"))
        columns = [f"_f{i}" for i in range(len(names))]
        assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
        dummies = set(names) - set(NUMERIC_FEATURES)
        kept = [c(x) for x in dataset.columns if x not in dummies]
        return assembler.transform(dataset.select(*kept, *inputs)).drop(*columns)


class ClassWeights(Estimator, _Stored):
    """Learns the weight of each class: ``balanced``, ``positive`` (negatives / positives) or ``none``."""

    kind = Param(Params._dummy(), "kind", "balanced, positive or none", TypeConverters.toString)

    def _fit(self, dataset: DataFrame) -> ClassWeightsModel:
        y = F.col(S.TARGET)
        n = dataset.agg(F.count_if(y == 0).alias("neg"), F.count_if(y == 1).alias("pos")).first()
        neg, pos, kind = n["neg"], n["pos"], self.getOrDefault(self.kind)
        kinds = (neg > 0) + (pos > 0)
        if kind == "balanced":
            weights = [(neg + pos) / (kinds * m) if m else 0.0 for m in (neg, pos)]
        else:
            weights = [1.0, neg / pos if kind == "positive" and pos else 1.0]
        return ClassWeightsModel()._set(weights=weights)


class ClassWeightsModel(Model, _Stored):
    """Adds ``weight`` to rows that have a target column; rows to be scored have none and pass."""

    weights = Param(Params._dummy(), "weights", "weights of class 0 and 1", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if S.TARGET not in dataset.columns:
            return dataset
        neg, pos = self.getOrDefault(self.weights)
        return dataset.withColumn("weight", F.when(F.col(S.TARGET) == 1, pos).when(F.col(S.TARGET) == 0, neg))


WEIGHTS = {"LogisticRegression": "balanced", "DecisionTree": "balanced", "RandomForest": "balanced", "GBTWeighted": "positive"}


def churn_pipeline(name: str, n_train: int | None = None, trees: int = 300, rounds: int = 300, seed: int = 42) -> Pipeline:
    """All stages from raw customers to a classifier; fit it on customers without repeats."""
    vector = FeatureVector()._set(scaled=name in SCALED)
    weights = ClassWeights()._set(kind=WEIGHTS.get(name, "none"))
    model = estimator(name, trees, rounds, n_train, seed)
    return Pipeline(stages=[CustomerRecords(), HighValueFeatures(), OneHot(), vector, weights, model])


def fit_churn_pipeline(raw: DataFrame, name: str, **sizes):
    """Clean (first row of each customer, batch rules), cut the lineage once, fit."""
    customers = clean(raw).checkpoint(eager=True)
    return churn_pipeline(name, n_train=customers.where(F.col(S.TARGET).isNotNull()).count(), **sizes).fit(customers)


def score_customers(model, raw: DataFrame) -> DataFrame:
    """Every raw customer with the unrounded probability ``p_raw``; a target column is ignored."""
    scored = probability(model.transform(raw.drop(S.TARGET)), "p_raw")
    return scored.drop("features", "rawPrediction", "probability", "prediction")
