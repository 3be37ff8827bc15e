"""Per-feature explanations of linear scores.

For a linear model in log-odds space the SHAP value of feature f is exactly
coef_f * (x'_f - E_bg[x'_f]) (x' = model input, i.e. scaled when the model was
trained on scaled features). The background expectation is a vector with one
entry per feature; it is fitted once (a single aggregate over a bounded
sample) and enters the plan as literals, so explaining every customer is a
per-row array expression: no join, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import md5_order_key, round_half_even, sql_double, sql_ident, sql_str
from .linear import LinearScorer


def background_sample(features: DataFrame, n: int, seed: int, key: str = S.KEY) -> DataFrame:
    """Fixed-seed sample of ``n`` rows: smallest md5('seed:key'), key as tie-break.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its
    own top-n and only n x #tasks rows reach the final merge.
    """
    order = md5_order_key(F.col(key), seed)
    return features.withColumn("_bg", order).orderBy("_bg", key).limit(n).drop("_bg")


@dataclass
class LinearExplainer:
    scorer: LinearScorer
    baseline: dict[str, float] | None  # None -> background is the explained row itself

    @classmethod
    def fit(cls, scorer: LinearScorer, background: DataFrame) -> "LinearExplainer":
        names = scorer.feature_names
        row = background.agg(*[F.avg(scorer.model_input(f)).alias(f"m{i}") for i, f in enumerate(names)]).first()
        return cls(scorer, {f: row[f"m{i}"] for i, f in enumerate(names)})

    @classmethod
    def self_background(cls, scorer: LinearScorer) -> "LinearExplainer":
        """No background table: the row is its own background, so every contribution is 0."""
        return cls(scorer, None)

    def impact_sql(self, feature: str) -> str:
        coef = sql_double(self.scorer.coefficients.get(feature, 0.0))
        x = self.scorer.model_input_sql(feature)
        if self.baseline is None:
            return f"({coef} * ({x} - {x}))"
        mean = self.baseline.get(feature)
        if mean is None:
            return sql_double(0.0)
        return f"({coef} * ({x} - {sql_double(mean)}))"

    def impact(self, feature: str) -> Column:
        return F.expr(self.impact_sql(feature))

    def contributions_sql(self) -> str:
        entries = []
        for i, f in enumerate(self.scorer.feature_names):
            imp = self.impact_sql(f)
            entries.append(
                f"named_struct('k', -abs({imp}), 'idx', {i}, 'feature', {sql_str(f)}, "
                f"'value', CAST({sql_ident(f)} AS DOUBLE), 'impact', {imp})"
            )
        return "array(" + ", ".join(entries) + ")"

    def contributions(self) -> Column:
        """array<struct<k, idx, feature, value, impact>> over all model features, in list
        order; k = -|impact| makes the struct's natural order the reason ranking.
        Built as one SQL expression (a single parse on the JVM side)."""
        return F.expr(self.contributions_sql())


def top_reason_array(explainer: LinearExplainer, n: int) -> Column:
    """The n entries with the largest |impact|, ties in feature order (a stable sort).

    ``sort_array`` over struct(-|impact|, idx, ...) uses the built-in struct
    ordering (native comparator) instead of an interpreted lambda comparator.
    """
    return F.slice(F.sort_array(explainer.contributions()), 1, n)


def reasons_long(features: DataFrame, explainer: LinearExplainer, n: int = 5, key: str = S.KEY) -> DataFrame:
    """(key, rank, feature, value, impact 4dp, direction): the n largest |impact| per row."""
    arr = top_reason_array(explainer, n)
    exploded = features.select(F.col(key), F.posexplode(arr).alias("pos", "r"))
    return exploded.select(
        F.col(key),
        (F.col("pos") + 1).alias("rank"),
        F.col("r.feature").alias("feature"),
        F.col("r.value").alias("value"),
        round_half_even(F.col("r.impact"), 4).alias("impact"),
        F.when(F.col("r.impact") > 0, F.lit("increases")).otherwise(F.lit("decreases")).alias("direction"),
    )


def reasons_struct(explainer: LinearExplainer, n: int = 5) -> Column:
    """Reasons as array<struct<feature, value, impact, direction>> (the response shape)."""
    return F.transform(
        top_reason_array(explainer, n),
        lambda r: F.struct(
            r["feature"].alias("feature"),
            r["value"].alias("value"),
            round_half_even(r["impact"], 4).alias("impact"),
            F.when(r["impact"] > 0, F.lit("increases")).otherwise(F.lit("decreases")).alias("direction"),
        ),
    )


def reasons_sorted(features: DataFrame, explainer: LinearExplainer, n: int = 8, key: str = S.KEY) -> DataFrame:
    """Top-n reasons re-ordered by signed impact, with chart and table direction labels."""
    arr = top_reason_array(explainer, n)
    by_signed = F.sort_array(
        F.transform(arr, lambda r: F.struct(r["impact"].alias("k"), r["idx"].alias("idx"),
                                            r["feature"].alias("feature"), r["impact"].alias("impact")))
    )
    exploded = features.select(F.col(key), F.posexplode(by_signed).alias("pos", "r"))
    up = F.col("r.impact") > 0
    return exploded.select(
        F.col(key),
        (F.col("pos") + 1).alias("position"),
        F.col("r.feature").alias("feature"),
        round_half_even(F.col("r.impact"), 4).alias("impact"),
        F.when(up, F.lit("Increases churn")).otherwise(F.lit("Decreases churn")).alias("direction_label"),
        F.initcap(F.when(up, F.lit("increases")).otherwise(F.lit("decreases"))).alias("direction_title"),
    )


def contributions_long(features: DataFrame, explainer: LinearExplainer, key: str = S.KEY) -> DataFrame:
    exploded = features.select(F.col(key), F.explode(explainer.contributions()).alias("r"))
    return exploded.select(F.col(key), "r.idx", "r.feature", "r.value", "r.impact")


def global_importance(sample: DataFrame, explainer: LinearExplainer, top: int = 15, key: str = S.KEY) -> DataFrame:
    """Mean |impact| per feature over the sample; the ``top`` features."""
    long = contributions_long(sample, explainer, key)
    agg = long.groupBy("idx", "feature").agg(
        F.avg(F.abs("impact")).alias("_m"), F.max(F.abs("impact")).alias("_mx")
    )
    ranked = agg.orderBy(F.desc(round_half_even(F.col("_m"), 10)), F.asc("idx")).limit(top)
    return ranked.select(
        "feature",
        round_half_even(F.col("_m"), 4).alias("mean_abs_impact"),
        round_half_even(F.col("_mx"), 4).alias("max_abs_impact"),
    )


QUANTILES = (0.25, 0.5, 0.75)


def impact_states(features: DataFrame, explainer: LinearExplainer, key: str = S.KEY, k: int = 2048) -> DataFrame:
    """Mergeable state of each feature's impacts: count, sum of absolutes, extremes, and a KLL sketch.

    Sketches are built in the map tasks and merged after the shuffle, so a task sends one
    sketch of about ``k`` values for each feature, however many customers it read. Up to ``k`` customers a
    sketch holds every value and its quantiles are exact; beyond that a quantile's rank is off by
    about 2.3 / k^0.9 of the count (99 % of the time). Null impacts are not counted; no customers, no rows.
    States of other days or tables can be united and passed to `merge_states`.
    """
    long = contributions_long(features, explainer, key).filter("impact IS NOT NULL")
    return long.groupBy("idx", "feature").agg(
        F.count("*").alias("n"),
        F.sum(F.abs("impact")).alias("sum_abs"),
        F.min("impact").alias("least"),
        F.max("impact").alias("most"),
        F.kll_sketch_agg_double("impact", F.lit(k)).alias("sketch"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """States of several tables or days as one for each feature."""
    return states.groupBy("idx", "feature").agg(
        F.sum("n").alias("n"),
        F.sum("sum_abs").alias("sum_abs"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def importance_distribution(states: DataFrame, digits: int = 4) -> DataFrame:
    """Spread of each feature's impacts over all customers: the numbers behind a beeswarm or box plot.

    Quartiles are the smallest impact with at least that share of customers at or below it.
    """
    cuts = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in QUANTILES]))
    named = {"q1_impact": F.col("cuts")[0], "median_impact": F.col("cuts")[1], "q3_impact": F.col("cuts")[2]}
    spread = {"mean_abs_impact": F.col("sum_abs") / F.col("n"), "min_impact": F.col("least"), **named, "max_impact": F.col("most")}
    return states.withColumn("cuts", cuts).select(
        "feature", "n", *[round_half_even(value, digits).alias(name) for name, value in spread.items()]
    )
