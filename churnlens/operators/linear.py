"""Linear scorers as column expressions: the frozen scorecard and fitted logistic models.

A linear model is (intercept, ordered terms, optional population scaler). Its
score is a single codegen'd expression, so batch and stream scoring need no
model broadcast beyond a few dozen literals and no Python in the hot path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c, sql_double, sql_ident
from .features import CANONICAL_FEATURES

# fixed values: the frozen scorecard S (closed-form churn logit; noise term left out,
# 0.012 * (monthly - 65) folded into the intercept). Terms in evaluation order.
SCORECARD_INTERCEPT = -2.38
SCORECARD_TERMS = [
    ("MonthlyCharges", 0.012),
    ("tenure", -0.045),
    ("SeniorCitizen", 0.25),
    ("Contract_Month-to-month", 1.05),
    ("Contract_One year", -0.35),
    ("Contract_Two year", -1.4),
    ("InternetService_Fiber optic", 0.55),
    ("InternetService_No", -0.6),
    ("OnlineSecurity_No", 0.35),
    ("TechSupport_No", 0.35),
    ("PaperlessBilling_Yes", 0.25),
    ("PaymentMethod_Electronic check", 0.35),
    ("Partner_No", 0.15),
    ("Dependents_No", 0.10),
]


@dataclass
class LinearScorer:
    """p = sigmoid(intercept + sum_i coef_i * x'_i), x' = (x - mean) / scale when scaled."""

    intercept: float
    terms: list[tuple[str, float]]
    feature_names: list[str]
    scaler: dict[str, tuple[float, float]] | None = None
    name: str = "linear"
    meta: dict = field(default_factory=dict)

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(self.terms)

    def model_input_sql(self, feature: str) -> str:
        x = f"CAST({sql_ident(feature)} AS DOUBLE)"
        if self.scaler and feature in self.scaler:
            mean, scale = self.scaler[feature]
            return f"(({x} - {sql_double(mean)}) / {sql_double(scale)})"
        return x

    def model_input(self, feature: str) -> Column:
        return F.expr(self.model_input_sql(feature))

    def logit_sql(self) -> str:
        z = sql_double(self.intercept)
        for feature, coef in self.terms:
            if coef == 0.0:
                continue
            z = f"({z} + {sql_double(coef)} * {self.model_input_sql(feature)})"
        return z

    def logit(self) -> Column:
        return F.expr(self.logit_sql())

    def probability(self) -> Column:
        one = sql_double(1.0)
        return F.expr(f"{one} / ({one} + exp(-({self.logit_sql()})))")

    def score(self, features: DataFrame, out: str = "p_raw") -> DataFrame:
        return features.withColumn(out, self.probability())

    @property
    def needs_scaling(self) -> bool:
        return bool(self.scaler)


def scorecard() -> LinearScorer:
    """The frozen scorecard ``S`` over the 55 canonical features (unscaled)."""
    return LinearScorer(
        intercept=SCORECARD_INTERCEPT,
        terms=list(SCORECARD_TERMS),
        feature_names=list(CANONICAL_FEATURES),
        scaler=None,
        name="Scorecard",
    )
