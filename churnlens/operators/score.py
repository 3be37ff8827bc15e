"""Scoring: probability, label, risk level, batch and record-at-a-time scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import prediction_label, risk_level, round_half_even, tenure_group
from .clean import assign_row_ids, clean, impute_total_online
from .explain import reasons_struct
from .features import add_features, encode_for
from .validate import apply_defaults
from .trees import TreeExplainer, dealt_to_tasks


def feature_frame(df: DataFrame, scorer, high_value="batch", keep=(S.KEY, S.ORDER_COL)) -> DataFrame:
    """add_features + one-hot/align to the scorer's feature list, keeping id columns."""
    featured = add_features(df, high_value)
    return encode_for(featured, scorer.feature_names, keep=list(keep))


def predict_proba(df: DataFrame, scorer, high_value="batch", keep=(S.KEY, S.ORDER_COL)) -> DataFrame:
    """P(churn) per row of a clean table; ``p_raw`` is unrounded."""
    return scorer.score(feature_frame(df, scorer, high_value, keep), out="p_raw")


def attach_scores(clean_df: DataFrame, scorer, high_value="batch", round_digits: int = 4, explainer=None, top_n: int = 5) -> DataFrame:
    """Clean rows + ChurnProbability (rounded) + Prediction + RiskLevel + TenureGroup (+ p_raw, + top_reasons with an explainer).

    Scores are computed in the same projection as the clean columns (no join back):
    the feature expressions are evaluated inline and only ``p_raw`` survives.
    """
    featured = add_features(clean_df, high_value)
    if isinstance(explainer, TreeExplainer):
        featured = dealt_to_tasks(featured)
    encoded = encode_for(featured, scorer.feature_names, keep=list(featured.columns))
    scored = scorer.score(encoded, out="p_raw")
    p = F.col("p_raw")
    base = [x for x in clean_df.columns]
    reasons = [reasons_struct(explainer, top_n).alias("top_reasons")] if explainer is not None else []
    return scored.select(
        *[F.col(f"`{x}`") for x in base],
        round_half_even(p, round_digits).alias("ChurnProbability"),
        prediction_label(p).alias("Prediction"),
        risk_level(p).alias("RiskLevel"),
        tenure_group(F.col("tenure")).alias("TenureGroup"),
        p,
        *reasons,
    )


def score_batch(raw: DataFrame, scorer, high_value="batch", explainer=None, top_n: int = 5) -> DataFrame:
    """Drop target -> clean -> ROW-n ids if there is no key -> features -> align -> score -> labels (-> reasons).

    The scorer is a LinearScorer with a LinearExplainer or a ModelScorer with a
    TreeExplainer; the reasons come from the same features as the score.
    """
    cleaned = clean(raw.drop(S.TARGET))
    if S.KEY not in cleaned.columns:
        if S.ORDER_COL not in cleaned.columns:
            cleaned = cleaned.withColumn(S.ORDER_COL, F.monotonically_increasing_id())
        cleaned = assign_row_ids(cleaned)
    return attach_scores(cleaned, scorer, high_value, explainer=explainer, top_n=top_n)


def score_records(records: DataFrame, scorer, high_value="single", explainer=None, top_n: int = 5) -> DataFrame:
    """Record-at-a-time semantics, set-based: each row scored as its own frame.

    Defaults for absent fields, the online total rule (monthly x max(tenure, 1)),
    high-value flag 0 (``single``), no dedup, and the key kept.
    """
    work = apply_defaults(records.drop(S.TARGET))
    work = impute_total_online(work)
    for name, t in (("SeniorCitizen", "int"), ("tenure", "int"), ("MonthlyCharges", "double")):
        work = work.withColumn(name, F.col(name).cast(t))
    return attach_scores(work, scorer, high_value, explainer=explainer, top_n=top_n)


def public_columns(scored: DataFrame) -> list[str]:
    return [x for x in scored.columns if x != "p_raw"]
