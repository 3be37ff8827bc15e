"""Data preparation and evaluation: exact stratified split, CV folds, population
scaler, class weights, confusion metrics and exact ROC-AUC.

All of them are set-based Spark jobs. Split and folds use md5-ordered rank
bands (see ordering.py): a row's band needs its exact rank only inside the
handful of buckets that straddle a cut. AUC aggregates to distinct scores and
takes prefix sums of the negatives over ranges of them, so no window ever
spans the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import c, md5_order_key, round_half_even, safe_ratio
from .ordering import ceil_fraction, equal_folds, hash_bands, prefix_sums


# ---------------------------------------------------------------------------------------
# D1 stratified split, D16 folds
# ---------------------------------------------------------------------------------------
def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                     label: str = S.TARGET, key: str = S.KEY) -> DataFrame:
    """Adds ``split`` in {train, test}: per class, the ceil(test_size * n_c) rows with the
    smallest md5('seed:key') go to test, so class ratios are preserved exactly."""
    banded = hash_bands(df, label, md5_order_key(F.col(key), seed), key, ceil_fraction(test_size), "_band")
    return banded.withColumn("split", F.when(F.col("_band") == 0, "test").otherwise("train")).drop("_band")


def cv_folds(df: DataFrame, k: int = 3, seed: int = 42, label: str = S.TARGET, key: str = S.KEY) -> DataFrame:
    """Adds ``fold`` in 0..k-1: per class, contiguous runs of the md5 order (stratified k-fold)."""
    return hash_bands(df, label, md5_order_key(F.col(key), f"fold{seed}"), key, equal_folds(k), "fold")


# ---------------------------------------------------------------------------------------
# D2/D3 population scaler
# ---------------------------------------------------------------------------------------
@dataclass
class PopulationScaler:
    """Mean and population std per feature (zero variance -> scale 1)."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> "PopulationScaler":
        aggs = []
        for i, f in enumerate(features):
            x = c(f).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        stats = {}
        for i, f in enumerate(features):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            stats[f] = (float(mean or 0.0), float(std) if std else 1.0)
        return cls(stats)

    def transform(self, df: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
        cols = [c(k) for k in keep if k in df.columns]
        for f, (mean, scale) in self.stats.items():
            cols.append(((c(f).cast("double") - F.lit(mean)) / F.lit(scale)).alias(f))
        return df.select(*cols)


def scaler_stats(df: DataFrame, features: list[str], digits: int = 6) -> DataFrame:
    """Distributed (feature, mean, scale) table: one aggregation pass, unpivoted."""
    aggs = []
    for i, f in enumerate(features):
        x = c(f).cast("double")
        aggs.append(F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"), F.avg(x).alias("mean"),
                             F.stddev_pop(x).alias("std")).alias(f"s{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(features))])).alias("r")).select("r.*")
    scale = F.when(F.col("std").isNull() | (F.col("std") == 0), F.lit(1.0)).otherwise(F.col("std"))
    return long.select(
        "feature",
        round_half_even(F.col("mean"), digits).alias("mean"),
        round_half_even(scale, digits).alias("scale"),
    )


# ---------------------------------------------------------------------------------------
# D4/D5 weights
# ---------------------------------------------------------------------------------------
def balanced_weights(df: DataFrame, label: str = S.TARGET, out: str = "weight") -> DataFrame:
    """class_weight='balanced': n / (k * n_class) for a 0/1 label.

    Both class counts come from one aggregate, as a scalar subquery (one row), so
    rows never meet a join or a class-partitioned window. A null label has no weight.
    """
    y = F.col(label)
    counts = df.select(F.struct(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))).scalar()
    pos, neg = counts["pos"], counts["neg"]
    kinds = (pos > 0).cast("int") + (neg > 0).cast("int")
    return df.withColumn(out, (pos + neg).cast("double") / (kinds * F.when(y == 1, pos).when(y == 0, neg)))


def pos_weight(df: DataFrame, label: str = S.TARGET, out: str = "weight") -> DataFrame:
    """negatives / positives applied to positive rows; negatives weigh 1."""
    ratio = df.select(
        F.count_if(F.col(label) == 0).cast("double") / F.count_if(F.col(label) == 1)
    ).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


# ---------------------------------------------------------------------------------------
# D11 confusion metrics, D12 exact ROC-AUC
# ---------------------------------------------------------------------------------------
def confusion_counts(df: DataFrame, p: str = "p_raw", label: str = S.TARGET, threshold: float = 0.5) -> DataFrame:
    pred = F.col(p) >= threshold
    y = F.col(label) == 1
    return df.agg(
        F.count_if(pred & y).cast("bigint").alias("tp"),
        F.count_if(pred & ~y).cast("bigint").alias("fp"),
        F.count_if(~pred & y).cast("bigint").alias("fn"),
        F.count_if(~pred & ~y).cast("bigint").alias("tn"),
    )


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    f1 = safe_ratio(2 * tp, 2 * tp + fp + fn)
    return counts.select(
        "tp", "fp", "fn", "tn",
        round_half_even(safe_ratio(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"),
        round_half_even(precision, 4).alias("precision"),
        round_half_even(recall, 4).alias("recall"),
        round_half_even(f1, 4).alias("f1"),
    )


def binary_metrics(df: DataFrame, p: str = "p_raw", label: str = S.TARGET) -> DataFrame:
    return metrics_from_counts(confusion_counts(df, p, label))


def auc_value(df: DataFrame, p: str = "p_raw", label: str = S.TARGET, parts: int | None = None) -> Column:
    """Exact ROC-AUC (ties count one half) as a scalar subquery column.

    1. aggregate to distinct scores: (score, pos, neg) with map-side partial agg;
    2. prefix sums of the negatives over ranges of the scores (``prefix_sums``);
    3. sum pos * (negatives below + neg / 2) / (P * N).
    """
    score = F.col(p).cast("double")
    y = F.col(label).cast("int")
    per_score = df.groupBy(score.alias("s")).agg(
        F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg")
    )
    ranked = prefix_sums(per_score, [F.asc_nulls_first("s")], "neg", parts)
    total = ranked.agg(
        (F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2.0))
         / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc")
    )
    return total.scalar()


def roc_auc(df: DataFrame, p: str = "p_raw", label: str = S.TARGET) -> DataFrame:
    one = df.select(F.count(F.lit(1)).alias("n"))
    return one.select(round_half_even(auc_value(df, p, label), 4).alias("roc_auc"))


def evaluate(df: DataFrame, p: str = "p_raw", label: str = S.TARGET) -> DataFrame:
    """The five reported metrics (4 dp) plus confusion counts, one row."""
    return binary_metrics(df, p, label).withColumn("roc_auc", round_half_even(auc_value(df, p, label), 4))
