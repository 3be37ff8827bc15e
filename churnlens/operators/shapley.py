"""Sampled (permutation) Shapley values for any scorer: the model-agnostic and tree
explainers re-aimed as one Spark job.

For customer x, permutation pi and background row z, the coalition after k steps
takes features pi[0..k-1] from x and the rest from z. Scoring the F+1 coalitions
and differencing consecutive scores attributes f(x) - f(z) to the features in
permutation order; averaging over permutations and background rows estimates
phi. Efficiency holds exactly: sum_f phi_f = f(x) - mean_z f(z).

Work is rows x permutations x background x (F + 1) coalitions. A score that also
takes a matrix (``LinearArrayScore``) is evaluated on blocks of coalitions in Arrow
batches, customers dealt over all tasks, and leaves one row of F values for each customer;
any other one (``pyspark.ml`` models) on coalition rows generated by ``explode``, in one
``transform``. Permutations and background rows are small literals whose size is set by
explicit parameters, never by the data. A coalition's score counts for the feature just added
and against the next one, so the only shuffles deal customers and sum by customer, combined map-side.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import c
from .linear import LinearScorer

ScoreFn = Callable[[DataFrame, str, str], DataFrame]  # (df, vector-array col, out col) -> df

#: Numbers of one block of coalitions (customers x steps x features) that a task holds.
BLOCK_NUMBERS = 1 << 18


def permutations(n_features: int, m: int, seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    out = []
    for _ in range(m):
        p = list(range(n_features))
        rng.shuffle(p)
        out.append(p)
    return out


@dataclass
class LinearArrayScore:
    """A linear model (logit or probability) on an array<double> of raw features, or on the rows of a matrix."""

    scorer: LinearScorer
    space: str = "logit"

    def terms(self) -> list[tuple[int, float, float, float]]:
        """(position, coefficient, mean, scale) of each feature that the model uses."""
        idx = {f: i for i, f in enumerate(self.scorer.feature_names)}
        scaler = self.scorer.scaler or {}
        return [(idx[f], float(coef), *scaler.get(f, (0.0, 1.0))) for f, coef in self.scorer.terms if coef != 0.0]

    def __call__(self, df: DataFrame, arr: str, out: str) -> DataFrame:
        z = F.lit(float(self.scorer.intercept))
        for i, coef, mean, scale in self.terms():
            z = z + F.lit(coef) * ((F.col(arr)[i] - F.lit(mean)) / F.lit(scale))
        return df.withColumn(out, z if self.space == "logit" else F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))

    def matrix(self, v: np.ndarray, missing: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """The score of each row, and where it is null: a feature that the model uses is missing."""
        used, coefs, means, scales = (np.array(x) for x in zip(*self.terms(), strict=True)) if self.terms() else (np.empty(0, int), *[np.empty(0)] * 3)
        z = ((v[:, used] - means) / scales) @ coefs + float(self.scorer.intercept)
        with np.errstate(over="ignore"):
            f = z if self.space == "logit" else 1.0 / (1.0 + np.exp(-z))
        return f, None if missing is None else missing[:, used].any(axis=1)


def linear_array_score(scorer: LinearScorer, space: str = "logit") -> LinearArrayScore:
    """Score an array<double> of raw features with a linear model (logit or probability)."""
    return LinearArrayScore(scorer, space)


def ml_array_score(model, scaler: dict | None = None, names: list[str] | None = None) -> ScoreFn:
    """Score an array<double> with a fitted pyspark.ml classifier (probability of class 1)."""

    def fn(df: DataFrame, arr: str, out: str) -> DataFrame:
        col: Column = F.col(arr)
        if scaler and names:
            col = F.array(*[
                (F.col(arr)[i] - F.lit(scaler[n][0])) / F.lit(scaler[n][1]) for i, n in enumerate(names)
            ])
        vec = df.withColumn("features", array_to_vector(col))
        scored = model.transform(vec)
        return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
            "features", "rawPrediction", "probability", "prediction"
        )

    return fn


def sampled_shapley(
    features: DataFrame,
    names: list[str],
    score: ScoreFn,
    background: DataFrame,
    m: int = 4,
    seed: int = 7,
    key: str = S.KEY,
) -> DataFrame:
    """Long (key, feature, phi) for every row of ``features``.

    ``background`` must be small (its rows become literals); pass an explicit
    ``background_sample(..., n)``.
    """
    nf = len(names)
    bg_rows = background.select(*[c(n).cast("double").alias(f"b{i}") for i, n in enumerate(names)]).collect()
    if not bg_rows:
        raise ValueError("empty background")
    perms = permutations(nf, m, seed)
    if isinstance(score, LinearArrayScore):
        return _by_blocks(features, names, score, [tuple(r) for r in bg_rows], perms, key)
    pos = [[0] * nf for _ in perms]
    for j, p in enumerate(perms):
        for k, f in enumerate(p):
            pos[j][f] = k
    pos_lit = F.array(*[F.array(*[F.lit(v) for v in row]) for row in pos])
    perm_lit = F.array(*[F.array(*[F.lit(v) for v in row]) for row in perms])
    bg_lit = F.array(*[F.array(*[F.lit(float(r[f"b{i}"]) if r[f"b{i}"] is not None else None).cast("double")
                                 for i in range(nf)]) for r in bg_rows])

    x = F.array(*[c(n).cast("double") for n in names])
    base = features.select(F.col(key), x.alias("x"))
    with_perm = base.select(key, "x", F.posexplode(pos_lit).alias("j", "pos"))
    with_bg = with_perm.select(key, "x", "j", "pos", F.posexplode(bg_lit).alias("b", "z"))
    steps = with_bg.select(key, "x", "j", "pos", "b", "z", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("k"))
    coalition = F.transform(
        F.sequence(F.lit(0), F.lit(nf - 1)),
        lambda i: F.when(F.element_at(F.col("pos"), i + 1) < F.col("k"), F.element_at(F.col("x"), i + 1))
        .otherwise(F.element_at(F.col("z"), i + 1)),
    )
    scored = score(steps.select(key, "j", "b", "k", coalition.alias("v")), "v", "_f")
    # phi is the mean of f(after) - f(before): each coalition's score counts for the feature that
    # was just added and against the one that is added next, so no two coalitions need to meet
    perm = F.element_at(perm_lit, F.col("j") + 1)
    added = F.when(F.col("k") > 0, F.struct(F.element_at(perm, F.greatest(F.col("k"), F.lit(1))).alias("idx"), F.col("_f").alias("d")))
    following = F.when(
        F.col("k") < nf, F.struct(F.element_at(perm, F.least(F.col("k") + 1, F.lit(nf))).alias("idx"), (-F.col("_f")).alias("d"))
    )
    attributed = scored.select(key, F.explode(F.array_compact(F.array(added, following))).alias("a")).select(key, "a.*")
    names_lit = F.array(*[F.lit(n) for n in names])
    phi = attributed.groupBy(key, "idx").agg((F.sum("d") / F.lit(len(perms) * len(bg_rows))).alias("phi"))
    return phi.select(key, F.element_at(names_lit, F.col("idx") + 1).alias("feature"), "idx", "phi")


def _by_blocks(features: DataFrame, names: list[str], score: LinearArrayScore, background: list[tuple],
               perms: list[list[int]], key: str) -> DataFrame:
    """The same sums with all coalitions of a customer in one task; rows that share a key are summed, as above."""
    spark, nf = features.sparkSession, len(names)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = features.select(F.col(key), F.array(*[c(n).cast("double") for n in names]).alias("x")).repartition(parts)
    schema = base.select(key, F.col("x").alias("phi")).schema
    one = base.mapInArrow(_blocks(score, background, perms, nf), schema)
    sums = one.groupBy(key).agg(*[F.sum(F.col("phi")[i]).alias(f"phi{i}") for i in range(nf)])
    long = sums.select(key, F.posexplode(F.array(*[f"phi{i}" for i in range(nf)])).alias("idx", "phi"))
    names_lit = F.array(*[F.lit(n) for n in names])
    return long.select(key, F.element_at(names_lit, F.col("idx") + 1).alias("feature"), "idx", "phi")


def _blocks(score: LinearArrayScore, background: list[tuple], perms: list[list[int]], nf: int):
    """Batches of (key, x) to (key, phi). A null score adds nothing; a feature without any score is null."""
    z = np.array([[np.nan if v is None else v for v in r] for r in background], np.float64)
    z_missing = np.array([[v is None for v in r] for r in background])
    taken = [np.arange(nf + 1)[:, None] > np.argsort(p)[None, :] for p in perms]  # (steps x features) from the customer
    step = max(1, BLOCK_NUMBERS // ((nf + 1) * nf))

    def explained(x: np.ndarray, x_missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phi, terms = np.zeros(x.shape), np.zeros(x.shape, np.int64)
        some = x_missing.any() or z_missing.any()
        for perm, own in zip(perms, taken, strict=True):
            for k in range(len(z)):
                v = np.where(own, x[:, None], z[k]).reshape(-1, nf)
                gone = np.where(own, x_missing[:, None], z_missing[k]).reshape(-1, nf) if some else None
                f, null = score.matrix(v, gone)
                here = np.ones(f.shape, np.int64) if null is None else (~null).astype(np.int64)
                f = (f if null is None else np.where(null, 0.0, f)).reshape(len(x), nf + 1)
                here = here.reshape(f.shape)
                phi[:, perm] += f[:, 1:] - f[:, :-1]
                terms[:, perm] += here[:, 1:] + here[:, :-1]
        return phi / (len(perms) * len(z)), terms == 0

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                flat = part.column(1).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, nf)
                x_missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, nf)
                phi, null = explained(x, x_missing)
                values = pa.array(phi.ravel(), pa.float64(), mask=null.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * nf, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [part.schema.names[0], "phi"])

    return rows


def efficiency_gap(phi: DataFrame, features: DataFrame, names: list[str], score: ScoreFn, background: DataFrame,
                   key: str = S.KEY) -> DataFrame:
    """Per row: sum phi, f(x) - mean f(z) and their absolute difference (should be ~0)."""
    x = F.array(*[c(n).cast("double") for n in names])
    fx = score(features.select(F.col(key), x.alias("v")), "v", "fx").select(key, "fx")
    zb = background.select(x.alias("v"))
    mean_fz = score(zb, "v", "fz").select(F.avg("fz").alias("m")).scalar()
    sums = phi.groupBy(key).agg(F.sum("phi").alias("sum_phi"))
    out = sums.join(fx, key).withColumn("expected", F.col("fx") - mean_fz)
    return out.select(key, "sum_phi", "expected", F.abs(F.col("sum_phi") - F.col("expected")).alias("gap"))
