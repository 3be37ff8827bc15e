"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance of transformed statistics, both from
grouped sums over all training rows. Covariances are shrunk towards the pooled
one and towards a multiple of the identity; a row's score is the logistic of
the difference of the two Mahalanobis log densities, from Cholesky factors that
are computed once and sent to the tasks (a few dozen numbers).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as X
from churnlens.llm.tables import stored

FEATURES = (
    "log_words",
    "log_word_bytes",
    "upper",
    "symbols",
    "marks",
    "digits",
    "distinct",
    "repeated",
    "doubled",
    "bare",
)
#: Weights of the pooled covariance and of the identity in each class's covariance: `choose` takes a pair by folds of training rows.
WEIGHTS = tuple((pooled, own) for pooled in (0.9, 0.7, 0.5, 0.3) for own in (0.2, 0.1, 0.05, 0.02))
FOLDS = 5
#: Log densities of dependent statistics are overconfident: their difference is divided by this.
TEMPERATURE = 4.0
THRESHOLD = 0.3


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _mask("0123456789")
_SYMBOL = _mask("#*$%&|<>")
_LETTER = _mask("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = True
_MARK = ~(_LETTER | _DIGIT | _SYMBOL) & (np.arange(256) > 32)


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text: logs of sizes, square roots of shares; 0 where there is nothing to count."""
    words = X.find_words(data, bounds, X.SPACED, lower=True)
    n = np.diff(words.first)

    def in_text(mask):
        sums = np.concatenate(([0], np.cumsum(mask[data])))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    letters, of = in_text(_LETTER), np.repeat(np.arange(len(n)), n)
    visible = np.maximum(1, in_text(np.arange(256) > 32))
    some = np.maximum(1, n)
    distinct, repeated = np.zeros(len(n)), np.zeros(len(n))
    grams = X.gram_hashes(words.hash, 5)
    for d in np.flatnonzero(n):
        lo, hi = words.first[d], words.first[d + 1]
        distinct[d] = len(np.unique(words.hash[lo:hi]))
        own = grams[lo : max(lo, hi - 4)]
        repeated[d] = len(own) - len(np.unique(own))
    doubled = np.zeros(len(of), bool)
    doubled[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    sums = np.concatenate(([0], np.cumsum(_LETTER[data])))
    bare = sums[words.end] == sums[words.start]
    count = lambda mask: np.bincount(of[mask], minlength=len(n))
    size = np.bincount(of, weights=words.end - words.start, minlength=len(n))
    columns = [
        np.log1p(n),
        np.log1p(size / some),
        np.sqrt(in_text(_UPPER) / np.maximum(1, letters)),
        np.sqrt(in_text(_SYMBOL) / visible),
        np.sqrt(in_text(_MARK) / visible),
        np.sqrt(in_text(_DIGIT) / visible),
        # distinct words grow more slowly than words: compared with the 0.8th power
        np.minimum(2.0, distinct / some**0.8),
        np.sqrt(repeated / some),
        np.sqrt(count(doubled) / some),
        np.sqrt(count(bare) / some),
    ]
    return np.stack(columns, axis=1)


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in X.text_slices(batch.column(1)):
            x = statistics(data, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), *[pa.array(x[:, k]) for k in range(len(FEATURES))]],
                ["doc_id", *FEATURES],
            )


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and log priors less half log determinants."""

    prior: float
    mean: np.ndarray  # over both classes, and scale: statistics are standardised
    scale: np.ndarray
    centres: list
    factors: list

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of class 1 for each row."""
        if len(self.factors) < 2:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale
        logs = []
        for centre, factor in zip(self.centres, self.factors):
            away = _forward(factor, (z - centre).T)
            logs.append(-0.5 * (away**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        margin = (logs[1] - logs[0]) / TEMPERATURE + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves the lower triangular system, all right sides at once."""
    out = np.empty_like(right)
    for i in range(len(factor)):
        out[i] = (right[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


@dataclass
class Sums:
    """Number of rows, sums and sums of products of the centred statistics, for each class."""

    n: np.ndarray  # by class
    first: np.ndarray  # class x statistic
    cross: np.ndarray  # class x statistic x statistic

    def without(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.first - other.first, self.cross - other.cross)


def grouped_sums(rows: DataFrame, label: str = "label", fold: str = "fold") -> tuple[np.ndarray, dict[int, Sums]]:
    """(centre, sums of each fold): two passes in Spark, of which one row and 2 x FOLDS rows reach the driver."""
    d = len(FEATURES)
    mean = rows.agg(*[F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in FEATURES]).first()
    centre = np.array([mean[name] for name in FEATURES])
    away = [F.col(name) - F.lit(float(c)) for name, c in zip(FEATURES, centre)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(away)]
    cross = [F.sum(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in pairs]
    out: dict[int, Sums] = {}
    for r in rows.groupBy(label, fold).agg(F.count("*").alias("n"), *sums, *cross).collect():
        own = out.setdefault(r[fold], Sums(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))))
        k = r[label]
        own.n[k] = r.n
        own.first[k] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            own.cross[k, i, j] = own.cross[k, j, i] = r[f"c{i}_{j}"]
    return centre, out


def total(parts: list[Sums]) -> Sums:
    d = len(FEATURES)
    out = Sums(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)))
    for p in parts:
        out = Sums(out.n + p.n, out.first + p.first, out.cross + p.cross)
    return out


def discriminant(centre: np.ndarray, sums: Sums, pooled_weight: float, round_weight: float) -> Discriminant:
    """The model of these sums. Without rows of both classes, the score is the share of class 1 (0.5 if there are no rows)."""
    d, n = len(FEATURES), sums.n
    if not n.all():
        return Discriminant(n[1] / n.sum() if n.sum() else 0.5, np.zeros(d), np.ones(d), [], [])
    means = sums.first / n[:, None]
    covs = sums.cross / n[:, None, None] - means[:, :, None] * means[:, None, :]
    share = n / n.sum()
    mean, pooled = share @ means, np.tensordot(share, covs, 1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    pooled = pooled / np.outer(scale, scale)
    factors = []
    for cov in covs:
        own = (1 - pooled_weight) * cov / np.outer(scale, scale) + pooled_weight * pooled
        own = (1 - round_weight) * own + round_weight * max(np.trace(own) / d, 1e-6) * np.eye(d)
        factors.append(np.linalg.cholesky(own))
    return Discriminant(share[1], centre + mean, scale, [(m - mean) / scale for m in means], factors)


def _trial_rows(models):
    """For each pair of weights: wrong rows and their log loss (in millionths), scored by models that have not seen the fold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], axis=1)
            label, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (len(FEATURES), len(FEATURES) + 1))
            wrong, loss = np.zeros(len(WEIGHTS), np.int64), np.zeros(len(WEIGHTS), np.int64)
            for f in np.unique(fold):
                mine = fold == f
                for k, model in enumerate(models.value[int(f)]):
                    p = np.clip(model.scores(x[mine]), 1e-9, 1 - 1e-9)
                    wrong[k] += ((p >= THRESHOLD) != (label[mine] == 1)).sum()
                    loss[k] -= np.rint(1e6 * np.log(np.where(label[mine] == 1, p, 1 - p))).astype(np.int64).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(WEIGHTS))), pa.array(wrong), pa.array(loss)], ["pair", "wrong", "loss"])

    return rows


def trials(rows: DataFrame, centre: np.ndarray, folds: dict[int, Sums]) -> list[tuple[int, int, int]]:
    """(wrong rows, log loss, place in WEIGHTS) of every pair, over all training rows, each scored without its fold."""
    whole = total(list(folds.values()))
    models = {f: [discriminant(centre, whole.without(own), *pair) for pair in WEIGHTS] for f, own in folds.items()}
    sent = rows.sparkSession.sparkContext.broadcast(models)
    tried = rows.select(*FEATURES, "label", "fold").mapInArrow(_trial_rows(sent), "pair long, wrong long, loss long")
    found = tried.groupBy("pair").agg(F.sum("wrong").alias("wrong"), F.sum("loss").alias("loss")).collect()
    return sorted((r.wrong, r.loss, r.pair) for r in found)


def fit(rows: DataFrame) -> Discriminant:
    """From all rows (doc_id, FEATURES..., label 0 or 1), with the weights that err least on folds by document.

    Ties go to the smaller log loss, then to the pair that stands first in WEIGHTS.
    """
    fold = F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")) % FOLDS
    rows = rows.withColumn("fold", fold.cast("int"))
    centre, folds = grouped_sums(rows)
    tried = trials(rows, centre, folds)
    pooled, own = WEIGHTS[tried[0][2]] if tried else WEIGHTS[0]
    return discriminant(centre, total(list(folds.values())), pooled, own)


def _score_rows(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, len(FEATURES) + 1)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.value.scores(x))], ["doc_id", "score"]
            )

    return rows


def held_out(doc_id="doc_id"):
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text); `labels` has doc_id and quality.

    Only `quality` 0 or 1 of rows that are not held out is learned; several
    labels of one document all count. Null and empty texts have statistics of
    0 and are scored like others. A null id is never held out, nor labelled.
    Without labels of both kinds every score is the share of label 1 (or 0.5).
    Weights of the covariances are chosen by folds of the rows that are learned.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{name} double" for name in FEATURES)
    rows = stored(source.mapInArrow(_statistic_rows, f"doc_id long, {fields}"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter("label IN (0, 1)").filter(~held_out())
    model = docs.sparkSession.sparkContext.broadcast(fit(stored(rows.join(known, "doc_id"))))
    scored = rows.mapInArrow(_score_rows(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
