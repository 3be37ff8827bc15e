"""Feature engineering: derived columns, high-value flag, one-hot vocabulary, alignment.

Fitted state is tiny and explicit:
* ``HighValueThreshold`` holds one double (or is evaluated per frame as a
  scalar subquery in ``batch`` mode, which keeps the plan lazy and avoids a
  cross join).
* ``OneHotVocabulary`` holds the sorted level list per categorical column; its
  size is bounded by the column cardinalities, never by the row count.
Transforming is pure column expressions, so scoring a new batch or a stream
never re-scans the training data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import (
    c,
    contract_months,
    round_half_even,
    service_count,
    sql_ident,
    sql_str,
    tenure_group,
)
from .ordering import exact_quantile

MAX_VOCAB_LEVELS = 100_000  # bound on the collected vocabulary (per fit)


# ----------------------------------------------------------------------------------------
# C4: high-value threshold (three modes)
# ----------------------------------------------------------------------------------------
@dataclass
class HighValueThreshold:
    """``MonthlyCharges`` strictly above the 0.75 quantile (linear interpolation).

    mode ``batch``: quantile of the frame being scored (reference parity; a scalar
    subquery over that frame, or ``exact_quantile`` where values are ``unbounded``). ``single``: record-at-a-time scoring, always 0.
    ``fitted``: threshold learned once (``fit``) and applied to later frames/streams.
    """

    mode: str = "batch"
    threshold: float | None = None
    quantile: float = S.HIGH_VALUE_QUANTILE
    exact: bool = True  # exact keeps one counter per distinct value (cents: bounded)
    unbounded: bool = False  # many distinct values: two more passes over the distinct ones in place of the counters

    def _quantile(self, col: str = "MonthlyCharges") -> Column:
        if self.exact:
            return F.percentile(col, self.quantile)
        # opt-in for unbounded distinct values: returns a data element, not an interpolation
        return F.percentile_approx(col, self.quantile, 100_000)

    @classmethod
    def fit(cls, df: DataFrame, quantile: float = S.HIGH_VALUE_QUANTILE, exact: bool = True) -> "HighValueThreshold":
        if exact:
            value = exact_quantile(df, "MonthlyCharges", quantile)
        else:
            value = df.agg(cls(quantile=quantile, exact=False)._quantile().alias("q")).first()["q"]
        return cls(mode="fitted", threshold=value, quantile=quantile, exact=exact)

    def flag(self, df: DataFrame) -> Column:
        m = F.col("MonthlyCharges")
        if self.mode == "single":
            return F.lit(0)
        if self.mode == "fitted":
            if self.threshold is None:
                return F.lit(0)
            return F.coalesce((m > F.lit(self.threshold)).cast("int"), F.lit(0))
        if self.unbounded:
            q = F.lit(exact_quantile(df, "MonthlyCharges", self.quantile)).cast("double")
        else:
            q = df.select(self._quantile()).scalar()
        return F.coalesce((m > q).cast("int"), F.lit(0))


def _threshold(high_value) -> HighValueThreshold:
    if isinstance(high_value, HighValueThreshold):
        return high_value
    if isinstance(high_value, (int, float)) and not isinstance(high_value, bool):
        return HighValueThreshold(mode="fitted", threshold=float(high_value))
    return HighValueThreshold(mode=str(high_value))


# ----------------------------------------------------------------------------------------
# Derived features
# ----------------------------------------------------------------------------------------
def avg_monthly_spend() -> Column:
    safe_tenure = F.when(F.col("tenure") == 0, F.lit(1)).otherwise(F.col("tenure"))
    return round_half_even(F.col("TotalCharges") / safe_tenure, 2)


def estimated_clv() -> Column:
    return round_half_even(
        F.col("TotalCharges") + F.col("MonthlyCharges") * contract_months(F.col("Contract")), 2
    )


def is_fiber_no_support() -> Column:
    cond = (F.col("InternetService") == "Fiber optic") & (F.col("TechSupport") == "No")
    return F.coalesce(cond, F.lit(False)).cast("int")


def add_features(df: DataFrame, high_value="batch") -> DataFrame:
    """C1-C7 in one projection (order of the reference's derived columns)."""
    hv = _threshold(high_value).flag(df)
    svc = service_count()
    return df.withColumns(
        {
            "AvgMonthlySpend": avg_monthly_spend(),
            "TenureGroup": tenure_group(F.col("tenure")),
            "ServiceCount": svc,
            "HighValueCustomer": hv,
            "EstimatedCLV": estimated_clv(),
            "HasNoAddOns": (svc <= 1).cast("int"),
            "IsFiberNoSupport": is_fiber_no_support(),
        }
    )


# ----------------------------------------------------------------------------------------
# One-hot vocabulary
# ----------------------------------------------------------------------------------------
def dummy_name(column: str, level) -> str:
    return f"{column}_{level}"


@dataclass
class OneHotVocabulary:
    """Dummy columns ``<col>_<value>``: levels sorted, all kept, null -> all zero."""

    levels: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None) -> "OneHotVocabulary":
        cols = [x for x in (columns or S.ENCODED_COLUMNS) if x in df.columns]
        if not cols:
            return cls({})
        # distinct rows are reduced in every task; no more than the bound reaches the driver
        found = vocabulary_table(df, cols).select("column_name", "level").limit(MAX_VOCAB_LEVELS + 1).collect()
        if len(found) > MAX_VOCAB_LEVELS:
            raise ValueError("vocabulary exceeds its bound; these columns are not categorical")
        levels: dict[str, list[str]] = {x: [] for x in cols}
        for r in found:
            levels[r["column_name"]].append(r["level"])
        return cls({x: sorted(v) for x, v in levels.items()})

    @classmethod
    def from_domains(cls) -> "OneHotVocabulary":
        lv = {k: sorted(str(v) for v in vals) for k, vals in S.DOMAINS.items() if k in S.CATEGORICAL_COLUMNS}
        lv["TenureGroup"] = sorted([label for _, label in S.TENURE_GROUPS] + [S.TENURE_GROUP_LAST])
        return cls({k: lv[k] for k in S.ENCODED_COLUMNS})

    def feature_names(self) -> list[str]:
        return [dummy_name(col, lv) for col, lvs in self.levels.items() for lv in lvs]

    def expressions(self) -> dict[str, Column]:
        return {
            dummy_name(col, lv): F.coalesce(F.col(col) == F.lit(lv), F.lit(False)).cast("int")
            for col, lvs in self.levels.items()
            for lv in lvs
        }

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the encoded columns by their dummies (appended last, as get_dummies does)."""
        keep = [x for x in df.columns if x not in self.levels]
        exprs = self.expressions()
        return df.select(*[c(x) for x in keep], *[e.alias(n) for n, e in exprs.items()])

    def to_frame(self, spark) -> DataFrame:
        rows = [(col, lv, dummy_name(col, lv)) for col, lvs in self.levels.items() for lv in lvs]
        return spark.createDataFrame(rows, "column_name string, level string, feature string")


def vocabulary_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distributed (column_name, level, feature) table of the levels present in ``df``."""
    cols = [x for x in (columns or S.ENCODED_COLUMNS) if x in df.columns]
    long = df.select(*[F.col(x).cast("string").alias(x) for x in cols]).unpivot(
        [], cols, "column_name", "level"
    )
    return (
        long.where(F.col("level").isNotNull())
        .distinct()
        .withColumn("feature", F.concat(F.col("column_name"), F.lit("_"), F.col("level")))
    )


# ----------------------------------------------------------------------------------------
# Feature table and alignment
# ----------------------------------------------------------------------------------------
NUMERIC_FEATURES = S.NUMERIC_BASE + S.DERIVED_NUMERIC
CANONICAL_FEATURES = NUMERIC_FEATURES + OneHotVocabulary.from_domains().feature_names()


def align_features(df: DataFrame, names: list[str], keep: list[str] | tuple = ()) -> DataFrame:
    """Reorder to the training feature list; absent features are 0, unseen ones dropped."""
    present = set(df.columns)
    cols = [sql_ident(k) for k in keep if k in present]
    cols += [sql_ident(n) if n in present else f"0 AS {sql_ident(n)}" for n in names]
    return df.selectExpr(*cols)


def encode_for(df: DataFrame, names: list[str], keep: list[str] | tuple = ()) -> DataFrame:
    """One-hot + align in one projection, driven by a fitted feature-name list.

    Scoring path: no vocabulary fit is needed, the model's names define the dummies.
    The projection is passed as SQL text in one call.
    """
    present = set(df.columns)
    out = [sql_ident(k) for k in keep if k in present]
    for n in names:
        if n in present:
            out.append(sql_ident(n))
            continue
        col, _, level = n.partition("_")
        if level and col in present:
            out.append(f"CAST(coalesce({sql_ident(col)} = {sql_str(level)}, false) AS INT) AS {sql_ident(n)}")
        else:
            out.append(f"0 AS {sql_ident(n)}")
    return df.selectExpr(*out)


def build_feature_table(
    df: DataFrame,
    vocab: OneHotVocabulary | None = None,
    high_value="batch",
    keep: list[str] | tuple = (),
) -> DataFrame:
    """add_features -> drop id -> one-hot (fitted on ``df`` unless given) -> all numeric."""
    featured = add_features(df, high_value)
    vocab = vocab or OneHotVocabulary.fit(featured)
    numeric = [x for x in NUMERIC_FEATURES if x in featured.columns]
    target = [S.TARGET] if S.TARGET in featured.columns else []
    exprs = vocab.expressions()
    cols = [c(k) for k in keep if k in featured.columns]
    cols += [F.col(x) for x in numeric[:4]]
    cols += [F.col(t) for t in target]
    cols += [F.col(x) for x in numeric[4:]]
    cols += [e.alias(n) for n, e in exprs.items()]
    return featured.select(*cols)


def feature_names_of(table: DataFrame, keep: list[str] | tuple = ()) -> list[str]:
    return [x for x in table.columns if x != S.TARGET and x not in keep]
