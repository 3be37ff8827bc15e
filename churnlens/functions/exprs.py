"""Column expressions shared by the operators.

All of these are built-in Spark expressions (whole-stage codegen).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def c(name: str) -> Column:
    """Column reference that tolerates spaces and symbols in one-hot names."""
    return F.col(f"`{name}`")


def round_half_even(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals the numpy way: rint(x * 10^k) / 10^k.

    Spark's ``round`` rounds half up (0.125 -> 0.13); ``bround`` works on the
    decimal expansion. Scaling and ``rint`` reproduces numpy/pandas exactly.
    """
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def coerce_number(text: Column) -> Column:
    """``to_numeric(errors='coerce')``: parse text to double, unparsable -> null."""
    trimmed = F.trim(text)
    return F.when(text.rlike(S.NUMBER_PATTERN), trimmed.try_cast("double"))


def tenure_group(tenure: Column) -> Column:
    expr = None
    for upper, label in S.TENURE_GROUPS:
        expr = F.when(tenure <= upper, F.lit(label)) if expr is None else expr.when(tenure <= upper, F.lit(label))
    return expr.otherwise(F.lit(S.TENURE_GROUP_LAST))


def service_count(cols: list[str] | None = None) -> Column:
    """Services not in the 'No ...' set; a null counts as a service."""
    parts = [
        F.coalesce((~F.col(name).isin(S.NO_SERVICE_VALUES)).cast("int"), F.lit(1))
        for name in (cols or S.SERVICE_COLUMNS)
    ]
    return reduce(lambda a, b: a + b, parts)


def contract_months(contract: Column) -> Column:
    expr = None
    for name, months in S.CONTRACT_MONTHS.items():
        expr = F.when(contract == name, F.lit(months)) if expr is None else expr.when(contract == name, F.lit(months))
    return expr  # unknown contract -> null


def prediction_label(p: Column) -> Column:
    """Null for a missing probability: an unscored customer is not a safe one."""
    return F.when(p >= S.LABEL_THRESHOLD, F.lit(S.CHURN_LABEL)).when(p.isNotNull(), F.lit(S.STAY_LABEL))


def risk_level(p: Column, suffix: str = "") -> Column:
    """Null for a missing probability."""
    return (
        F.when(p >= S.HIGH_RISK, F.lit("High" + suffix))
        .when(p >= S.MEDIUM_RISK, F.lit("Medium" + suffix))
        .when(p.isNotNull(), F.lit("Low" + suffix))
    )


def readable_feature(name: Column) -> Column:
    """``Contract_One year`` -> ``Contract → One year``; split camelCase."""
    return F.regexp_replace(F.regexp_replace(name, "_", " → "), "([a-z])([A-Z])", "$1 $2")


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round``: halves go up (towards +inf)."""
    return F.floor(x + F.lit(0.5))


def risk_meter_bars(p: Column) -> Column:
    return F.greatest(F.lit(1), js_round(p * S.METER_BARS).cast("int"))


def risk_meter_percent(p: Column) -> Column:
    return js_round(p * 100).cast("int")


def bucket_band(label: Column) -> Column:
    """Risk band of a histogram bucket from the integer prefix of its label."""
    low = F.regexp_extract(label, r"^\s*(\d+)", 1).try_cast("int")
    return F.when(low >= 70, "High").when(low >= 30, "Medium").otherwise("Low")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den with 0 when the denominator is 0 (scikit-learn zero_division)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def md5_order_key(key: Column, seed: int | str) -> Column:
    """Deterministic pseudo-random order key: md5 of 'seed:key' (same in Spark and SQL engines)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


# ---------------------------------------------------------------------------------------
# SQL-text builders: a large expression is sent to the JVM as one string (one parse)
# instead of thousands of Column calls; literals round-trip exactly.
# ---------------------------------------------------------------------------------------
def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(x: float) -> str:
    """A double literal that parses back to exactly ``x`` (shortest repr, then cast)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"
