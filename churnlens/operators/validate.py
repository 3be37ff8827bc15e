"""Request validation and defaults.

Validation is one array expression per row (the list of violated rules), so a
batch or a stream is split into valid rows and a quarantine without any
shuffle or Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import sql_ident, sql_str


def apply_defaults(df: DataFrame) -> DataFrame:
    """Add absent request fields with their defaults (explicit nulls are left for validation)."""
    out = df
    for name, value in S.DEFAULTS.items():
        if name in out.columns:
            continue
        if name == "TotalCharges":
            out = out.withColumn(name, F.lit(None).cast("double"))
        elif name == "SeniorCitizen":
            out = out.withColumn(name, F.lit(int(value)))
        else:
            out = out.withColumn(name, F.lit(value))
    return out


def validation_errors_sql(df: DataFrame) -> str:
    """SQL text of the array of violated-rule messages (empty when the row is valid)."""
    cols = set(df.columns)
    checks: list[str] = []
    for name, values in S.DOMAINS.items():
        if name not in cols:
            continue
        x = sql_ident(name)
        allowed = ", ".join(str(v) for v in values)
        vals = ", ".join(sql_str(v) if isinstance(v, str) else str(v) for v in values)
        checks.append(f"CASE WHEN {x} IS NULL OR NOT ({x} IN ({vals})) THEN {sql_str(f'{name}: must be one of {allowed}')} END")
    tenure = sql_ident("tenure") if "tenure" in cols else "CAST(NULL AS INT)"
    checks.append(f"CASE WHEN {tenure} IS NULL THEN 'tenure: field required' END")
    checks.append(
        f"CASE WHEN {tenure} IS NOT NULL AND ({tenure} < {S.TENURE_MIN} OR {tenure} > {S.TENURE_MAX}) "
        f"THEN {sql_str(f'tenure: must be between {S.TENURE_MIN} and {S.TENURE_MAX}')} END"
    )
    monthly = sql_ident("MonthlyCharges") if "MonthlyCharges" in cols else "CAST(NULL AS DOUBLE)"
    checks.append(f"CASE WHEN {monthly} IS NULL THEN 'MonthlyCharges: field required' END")
    checks.append(f"CASE WHEN {monthly} IS NOT NULL AND {monthly} < 0 THEN 'MonthlyCharges: must be >= 0' END")
    if "TotalCharges" in cols and dict(df.dtypes)["TotalCharges"] == "string":
        t = sql_ident("TotalCharges")
        checks.append(
            f"CASE WHEN {t} IS NOT NULL AND NOT ({t} RLIKE {sql_str(S.NUMBER_PATTERN)}) "
            "THEN 'TotalCharges: must be a number' END"
        )
    return "filter(array(" + ", ".join(checks) + "), e -> e IS NOT NULL)"


def validation_errors(df: DataFrame) -> Column:
    """Array of violated-rule messages, as one SQL expression (a single JVM parse)."""
    return F.expr(validation_errors_sql(df))


def validate_customers(df: DataFrame) -> DataFrame:
    """Input rows plus ``errors`` (array<string>) and ``is_valid``."""
    errs = validation_errors(df)
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with typed TotalCharges, quarantined rows with their errors)."""
    checked = validate_customers(df)
    valid = checked.where("is_valid").drop("errors", "is_valid")
    if "TotalCharges" in valid.columns:
        valid = valid.withColumn("TotalCharges", F.trim(F.col("TotalCharges")).try_cast("double"))
    quarantine = checked.where(~F.col("is_valid")).drop("is_valid")
    return valid, quarantine
