"""Cleaning operators (dedup, numeric coercion, imputation, target, types).

Scale notes
-----------
* ``dedup_keep_first`` is one hash aggregation keyed by the customer id with
  ``min_by(struct, order)``: the partial aggregate collapses duplicates map-side,
  so even a key holding a third of all rows (e.g. the null id) reaches the
  shuffle as one row per map task. No window sort of every row is needed.
* Everything else is a per-row expression inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import coerce_number


def _business_columns(df: DataFrame, order_col: str) -> list[str]:
    return [c for c in df.columns if c != order_col]


def dedup_keep_first(df: DataFrame, key: str = S.KEY, order_col: str = S.ORDER_COL) -> DataFrame:
    """Keep the first row (smallest ``order_col``) per ``key``; null keys form one group."""
    others = [c for c in df.columns if c != key]
    # as a struct, a null order sorts after all others instead of dropping the row
    order = F.struct(F.col(order_col).isNull(), F.col(order_col))
    first = F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_first")
    out = df.groupBy(key).agg(first)
    return out.select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def dedup_few(df: DataFrame, key: str = S.KEY, order_col: str = S.ORDER_COL) -> DataFrame:
    """``dedup_keep_first`` for a table with few repeated keys: only their rows are shuffled whole.

    A hash aggregate counts the keys alone. Rows whose key is repeated (a null-safe
    semi-join, broadcast if the measured list of keys is small) go through
    ``dedup_keep_first``; all others (the anti-join) pass as they are. Same rows as
    ``dedup_keep_first``, ties and null orders included. The input is read three
    times, so it should be a stored table whose row order does not change.
    """
    repeated = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    once = df.join(repeated, same, "left_anti")
    return once.unionByName(dedup_keep_first(df.join(repeated, same, "left_semi"), key, order_col))


def dedup_rows(df: DataFrame, order_col: str = S.ORDER_COL) -> DataFrame:
    """No key column: drop whole-row duplicates over business columns, keep first position."""
    cols = _business_columns(df, order_col)
    if order_col not in df.columns:
        return df.dropDuplicates(cols)
    out = df.groupBy(*cols).agg(F.min(order_col).alias(order_col))
    return out.select(*df.columns)


def coerce_total(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    """Unparsable text -> null (strict number grammar, see schema.NUMBER_PATTERN)."""
    dtype = dict(df.dtypes).get(col)
    if dtype == "string":
        return df.withColumn(col, coerce_number(F.col(col)))
    return df.withColumn(col, F.col(col).cast("double"))


def impute_total(df: DataFrame) -> DataFrame:
    """Batch rule: missing total = monthly x tenure."""
    return df.withColumn(
        "TotalCharges", F.coalesce(F.col("TotalCharges"), F.col("MonthlyCharges") * F.col("tenure"))
    )


def impute_total_online(df: DataFrame) -> DataFrame:
    """Online rule: missing total = monthly x max(tenure, 1)."""
    if "TotalCharges" not in df.columns:
        df = df.withColumn("TotalCharges", F.lit(None).cast("double"))
    return df.withColumn(
        "TotalCharges",
        F.coalesce(
            F.col("TotalCharges").cast("double"),
            F.col("MonthlyCharges") * F.greatest(F.col("tenure"), F.lit(1)),
        ),
    )


def _raise_on_null(col: Column, name: str) -> Column:
    return F.when(col.isNull(), F.raise_error(F.lit(f"{name}: cannot convert missing value to integer")))


def normalize_target(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Yes -> 1, No -> 0; any other text raises. Integer target untouched, absent target skipped."""
    if target not in df.columns:
        return df
    dtype = dict(df.dtypes)[target]
    if dtype in ("int", "bigint", "smallint", "tinyint"):
        return df
    t = F.col(target)
    if dtype != "string":
        # float / bool targets map to missing in the reference mapping, then raise
        bad = F.raise_error(F.concat(F.lit(f"{target}: unmapped value "), F.coalesce(t.cast("string"), F.lit("null"))))
        return df.withColumn(target, F.when(F.lit(True), bad).cast("int"))
    mapped = (
        F.when(t == "Yes", F.lit(1))
        .when(t == "No", F.lit(0))
        .otherwise(
            F.raise_error(F.concat(F.lit(f"{target}: unmapped value "), F.coalesce(t, F.lit("null"))))
        )
    )
    return df.withColumn(target, mapped.cast("int"))


def cast_types(df: DataFrame) -> DataFrame:
    """int / int / double / double; a missing integer raises."""
    out = df
    for name in ("SeniorCitizen", "tenure"):
        if name in out.columns:
            col = F.col(name)
            out = out.withColumn(
                name, F.coalesce(_raise_on_null(col, name).cast("int"), col.cast("int"))
            )
    for name in ("MonthlyCharges", "TotalCharges"):
        if name in out.columns:
            out = out.withColumn(name, F.col(name).cast("double"))
    return out


def clean(df: DataFrame, key: str = S.KEY, order_col: str = S.ORDER_COL) -> DataFrame:
    """Dedup -> coerce total -> impute (monthly x tenure) -> target 0/1 -> types."""
    if key in df.columns:
        out = dedup_keep_first(df, key, order_col) if order_col in df.columns else df.dropDuplicates([key])
    else:
        out = dedup_rows(df, order_col)
    out = coerce_total(out)
    out = impute_total(out)
    out = normalize_target(out)
    return cast_types(out)


def clean_report(raw: DataFrame, key: str = S.KEY, order_col: str = S.ORDER_COL) -> DataFrame:
    """Rows dropped, totals filled, remaining nulls, raw and clean shapes: one row.

    The raw row count enters as a scalar subquery; the cleaned side is one
    aggregate over the deduplicated rows.
    """
    raw_rows = raw.select(F.count(F.lit(1)).alias("n")).scalar()
    deduped = dedup_keep_first(raw, key, order_col) if key in raw.columns else dedup_rows(raw, order_col)
    coerced = coerce_total(deduped)
    cleaned = cast_types(normalize_target(impute_total(coerced.withColumn("_was_missing", F.col("TotalCharges").isNull()))))
    business = [c for c in raw.columns if c != order_col]
    null_sum = sum((F.col(c).isNull().cast("int") for c in business), F.lit(0))
    agg = cleaned.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.count_if(F.col("_was_missing")).alias("totals_filled"),
        F.sum(null_sum).cast("bigint").alias("remaining_nulls"),
    )
    return agg.select(
        raw_rows.cast("bigint").alias("raw_rows"),
        F.lit(len(business)).alias("raw_columns"),
        (raw_rows - F.col("clean_rows")).cast("bigint").alias("rows_dropped"),
        F.col("totals_filled").cast("bigint").alias("totals_filled"),
        F.coalesce(F.col("remaining_nulls"), F.lit(0)).cast("bigint").alias("remaining_nulls"),
        F.col("clean_rows").cast("bigint").alias("clean_rows"),
        F.lit(len(business)).alias("clean_columns"),
    )


def null_profile(df: DataFrame, exclude: tuple[str, ...] = (S.ORDER_COL,)) -> DataFrame:
    """Null count per column, in one pass, unpivoted to (column_name, null_count)."""
    cols = [c for c in df.columns if c not in exclude]
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def assign_row_ids(df: DataFrame, order_col: str = S.ORDER_COL, key: str = S.KEY, prefix: str = "ROW-") -> DataFrame:
    """No key column: ``ROW-1..n`` in source order, inserted as the first column.

    Uses the bucketed global rank (no single-partition window).
    """
    from .ordering import global_rank

    ranked = global_rank(df, order_col=order_col, rank_col="_rn")
    out = ranked.withColumn(key, F.concat(F.lit(prefix), F.col("_rn").cast("string"))).drop("_rn")
    return out.select(key, *[c for c in df.columns if c != key])
