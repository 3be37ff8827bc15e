"""Churn reports over a scored table (G1-G25) and training-table EDA.

Every report is one aggregation pass with map-side partial aggregation: the
shuffle carries at most (#groups x #map tasks) rows, so a hot segment (one
contract type holding a third of the rows) costs nothing extra. Fixed domains
(histogram buckets, risk levels) are zero-filled by conditional counts +
``unpivot`` instead of a join against a literal table.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.exprs import (
    bucket_band,
    risk_meter_bars,
    risk_meter_percent,
    round_half_even,
    safe_ratio,
)

# fixed values: numpy's edges for 10 equal bins on [0, 1] (np.linspace(0, 1, 11))
HISTOGRAM_EDGES = [
    0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5,
    0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0,
]


# fixed values: the labels of the ten buckets
HISTOGRAM_LABELS = [
    "0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-60%", "60-70%", "70-80%", "80-90%", "90-100%",
]


def zero_filled_counts(df: DataFrame, conditions: list[tuple[str, Column]], label_col: str, count_col: str) -> DataFrame:
    """One pass of conditional counts, unpivoted to (label, count); empty labels kept as 0."""
    keys = [f"_k{i}" for i in range(len(conditions))]
    wide = df.agg(*[F.count_if(cond).cast("bigint").alias(k) for k, (_, cond) in zip(keys, conditions)])
    labelled = wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("bucket_index"), F.lit(lbl).alias(label_col), F.col(k).alias(count_col))
                    for i, (k, (lbl, _)) in enumerate(zip(keys, conditions))
                ]
            )
        ).alias("r")
    )
    return labelled.select("r.*")


# ---------------------------------------------------------------------------------------
# G1 summary, G2/G3 risk counts, G4 histogram, G7 KPIs, G8 30-bin histogram
# ---------------------------------------------------------------------------------------
def churn_summary(scored: DataFrame, p: str = "p_raw") -> DataFrame:
    pc = F.col(p)
    churn = pc >= S.LABEL_THRESHOLD
    agg = scored.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(churn).alias("predicted_churn_count"),
        F.count_if(pc.isNull()).alias("unscored_count"),
        F.avg(pc).alias("_avg"),
        F.sum(F.when(churn, F.col("MonthlyCharges"))).alias("_rev"),
    )
    return agg.select(
        F.col("total_customers").cast("bigint"),
        F.col("predicted_churn_count").cast("bigint"),
        (F.col("total_customers") - F.col("predicted_churn_count") - F.col("unscored_count"))
        .cast("bigint")
        .alias("predicted_retain_count"),
        F.col("unscored_count").cast("bigint"),
        round_half_even(
            safe_ratio(F.col("predicted_churn_count"), F.col("total_customers") - F.col("unscored_count")), 4
        ).alias("churn_rate"),
        round_half_even(F.col("_avg"), 4).alias("average_risk"),
        round_half_even(F.coalesce(F.col("_rev"), F.lit(0.0)), 2).alias("estimated_monthly_revenue_at_risk"),
    )


def risk_breakdown(scored: DataFrame) -> DataFrame:
    """Count per risk level, largest first (levels with no rows are omitted)."""
    counts = scored.where(F.col("RiskLevel").isNotNull()).groupBy("RiskLevel")
    return counts.agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), "RiskLevel")


def risk_counts_filled(scored: DataFrame, p: str = "p_raw") -> DataFrame:
    """Dashboard view: High/Medium/Low Risk in fixed order, zero-filled."""
    pc = F.col(p)
    conds = [
        ("High Risk", pc >= S.HIGH_RISK),
        ("Medium Risk", (pc >= S.MEDIUM_RISK) & (pc < S.HIGH_RISK)),
        ("Low Risk", pc < S.MEDIUM_RISK),
    ]
    out = zero_filled_counts(scored, conds, "Risk", "Customers")
    return out.withColumnRenamed("bucket_index", "position")


def risk_histogram(scored: DataFrame, p: str = "p_raw") -> DataFrame:
    """Ten buckets on [0, 1] with numpy's edges; last bucket closed; empty buckets kept."""
    pc = F.col(p)
    e = HISTOGRAM_EDGES
    conds = []
    for i in range(10):
        upper = (pc <= F.lit(e[i + 1])) if i == 9 else (pc < F.lit(e[i + 1]))
        conds.append((HISTOGRAM_LABELS[i], (pc >= F.lit(e[i])) & upper))
    return zero_filled_counts(scored, conds, "bucket", "count")


def bucket_bands(histogram: DataFrame) -> DataFrame:
    return histogram.withColumn("band", bucket_band(F.col("bucket")))


def batch_kpis(scored: DataFrame, p: str = "p_raw") -> DataFrame:
    pc = F.col(p)
    return scored.agg(
        F.count(F.lit(1)).cast("bigint").alias("customers"),
        F.count_if(pc >= S.HIGH_RISK).cast("bigint").alias("high_risk"),
        F.count_if((pc >= S.MEDIUM_RISK) & (pc < S.HIGH_RISK)).cast("bigint").alias("medium_risk"),
        F.count_if(pc >= S.LABEL_THRESHOLD).cast("bigint").alias("likely_churn"),
        round_half_even(F.avg(pc), 4).alias("average_risk"),
    )


def probability_histogram(scored: DataFrame, bins: int = 30, p: str = "ChurnProbability") -> DataFrame:
    """``bins`` equal bins on [0, 1]: floor(p * bins) clipped to the last bin, zero-filled."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    conds = [(f"{i}", b == i) for i in range(bins)]
    out = zero_filled_counts(scored, conds, "_lbl", "count").drop("_lbl")
    return out.select(
        F.col("bucket_index").alias("bin"),
        round_half_even(F.col("bucket_index") / F.lit(float(bins)), 6).alias("bin_start"),
        F.col("count"),
    )


# ---------------------------------------------------------------------------------------
# G5 segment breakdown (grouping sets), G6 ranked segments, G9 churn rate by column
# ---------------------------------------------------------------------------------------
def _long_grouping(df: DataFrame, columns: list[str], aggs: dict[str, Column], segment_name: str) -> DataFrame:
    """One Expand + one aggregate for all columns: GROUPING SETS ((c1), (c2), ...).

    Returns (column_name, <segment_name> as text, aggs...). Null segments and
    absent columns are dropped, as a per-column group-by would.
    """
    cols = [x for x in columns if x in df.columns]
    if not cols:
        raise ValueError("none of the breakdown columns is present")
    grouped = df.groupingSets([[F.col(x)] for x in cols], *[F.col(x) for x in cols]).agg(
        *[a.alias(n) for n, a in aggs.items()], *[F.grouping(x).alias(f"_g_{x}") for x in cols]
    )
    name_expr = None
    seg_expr = None
    for x in cols:
        active = F.col(f"_g_{x}") == 0
        name_expr = F.when(active, F.lit(x)) if name_expr is None else name_expr.when(active, F.lit(x))
        seg = F.col(x).cast("string")
        seg_expr = F.when(active, seg) if seg_expr is None else seg_expr.when(active, seg)
    out = grouped.select(name_expr.alias("column_name"), seg_expr.alias(segment_name), *list(aggs))
    return out.where(F.col(segment_name).isNotNull())


def segment_breakdown(scored: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean rounded probability (4 dp) and count per segment of each breakdown column."""
    cols = columns or S.BREAKDOWN_COLUMNS
    aggs = {"_avg": F.avg("ChurnProbability"), "_cnt": F.count("ChurnProbability")}
    long = _long_grouping(scored, cols, aggs, "segment")
    return long.select(
        "column_name",
        "segment",
        round_half_even(F.col("_avg"), 4).alias("avg_risk"),
        F.col("_cnt").cast("bigint").alias("count"),
    )


def segment_ranked(breakdown: DataFrame, column: str) -> DataFrame:
    """One column's segments by avg_risk descending (the breakdown is tiny: one row per segment)."""
    one = breakdown.where(F.col("column_name") == column)
    w = Window.partitionBy("column_name").orderBy(F.desc("avg_risk"), F.asc("segment"))
    return one.withColumn("rank", F.row_number().over(w))


def churn_rate_by(clean_df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or S.EDA_RATE_COLUMNS
    aggs = {"_rate": F.avg(S.TARGET), "_cnt": F.count(S.TARGET)}
    long = _long_grouping(clean_df, cols, aggs, "category")
    return long.select(
        "column_name",
        "category",
        round_half_even(F.col("_rate"), 4).alias("churn_rate"),
        F.col("_cnt").cast("bigint").alias("customers"),
    ).orderBy("column_name", F.desc("churn_rate"), "category")


# ---------------------------------------------------------------------------------------
# G10 numeric histogram, G11 correlation, G12 cohort rates, G13 target counts, G16 grid
# ---------------------------------------------------------------------------------------
def numeric_histogram(clean_df: DataFrame, column: str, bins: int = 30, hue: str = S.TARGET) -> DataFrame:
    """``bins`` common equal-width bins over [min, max] of ``column``, split by ``hue``.

    Bin i holds edge_i <= x < edge_{i+1} (last bin closed) with numpy's edges
    edge_i = min + i * ((max - min) / bins); min and max enter as scalar subqueries.
    """
    stats = clean_df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo = stats.select("lo").scalar()
    hi = stats.select("hi").scalar()
    step = (hi - lo) / F.lit(float(bins))
    x = F.col(column).cast("double")
    idx = F.lit(0)
    for i in range(1, bins):
        idx = idx + (x >= lo + F.lit(float(i)) * step).cast("int")
    binned = clean_df.where(x.isNotNull()).withColumn("bin", idx)
    out = binned.groupBy("bin", hue).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return out.select(F.lit(column).alias("column_name"), "bin", F.col(hue), "count")


def correlation_matrix(clean_df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Pearson correlation of every pair (long form), one aggregation pass."""
    cols = columns or S.CORRELATION_COLUMNS
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}"))
    wide = clean_df.agg(*aggs)
    entries = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                val = F.lit(1.0)
            else:
                lo_, hi_ = (a, b) if i < j else (b, a)
                val = round_half_even(F.col(f"`{lo_}|{hi_}`"), digits)
            entries.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), val.alias("correlation")))
    return wide.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def cohort_rates(clean_df: DataFrame) -> DataFrame:
    t = F.col(S.TARGET).cast("double")
    contract = F.col("Contract")
    return clean_df.agg(
        round_half_even(F.avg(t), 4).alias("overall_churn_rate"),
        round_half_even(F.avg(F.when(contract == "Month-to-month", t)), 4).alias("month_to_month_churn_rate"),
        round_half_even(F.avg(F.when(contract == "Two year", t)), 4).alias("two_year_churn_rate"),
    )


def target_counts(raw: DataFrame) -> DataFrame:
    """Rows per raw churn value, total training rows and each value's share."""
    total = raw.select(F.count(F.lit(1))).scalar()
    grouped = raw.groupBy(S.TARGET).agg(F.count(F.lit(1)).alias("Customers"))
    return grouped.select(
        F.col(S.TARGET),
        F.col("Customers").cast("bigint"),
        total.cast("bigint").alias("training_rows"),
        round_half_even(F.col("Customers") / total, 4).alias("share"),
    )


def tenure_charges_grid(clean_df: DataFrame, tenure_width: int = 6, charge_width: float = 10.0) -> DataFrame:
    """Customers and churn rate on a tenure x monthly-charges grid."""
    tb = (F.floor(F.col("tenure") / tenure_width) * tenure_width).cast("int")
    cb = (F.floor(F.col("MonthlyCharges") / charge_width) * charge_width).cast("double")
    out = clean_df.groupBy(tb.alias("tenure_bin"), cb.alias("charges_bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("customers"),
        F.avg(F.col(S.TARGET).cast("double")).alias("_rate"),
    )
    return out.select("tenure_bin", "charges_bin", "customers", round_half_even(F.col("_rate"), 4).alias("churn_rate"))


# ---------------------------------------------------------------------------------------
# G17-G24 customer table: search, sort, page, lookup, meter
# ---------------------------------------------------------------------------------------
def display_projection(scored: DataFrame) -> DataFrame:
    return scored.select(*[x for x in S.DISPLAY_COLUMNS if x in scored.columns])


def search_by_id(scored: DataFrame, pattern: str, id_col: str = S.KEY) -> DataFrame:
    """Case-insensitive regex match on the id (null id -> no match)."""
    return scored.where(F.coalesce(F.col(id_col).cast("string").rlike("(?iu)" + pattern), F.lit(False)))


def search_customers(scored: DataFrame, query: str = "", risk: str = "All") -> DataFrame:
    """Risk filter, then trimmed lower-cased substring over id / contract / internet / payment."""
    out = scored
    if risk != "All":
        out = out.where(F.col("RiskLevel") == risk)
    q = query.strip().lower()
    if q:
        hit = F.lit(False)
        for name in S.SEARCH_COLUMNS:
            hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(q), F.lit(False))
        out = out.where(hit)
    return out


def sort_customers(scored: DataFrame, key: str = "ChurnProbability", descending: bool = True,
                   id_col: str = S.KEY, collation: str | None = "UNICODE") -> DataFrame:
    """Sort by any column: numbers numerically, text in locale order (ICU root
    collation, like a browser's ``localeCompare``) when ``collation`` is set."""
    return scored.orderBy(*_sort_order(scored, key, descending, id_col, collation))


def _sort_order(scored: DataFrame, key: str, descending: bool, id_col: str, collation: str | None) -> list[Column]:
    col = F.col(key)
    if collation and dict(scored.dtypes).get(key) == "string":
        col = F.collate(col, collation)
    order = col.desc_nulls_last() if descending else col.asc_nulls_first()
    return [order] + ([F.asc(id_col)] if key != id_col else [])


def top_customers(scored: DataFrame, n: int = 25, key: str = "ChurnProbability") -> DataFrame:
    """Top-n report (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return sort_customers(scored, key).limit(n)


def page(scored: DataFrame, number: int, size: int = S.PAGE_SIZE, key: str = "ChurnProbability") -> DataFrame:
    """Page ``number`` (1-based) of the sorted table."""
    return sort_customers(scored, key).offset((number - 1) * size).limit(size)


PART = "_part"


def write_pages(scored: DataFrame, path: str, key: str = "ChurnProbability", descending: bool = True,
                id_col: str = S.KEY, ranges: int | None = None, distinct_ids: int = 1_000_000) -> str:
    """Write the customer table for paging and lookup: sorted ranges, their row offsets, bloom filters on the id.

    Ranges follow the order of ``sort_customers`` (sampled splitters, ties by id),
    so a page lies in one or two of them. The offsets hold one row a range.
    ``distinct_ids`` is what a bloom filter is sized for: the ids of one row group.
    Rows equal in key and id stand in either order; an empty table has no ranges.
    """
    spark = scored.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _sort_order(scored, key, descending, id_col, "UNICODE")
    ranged = scored.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id())
    (
        ranged.sortWithinPartitions(PART, *order).write.mode("overwrite").partitionBy(PART)
        .option(f"parquet.bloom.filter.enabled#{id_col}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{id_col}", str(distinct_ids))
        .parquet(f"{path}/rows")
    )
    stored = scored.schema.json()
    about = [(key, descending, id_col, stored)]
    spark.createDataFrame(about, "key string, descending boolean, id_col string, stored string").write.mode("overwrite").parquet(f"{path}/about")
    sizes = sorted(tuple(r) for r in _stored_rows(spark, path, stored).groupBy(PART).count().collect())  # one row a range
    starts = [0, *accumulate(rows for _, rows in sizes)]
    index = [(part, start, rows) for (part, rows), start in zip(sizes, starts)]
    spark.createDataFrame(index, f"{PART} int, first_row long, n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return path


def _stored_rows(spark: SparkSession, path: str, stored: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(stored))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])).parquet(f"{path}/rows")


def read_page(spark: SparkSession, path: str, number: int, size: int = S.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (1-based) of a table of ``write_pages``: reads the ranges it lies in and no others."""
    about = spark.read.parquet(f"{path}/about").first()
    first, end = (number - 1) * size, number * size
    touched = (
        spark.read.parquet(f"{path}/index")
        .where((F.col("first_row") < end) & (F.col("first_row") + F.col("n_rows") > first)).orderBy("first_row").collect()
    )
    rows = _stored_rows(spark, path, about["stored"])
    held = rows.where(F.col(PART).isin([r[PART] for r in touched])).drop(PART)
    skip = first - touched[0]["first_row"] if touched else 0
    return sort_customers(held, about["key"], about["descending"], about["id_col"]).offset(skip).limit(size)


def stored_customers(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table of ``write_pages``; an equality on the id is checked against the bloom filters of the files."""
    return _stored_rows(spark, path, spark.read.parquet(f"{path}/about").first()["stored"]).drop(PART)


def page_after(scored: DataFrame, last_p: float | None, last_id: str | None, size: int = S.PAGE_SIZE) -> DataFrame:
    """Keyset page for deep paging: the rows after the row (last_p, last_id).

    The order is that of ``sort_customers``: probability descending with nulls
    last, then id ascending with nulls first. Rows equal in both cannot be told
    apart by a keyset.
    """
    p, k = F.col("ChurnProbability"), F.col(S.KEY)
    later_id = k.isNotNull() if last_id is None else k > F.lit(last_id)
    if last_p is None:
        after = p.isNull() & later_id
    else:
        after = p.isNull() | (p < F.lit(last_p)) | ((p == F.lit(last_p)) & later_id)
    return sort_customers(scored.where(after)).limit(size)


def page_caption(scored: DataFrame, number: int, size: int = S.PAGE_SIZE) -> DataFrame:
    total = scored.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    start = F.lit((number - 1) * size + 1)
    end = F.least(F.lit(number * size), n)
    return total.select(
        n.cast("bigint").alias("total_rows"),
        F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("bigint").alias("total_pages"),
        start.cast("bigint").alias("start_row"),
        end.cast("bigint").alias("end_row"),
        F.format_string("Showing rows %,d–%,d of %,d", start, end, n).alias("caption"),
    )


def find_customer(scored: DataFrame, customer_id: str, order_col: str = S.ORDER_COL) -> DataFrame:
    """First row whose id (as text) equals ``customer_id``."""
    hit = scored.where(F.col(S.KEY).cast("string") == F.lit(customer_id))
    if order_col in scored.columns:
        hit = hit.orderBy(order_col)
    return hit.limit(1)


def customer_choices(scored: DataFrame, limit: int = 500, order_col: str = S.ORDER_COL) -> DataFrame:
    """Ids offered in the picker: the first ``limit`` in table order."""
    return scored.select(S.KEY, order_col).orderBy(order_col).limit(limit)


def risk_meter(scored: DataFrame, p: str = "ChurnProbability") -> DataFrame:
    return scored.select(
        S.KEY,
        F.col(p),
        risk_meter_bars(F.col(p)).alias("filled_bars"),
        risk_meter_percent(F.col(p)).alias("percent"),
    )


def full_report(scored: DataFrame) -> dict[str, DataFrame]:
    """Summary, histogram, segment breakdown and customer projection from one persisted scan."""
    cached = scored.persist()
    return {
        "summary": churn_summary(cached),
        "histogram": risk_histogram(cached),
        "segment_breakdown": segment_breakdown(cached),
        "customers": display_projection(cached),
    }
