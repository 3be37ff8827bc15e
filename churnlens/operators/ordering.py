"""Global ranks and rank bands without a single-partition window.

A global "row number in order" over a big table is the classic scale trap: an
unpartitioned ``Window.orderBy`` pulls every row into one task. Here rows are
first cut into ordered buckets (a monotone function of the order key). Per-bucket
counts are aggregated map-side and collected; their size is bounded by the
bucket count, never by the data. For band assignment by a hash (train/test split, CV
folds) only the few buckets that straddle a cut need row-level ranking at all. Ranks, prefix
sums and quantiles of given values are taken over ranges of sampled splitters,
which hold equally many rows whatever the values are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# the collected bucket table is bounded by groups x buckets; refuse anything larger
MAX_COLLECTED_BUCKETS = 1 << 20


def hex_bucket(order_hex: Column, hex_digits: int) -> Column:
    """Leading hex digits of an md5 order key as an int: monotone in the key's string order."""
    return F.conv(F.substring(order_hex, 1, hex_digits), 16, 10).cast("int")


def _collect_counts(df: DataFrame, group_col: str | None, bucket_col: str, max_groups: int) -> dict:
    keys = ([group_col] if group_col else []) + [bucket_col]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.limit(MAX_COLLECTED_BUCKETS + 1).collect()
    if len(rows) > MAX_COLLECTED_BUCKETS:
        raise ValueError("bucket table exceeds its bound; lower the bucket resolution")
    table: dict = {}
    for r in rows:
        g = r[group_col] if group_col else None
        table.setdefault(g, {})[r[bucket_col]] = r["_n"]
    if len(table) > max_groups:
        raise ValueError(f"{group_col} has {len(table)} groups; band assignment expects at most {max_groups}")
    return table


def hash_bands(
    df: DataFrame,
    group_col: str,
    order_key: Column,
    tiebreak: str,
    cuts: Callable[[int], list[int]],
    band_col: str,
    hex_digits: int = 3,
    max_groups: int = 16,
) -> DataFrame:
    """Assign each row the band of its rank inside its group.

    Rows are ordered inside ``group_col`` by (``order_key``, ``tiebreak``), ranked
    0..n_g-1, and ``band = #{cut in cuts(n_g) : cut <= rank}``. Only buckets that
    contain a cut are ranked row by row; every other row's band follows from its
    bucket alone, so the window touches ~#cuts/16^hex_digits of the data. With more
    groups than ``max_groups`` ranks come from ranges of (group, order) instead.
    """
    if df.select(group_col).distinct().limit(max_groups + 1).count() > max_groups:
        return _many_group_bands(df, group_col, order_key, tiebreak, cuts, band_col)
    work = df.withColumn("_ok", order_key).withColumn("_bk", hex_bucket(F.col("_ok"), hex_digits))
    table = _collect_counts(work, group_col, "_bk", max_groups)

    # per group: [(cut_bucket, cut_rank, bucket_offset)]
    plan: dict = {}
    for g, buckets in table.items():
        n = sum(buckets.values())
        offsets, running = {}, 0
        for b in sorted(buckets):
            offsets[b] = running
            running += buckets[b]
        entries = []
        for cut in cuts(n):
            if cut <= 0:
                entries.append((None, cut, 0))  # every row is at or past this cut
                continue
            if cut >= n:
                continue  # no row reaches this cut
            bucket = max(b for b in offsets if offsets[b] <= cut)
            entries.append((bucket, cut, offsets[bucket]))
        plan[g] = entries

    boundary_pairs = [(g, b) for g, es in plan.items() for (b, _, _) in es if b is not None]
    gcol, bcol = F.col(group_col), F.col("_bk")

    def in_group(g) -> Column:
        return gcol.isNull() if g is None else gcol == F.lit(g)

    is_boundary = F.lit(False)
    for g, b in boundary_pairs:
        is_boundary = is_boundary | (in_group(g) & (bcol == F.lit(b)))

    # a null group compares as null: without coalesce its rows would be in neither branch
    is_boundary = F.coalesce(is_boundary, F.lit(False))
    win = Window.partitionBy(group_col, "_bk").orderBy("_ok", tiebreak)
    boundary_rows = work.filter(is_boundary).withColumn("_rib", F.row_number().over(win) - 1)
    other_rows = work.filter(~is_boundary).withColumn("_rib", F.lit(None).cast("int"))
    both = boundary_rows.unionByName(other_rows)

    band = None
    for g, entries in plan.items():
        expr = F.lit(0)
        for bucket, cut, offset in entries:
            if bucket is None:
                expr = expr + F.lit(1)
            else:
                passed = (bcol > F.lit(bucket)) | (
                    (bcol == F.lit(bucket)) & (F.lit(offset) + F.col("_rib") >= F.lit(cut))
                )
                expr = expr + passed.cast("int")
        band = F.when(in_group(g), expr) if band is None else band.when(in_group(g), expr)
    band = band if band is not None else F.lit(None).cast("int")
    return both.withColumn(band_col, band.cast("int")).drop("_ok", "_bk", "_rib")


def _many_group_bands(df: DataFrame, group_col: str, order_key: Column, tiebreak: str, cuts, band_col: str) -> DataFrame:
    """hash_bands() for any number of groups: one range shuffle, and a join with the groups' sizes."""
    order = [F.asc_nulls_first(group_col), F.col("_ok"), F.asc_nulls_first(tiebreak), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    placed = prefix_sums(df.withColumn("_ok", order_key).withColumn("_one", F.lit(1).cast("bigint")), order, "_one")
    placed = placed.checkpoint(eager=True)
    sizes = placed.groupBy(F.col(group_col).alias("_g")).agg(F.min("before").alias("_first"), F.count("*").alias("_n"))

    @F.pandas_udf("array<bigint>")
    def bounds(n: pd.Series) -> pd.Series:  # one value for each group
        return n.map(lambda k: cuts(int(k)))

    sizes = sizes.withColumn("_cuts", bounds("_n"))
    joined = placed.join(sizes, placed[group_col].eqNullSafe(sizes["_g"]))
    band = F.size(F.filter("_cuts", lambda cut: cut <= F.col("before") - F.col("_first")))
    return joined.withColumn(band_col, band.cast("int")).select(*df.columns, band_col)


def _running(names: list[str], weight: int, offsets: dict[int, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            if total is None:
                total = offsets[batch.column(len(names))[0].as_py()]
            own = batch.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = total + np.cumsum(own) - own
            total += int(own.sum())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(before)], [*names, "before"])

    return rows


def prefix_sums(df: DataFrame, order: list, weight: str, parts: int | None = None) -> DataFrame:
    """`df` with `before`: the sum of the whole-number column ``weight`` over all rows in front, in the order of ``order``.

    Rows are dealt by ranges of the order (Spark samples the splitters, so ranges hold
    about equally many rows whatever the values are), sorted where they are, and
    summed there; one total of each range gives the next ones their start. Rows that agree in
    ``order`` may stand in any order, so end it with a tie-break: it also splits a value that most rows share.
    The order is cut into the checkpoint folder, so a lost task finds the same ranges again.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    totals = {r["_part"]: r["w"] for r in ranged.groupBy("_part").agg(F.sum(weight).alias("w")).collect()}  # `parts` rows
    offsets, running = {}, 0
    for part in sorted(totals):
        offsets[part] = running
        running += int(totals[part] or 0)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ranged.mapInArrow(_running(names, names.index(weight), offsets), ", ".join([*fields, "before bigint"]))


def global_rank(df: DataFrame, order_col: str, rank_col: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based rank of every row by ``order_col``, nulls last; rows with equal values are ranked by their hash.

    No window: the position of a row in its range and the sizes of the ranges in front make the rank.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last(order_col), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    place = F.monotonically_increasing_id()  # the range in the upper 31 bits, the row in it in the lower 33
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", place).checkpoint(eager=True)
    part = F.shiftright("_place", 33).cast("int")
    sizes = dict(placed.groupBy(part).count().collect())  # `parts` rows
    starts, running = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(F.lit(running).cast("bigint"))
        running += sizes.get(k, 0)
    if not starts:
        return df.withColumn(rank_col, F.lit(None).cast("bigint"))
    rank = F.element_at(F.array(*starts), part + 1) + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn(rank_col, rank).drop("_place")


def exact_quantile(df: DataFrame, column: str, q: float, parts: int | None = None) -> float | None:
    """Quantile of a numeric column with linear interpolation, as ``percentile`` gives it; null without values.

    The state is bounded: distinct values are counted by a grouped aggregate, and the
    prefix sums of their counts name the two values around the rank. Nothing but these two rows
    and one total of each range reaches the driver.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    counted = values.groupBy("v").agg(F.count("*").alias("n"))
    placed = prefix_sums(counted, [F.col("v")], "n", parts).checkpoint(eager=True)
    total = placed.agg(F.max(F.col("before") + F.col("n"))).first()[0]
    if not total:
        return None
    place = q * (total - 1)
    lower, upper = math.floor(place), math.ceil(place)
    ends = placed.filter(f"(before <= {lower} AND {lower} < before + n) OR (before <= {upper} AND {upper} < before + n)")
    low, *rest = sorted(r["v"] for r in ends.select("v").collect())  # two rows at most
    return low if not rest else (upper - place) * low + (place - lower) * rest[0]


def ceil_fraction(frac: float) -> Callable[[int], list[int]]:
    """Single cut at ceil(frac * n) (exact rational arithmetic): ranks below it form band 0."""
    q = Fraction(str(frac))
    return lambda n: [int(math.ceil(q * n))]


def equal_folds(k: int) -> Callable[[int], list[int]]:
    """k contiguous folds; the first n % k folds get one extra row."""

    def cuts(n: int) -> list[int]:
        base, extra = divmod(n, k)
        out, pos = [], 0
        for i in range(k - 1):
            pos += base + (1 if i < extra else 0)
            out.append(pos)
        return out

    return cuts
