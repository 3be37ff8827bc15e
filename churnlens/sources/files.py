"""File sources and sinks: customer CSV reader, table writer, JSON records, template.

The reader uses an explicit all-text schema (never ``inferSchema``: a full extra
pass at scale, and it would turn ``TotalCharges`` into a number and lose the
blank entries). Pandas' default NA tokens become null, then numeric columns are
cast with ``try_cast`` so one bad cell never fails a 100 TB read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import round_half_even


class MissingColumnsError(ValueError):
    pass


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line only (reads the first line, not the data)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def _unused(name: str, taken: list[str]) -> str:
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def _text_rows(spark: SparkSession, path: str, required: list[str] | None, whole_lines: bool = False) -> tuple[DataFrame, list[str], str]:
    """All-text rows with the record of a malformed line in a column of its own; (rows, header columns, that column)."""
    cols = header_columns(spark, path)
    if not cols:
        raise MissingColumnsError("Uploaded file is empty.")
    need = set(required if required is not None else [c for c in S.RAW_COLUMNS if c not in (S.KEY, S.TARGET)])
    missing = need - set(cols) - {S.TARGET}
    if missing:
        raise MissingColumnsError(f"File is missing expected column(s): {', '.join(sorted(missing))}")
    broken = _unused("_malformed_record", cols)
    df = (
        spark.read.schema(S.raw_text_schema(cols).add(broken, "string"))
        .option("header", True)
        .option("columnNameOfCorruptRecord", broken)
        # with fewer columns read, a line with too few or too many fields would not be noticed
        .option("columnPruning", not whole_lines)
        # every file's header has to name the same columns in the same order; another order raises
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if df.isEmpty():
        raise MissingColumnsError("Uploaded file has no rows.")
    return df, cols, broken


def file_position(df: DataFrame) -> Column:
    """Where a row stands in its input: file, offset of the split in the file, row in the split.

    The text sorts in this order. Other split sizes change the values, not the
    order of the rows, so "first" is the same row however the files are read.
    """
    at = df.metadataColumn("_metadata")
    row = F.monotonically_increasing_id().cast("string")  # grows within a split
    return F.concat_ws(" ", at["file_path"], F.lpad(at["file_block_start"].cast("string"), 19, "0"), F.lpad(row, 19, "0"))


def _cell(name: str, order_col: str | None) -> Column:
    x = F.col(f"`{name}`")
    x = F.when(x.isin(S.NA_TOKENS), F.lit(None).cast("string")).otherwise(x)
    if name == order_col:
        return F.trim(x).try_cast("bigint")
    if name in S.RAW_TYPES:
        return F.trim(x).try_cast(S.RAW_TYPES[name].simpleString())
    return x


def read_customers(
    spark: SparkSession,
    path: str,
    required: list[str] | None = None,
    order_col: str | None = S.ORDER_COL,
) -> DataFrame:
    """Read a customer CSV with header; NA tokens -> null; typed numeric columns.

    Raises ``MissingColumnsError`` for an empty file or when required columns are
    absent (names sorted, as the upload check reports them). A line with too few
    or too many fields keeps what it has; ``read_customers_checked`` sets it apart.
    Without an ``order_col`` in the file, the position in the files takes its place.
    """
    df, cols, _ = _text_rows(spark, path, required)
    out = [_cell(name, order_col).alias(name) for name in cols]
    if order_col and order_col not in cols:
        out.append(file_position(df).alias(order_col))
    return df.select(*out)


def read_customers_checked(
    spark: SparkSession,
    path: str,
    required: list[str] | None = None,
    order_col: str | None = S.ORDER_COL,
) -> tuple[DataFrame, DataFrame]:
    """``read_customers`` with malformed input as a second output: (rows, malformed).

    ``malformed`` has (position, record, problem, kept): a line whose number of
    fields differs from the header's is left out of ``rows`` (kept = false,
    problem ``fields``); a cell that is no number where one is due stays in
    ``rows`` as null (kept = true, the column's name as the problem, one row a cell).
    Blank cells and NA tokens are missing values, not problems. Every line of the
    files is in ``rows`` or among the malformed ones.
    """
    df, cols, broken = _text_rows(spark, path, required, whole_lines=True)
    typed = [_cell(name, order_col).alias(name) for name in cols]
    if order_col and order_col not in cols:
        typed.append(file_position(df).alias(order_col))
    rows = df.where(F.col(broken).isNull()).select(*typed)

    def unread(name: str) -> Column:
        x = F.col(f"`{name}`")
        given = x.isNotNull() & (F.trim(x) != "") & ~x.isin(S.NA_TOKENS)
        return F.when(given & _cell(name, order_col).isNull(), F.lit(name))

    numbers = [x for x in cols if x == order_col or x in S.RAW_TYPES and S.RAW_TYPES[x].simpleString() != "string"]
    cells = F.array_compact(F.array(*[unread(x) for x in numbers])) if numbers else F.array().cast("array<string>")
    problems = F.when(F.col(broken).isNotNull(), F.array(F.lit("fields"))).otherwise(cells)
    record = F.coalesce(F.col(broken), F.concat_ws(",", *[F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in cols]))
    malformed = df.select(
        file_position(df).alias("position"), record.alias("record"), F.explode(problems).alias("problem"),
        F.col(broken).isNull().alias("kept"),
    )
    return rows, malformed


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a table; CSV keeps header and exact text (no whitespace trimming)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("nullValue", "")
            .option("emptyValue", '""')
        )
        writer.csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def to_records_json(df: DataFrame, cols: list[str] | None = None, double_digits: int = 10) -> DataFrame:
    """One JSON record per row; doubles rounded to ``double_digits`` decimals first."""
    names = cols or df.columns
    types = dict(df.dtypes)
    fields = [
        (round_half_even(F.col(f"`{c}`"), double_digits) if types.get(c) == "double" else F.col(f"`{c}`")).alias(c)
        for c in names
    ]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def input_template(raw: DataFrame, n: int = 10, order_col: str = S.ORDER_COL) -> DataFrame:
    """First ``n`` rows of the training table (a top-n; not a full sort)."""
    return raw.orderBy(order_col).limit(n)
