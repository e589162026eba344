"""Reading and checking the application table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.functions import parse_number, plain_text
from roomtide.operators.reshape import round_columns
from roomtide.operators.selection import period_is
from roomtide.schema import (
    FILE_ORDER,
    NUMBER_COLUMNS,
    REQUIRED_COLUMNS,
    ROUND_PREFIX,
    SPREADSHEET_HEADERS,
    SPREADSHEET_ROUND_PREFIX,
    TEXT_COLUMNS,
)


def read_applications(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    mapping: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
    period: str | float | None = None,
    **options: str,
) -> DataFrame:
    """Read applications from Parquet, CSV or JSON, with columns that hold the order of rows.

    Headers are renamed by `mapping` (the spreadsheet headers by default). CSV is read as text, which
    takes no inference pass; `conform` turns the numbers into doubles. In CSV empty text is missing, unless the option
    `nullValue` names another mark for what is missing. JSON needs a `schema`, as it
    would take a pass over all data to find one. `schema.FILE_ORDER` names the order columns: file,
    position of the split in the file, row within it.

    A `period` is chosen before rows are numbered. In CSV and JSON a later filter does not pass the
    numbering, so only this way a partitioned folder is read in part.
    """
    if fmt == "json" and schema is None:
        raise ValueError("reading JSON needs a schema")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    if period is not None:
        header = next(old for old, new in {**_renames(df, mapping), "period": "period"}.items() if new == "period" and old in df.columns)
        df = df.filter(period_is(period, F.col(f"`{header}`"), dict(df.dtypes)[header]))
    file, block, row = FILE_ORDER.columns
    position = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    return rename_headers(
        df.select(
            "*",
            F.col("_metadata.file_path").alias(file),
            F.col("_metadata.file_block_start").alias(block),
            position.alias(row),
        ),
        mapping,
    )


def _renames(df: DataFrame, mapping: Mapping[str, str] | None) -> dict[str, str]:
    """Header -> new name for the headers present. Of two headers for one name the first in the mapping counts."""
    wanted = SPREADSHEET_HEADERS if mapping is None else mapping
    names: dict[str, str] = {}
    for old, new in wanted.items():
        if old in df.columns and new not in names.values():
            names[old] = new
    for k, columns in round_columns(df, SPREADSHEET_ROUND_PREFIX).items():
        for i, column in enumerate(columns):
            names.setdefault(column, f"{ROUND_PREFIX}{k}" + (f"_{i}" if i else ""))
    return names


def rename_headers(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename spreadsheet headers, the open-ended round columns included. Other columns stay, and so does a second
    header for the same name."""
    return df.withColumnsRenamed(_renames(df, mapping))


def conform(
    df: DataFrame, require: Sequence[str] = tuple(REQUIRED_COLUMNS), blank_is_missing: bool = False
) -> DataFrame:
    """Check that the required columns exist and coerce text and number columns to their types.

    Numbers in text columns are written out, a year 2025.0 as "2025". Text that is no number becomes null
    in number columns. With `blank_is_missing` empty text does too, as in a
    spreadsheet. Other columns, such as the order columns, pass unchanged.
    """
    missing = [c for c in require if c not in df.columns]
    if missing:
        raise ValueError("application table lacks the columns: " + ", ".join(missing))
    rounds = [c for names in round_columns(df).values() for c in names]
    types = dict(df.dtypes)

    def coerced(name: str) -> Column:
        column = F.col(f"`{name}`")
        if name in TEXT_COLUMNS:
            text = plain_text(column, types[name])
            return F.when(text != "", text) if blank_is_missing else text
        if name in NUMBER_COLUMNS or name in rounds:
            if types[name] == "string":
                return parse_number(column)
            number = column.cast("double")
            return F.when(~F.isnan(number), number)
        return column

    return df.select([coerced(c).alias(c) for c in df.columns])
