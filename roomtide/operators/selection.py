"""Row filters and period lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide.functions.numbers import plain_text
from roomtide.schema import NOT_ELIGIBLE


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every one of `columns` is present."""
    return df.filter(all_present(columns))


def all_present(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def is_eligible(excluded: Sequence[str] = NOT_ELIGIBLE) -> Column:
    """True for rows with a real band; false, never null, for the others."""
    band = F.col("scale_band")
    return band.isNotNull() & ~F.coalesce(band.isin(list(excluded)), F.lit(False))


def eligible(df: DataFrame, excluded: Sequence[str] = NOT_ELIGIBLE) -> DataFrame:
    """Rows with a real band; `excluded` is compared exactly."""
    return df.filter(is_eligible(excluded))


def sector_chosen(sectors: Sequence[str] | None, case_sensitive: bool = False) -> Column:
    """True for the chosen sectors. None means every sector, an empty list none."""
    sector = F.col("sector")
    if sectors is None:
        return sector.isNotNull()
    if case_sensitive:
        return F.coalesce(sector.isin(list(sectors)), F.lit(False))
    return F.coalesce(F.lower(sector).isin([s.lower() for s in sectors]), F.lit(False))


def in_sectors(df: DataFrame, sectors: Sequence[str] | None, case_sensitive: bool = False) -> DataFrame:
    """Rows of the chosen sectors."""
    return df.filter(sector_chosen(sectors, case_sensitive))


def period_is(period: str | float, column: Column, kind: str) -> Column:
    """Whether a period column of type `kind` is the given period, compared as text: 2025, 2025.0 and "2025" agree."""
    if isinstance(period, float) and period.is_integer():
        period = int(period)
    return plain_text(column, kind) == F.lit(str(period))


def in_period(df: DataFrame, period: str | float | None) -> DataFrame:
    """Rows of one period, compared as text. None keeps every row that has a period."""
    if period is None:
        return df.filter(F.col("period").isNotNull())
    return df.filter(period_is(period, F.col("period"), dict(df.dtypes)["period"]))


def periods(df: DataFrame) -> DataFrame:
    """The periods present, newest first."""
    return require(df, ["period"]).select("period").distinct().orderBy(F.desc("period"))


def newest_period(df: DataFrame) -> Column:
    """The newest period as a scalar subquery, for `df.filter(col("period") == newest_period(df))`."""
    return df.agg(F.max("period")).scalar()


def only_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns in the given order, leaving out those the table does not have."""
    return df.select([c for c in columns if c in df.columns])


def positive(df: DataFrame, column: str) -> DataFrame:
    """Rows whose count is above zero."""
    return df.filter(F.col(column) > 0)
