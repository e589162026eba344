"""One band per applicant, and counts by band."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtide.functions import parse_number
from roomtide.operators.joins import salted_join
from roomtide.operators.places import Order
from roomtide.operators.selection import in_period, in_sectors, require
from roomtide.schema import SECTOR, row_order


def _folded(df: DataFrame, order: Order, sectors, period, case_sensitive: bool) -> DataFrame:
    """One row per period, applicant, sector and band, with the place of its first row (`place`).

    With a number as order, or a `RowOrder` with a unit, this is a hash aggregate; the best band of an
    applicant is then looked for among these few rows.
    """
    rows = in_period(in_sectors(require(df, ["applicant_id", "period", "sector"]), sectors, case_sensitive), period)
    columns, unit = row_order(order)
    keys = ["period", "applicant_id", "sector", "scale_band"]
    if unit and len(columns) == unit + 1:
        found = rows.groupBy(*keys, *columns[:unit]).agg(F.min(columns[unit]).alias("place"))
        return found.withColumn("place", F.struct(*columns[:unit], "place")).drop(*columns[:unit])
    place = F.min(columns[0] if len(columns) == 1 else F.struct(*columns)).alias("place")
    # `banded` counts rows with a band: a filter on it stays above the aggregate, which several uses then share.
    counted = [F.count("scale_band").alias("banded")] if _in_one_number(df, order) else []
    return rows.groupBy(*keys).agg(place, *counted)


def _best() -> Column:
    """Aggregate: sector and band of the row with the highest numeric band; null without a band.

    Bands that are no numbers rank last; ties go to the first row.
    """
    rank = F.coalesce(-parse_number(F.col("scale_band")), F.lit(float("inf")))
    banded = F.when(F.col("scale_band").isNotNull(), F.struct(rank.alias("rank"), "place"))
    return F.min_by(F.struct("sector", "scale_band"), banded)


#: How an order in one number is built: the band's rank, 64 bits of the row's number, 31 bits for sector and band.
_PLACE, _CODE = 2**64, 2**31
#: True of every folded row. All uses of these ask for the same columns by it, so that they share one shuffle.
IN_USE = "place IS NOT NULL AND banded >= 0"


def _decimal(x: Column | int) -> Column:
    return (F.lit(Decimal(x)) if isinstance(x, int) else x).cast("decimal(38,0)")


def _in_one_number(df: DataFrame, order: Order) -> bool:
    columns = row_order(order).columns
    return len(columns) == 1 and dict(df.dtypes)[columns[0]] in ("tinyint", "smallint", "int", "bigint")


def _top_by_number(folded: DataFrame) -> DataFrame:
    """The top band of each applicant where rows are ordered by a whole number, by hash aggregation.

    Sectors and bands that occur together are few: they are numbered, and bands ranked, in a small table. Rank, row number
    and that number make one decimal, whose least value per applicant names the row, sector and band. Text or
    structs would be folded by sorting all rows.
    """
    banded = folded.filter(IN_USE).filter("banded > 0").withColumn("band", F.coalesce("scale_band", F.lit("")))
    rank = F.coalesce(-parse_number(F.col("band")), F.lit(float("inf")))
    numbered = banded.select("sector", "band").distinct().select(
        "sector",
        "band",
        F.dense_rank().over(Window.orderBy(rank)).alias("rank"),
        F.row_number().over(Window.orderBy(rank, "sector", "band")).alias("code"),
    )
    rows = salted_join(banded, numbered, ["sector", "band"])
    place = _decimal(F.col("place")) + _decimal(2**63)
    key = (_decimal(F.col("rank")) * _decimal(_PLACE) + place).cast("decimal(38,0)") * _decimal(_CODE) + _decimal(F.col("code"))
    best = rows.groupBy("period", "applicant_id").agg(F.min(key.cast("decimal(38,0)")).alias("best"))
    named = best.select("period", "applicant_id", (F.col("best") % _decimal(_CODE)).cast("int").alias("code"))
    found = salted_join(named, numbered.drop("rank"), ["code"])
    return found.select("period", "applicant_id", "sector", F.col("band").alias("scale_band"))


def top_band_per_applicant(
    df: DataFrame,
    order: Order,
    sectors=None,
    period=None,
    case_sensitive: bool = False,
) -> DataFrame:
    """One row per period and applicant: the sector and band of the row with the highest numeric band.

    An aggregate, not a window: rows of one applicant are folded before the shuffle, by hash where the order is a whole
    number.
    """
    rows = _folded(require(df, ["scale_band"]), order, sectors, period, case_sensitive)
    if _in_one_number(df, order):
        return _top_by_number(rows)
    kept = rows.groupBy("period", "applicant_id").agg(_best().alias("best"))
    return kept.select("period", "applicant_id", "best.sector", "best.scale_band")


def band_counts(
    df: DataFrame, order: Order, sectors=None, period=None, case_sensitive: bool = False
) -> DataFrame:
    """Applicants per period, sector and band, each applicant credited once per period."""
    kept = top_band_per_applicant(df, order, sectors, period, case_sensitive)
    return kept.groupBy(*SECTOR, "scale_band").agg(F.count("*").alias("applicants"))


def credits(
    df: DataFrame, order: Order, sectors: Sequence[str] | None = None, period=None, case_sensitive: bool = False
) -> DataFrame:
    """Applicants per period, sector and credited band, in one pass over the rows.

    An applicant counts in each of their sectors: with their top band in the sector it is credited to, with
    a null band in the others. So the sum over all bands is the number of a sector's applicants, and the
    rows with a band are those of `band_counts`.
    """
    rows = _folded(df, order, sectors, period, case_sensitive)
    if _in_one_number(df, order):
        return _credits_by_number(rows)
    # The sectors that one applicant applied in.
    found = rows.groupBy("period", "applicant_id").agg(_best().alias("best"), F.collect_set("sector").alias("sectors"))
    each = found.select("period", "best", F.explode("sectors").alias("sector"))
    band = F.when(F.col("sector") == F.col("best.sector"), F.col("best.scale_band"))
    return each.groupBy(*SECTOR, band.alias("scale_band")).agg(F.count("*").alias("applicants"))


def _credits_by_number(folded: DataFrame) -> DataFrame:
    """`credits` without a set per applicant: those without credit in a sector are all of its applicants less the credited."""
    n = F.col("applicants")
    credited = _top_by_number(folded).groupBy(*SECTOR, "scale_band").agg(F.count("*").alias("applicants"))
    applied = folded.filter(IN_USE).select(*SECTOR, "applicant_id").distinct()
    everyone = applied.groupBy(*SECTOR).agg(F.count("*").alias("applicants"))
    none = F.lit(None).cast("string").alias("scale_band")
    parts = [everyone.select(*SECTOR, none, n), credited.select(*SECTOR, none, -n), credited]
    counts = reduce(DataFrame.union, parts).toDF(*SECTOR, "scale_band", "applicants")
    return counts.groupBy(*SECTOR, "scale_band").agg(F.sum("applicants").alias("applicants")).filter("applicants > 0")
