"""Applicants by grant band."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtide.functions import band_rank, ratio, round_to
from roomtide.operators.bands import credits
from roomtide.operators.places import Order
from roomtide.operators.reshape import band_sums
from roomtide.operators.selection import positive
from roomtide.schema import BAND_ORDER, BANDS, NON_GRANT, SECTOR, TOTAL


def band_table(
    df: DataFrame,
    order: Order,
    sectors: Sequence[str] | None = None,
    period: str | None = None,
    bands: Sequence[str] | None = BANDS,
    with_total: bool = True,
    case_sensitive: bool = False,
) -> DataFrame:
    """Sectors by band with holders of no grant and totals, and a total row per period (last).

    Each applicant is credited to one sector while the sector's applicants count them in each, so
    `non_grant` includes grant holders credited elsewhere. Sectors without any credited applicant are
    left out. With `bands` a band counts in any letter case ("0 bis" in `band_0_bis`), and others are
    summed in `band_other`; `bands=None` looks the bands up and gives each spelling a column. A band
    called like the holders of no grant has no column, as theirs is computed.
    """
    counts = credits(df, order, sectors, period, case_sensitive)
    banded = counts.filter(F.col("scale_band") != NON_GRANT)
    sums = band_sums(bands, banded if bands is None else counts, "applicants")
    if "band_other" in sums:
        spared = F.sum(F.when(F.lower("scale_band") == NON_GRANT.lower(), F.col("applicants")))
        sums["band_other"] = sums["band_other"] - F.coalesce(spared, F.lit(0))
    in_bands = F.coalesce(F.sum(F.when(F.col("scale_band").isNotNull(), F.col("applicants"))), F.lit(0))
    table = counts.groupBy(*SECTOR).agg(
        *[c.alias(n) for n, c in sums.items()], in_bands.alias("in_bands"), F.sum("applicants").alias("sector_applicants")
    )
    total = reduce(Column.__add__, [F.col(n) for n in sums], F.col("non_grant"))
    table = (
        table.filter("in_bands > 0")
        .withColumn("non_grant", F.greatest(F.col("sector_applicants") - F.col("in_bands"), F.lit(0)))
        .withColumn("total", total)
        .drop("in_bands", "sector_applicants")
    )
    return with_total_rows(table) if with_total else table


def with_total_rows(table: DataFrame) -> DataFrame:
    """Add a row per period that sums its sectors, after them."""
    measures = [c for c in table.columns if c not in SECTOR]
    summed = table.groupingSets([SECTOR, ["period"]], *SECTOR).agg(
        F.grouping("sector").alias("is_total"), *[F.sum(m).alias(m) for m in measures]
    )
    named = F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col("sector")).alias("sector")
    ordered = summed.orderBy("period", "is_total", "sector")
    return ordered.select("period", named, *measures)


def band_distribution(
    df: DataFrame,
    order: Order,
    sectors: Sequence[str] | None = None,
    period: str | None = None,
    band_order: Sequence[str] = BAND_ORDER,
    case_sensitive: bool = True,
) -> DataFrame:
    """Applicants and share by band per period, with holders of no grant, in display order.

    Only positive counts appear. Sectors are compared exactly here.
    """
    counts = credits(df, order, sectors, period, case_sensitive)
    banded, n = F.col("scale_band").isNotNull(), F.col("applicants")
    per_sector = counts.groupBy(*SECTOR).agg(
        F.sum(n).alias("sector_applicants"),
        F.sum(F.when(banded, n)).alias("in_bands"),
        # The bands of one sector; one called like the holders of no grant gives way to their computed number.
        F.collect_list(F.when(banded & (F.col("scale_band") != NON_GRANT), F.struct("scale_band", "applicants"))).alias("parts"),
    )
    without = F.struct(
        F.lit(NON_GRANT).alias("scale_band"),
        F.greatest(F.col("sector_applicants") - F.col("in_bands"), F.lit(0)).alias("applicants"),
    )
    parts = per_sector.filter("in_bands > 0").select("period", F.inline(F.concat("parts", F.array(without))))
    summed = parts.groupBy("period", "scale_band").agg(F.sum("applicants").alias("applicants"))
    # A few bands per period.
    total = F.sum("applicants").over(Window.partitionBy("period"))
    shares = positive(summed, "applicants").withColumn("total", total)
    share = round_to(ratio(F.col("applicants") * 100.0, F.col("total")), 1)
    return (
        shares.withColumn("share_pct", share)
        .orderBy("period", band_rank(F.col("scale_band"), tuple(band_order)), "scale_band")
        .select("period", "scale_band", "applicants", "share_pct", "total")
    )
