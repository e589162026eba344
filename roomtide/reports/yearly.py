"""Overviews with one row per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtide.functions import (
    adjusted_pressure,
    missing_if_nan,
    percent,
    ratio,
    raw_pressure,
    round_from_all_digits,
)
from roomtide.operators.demand import count_by_rule, last_count
from roomtide.operators.joins import star
from roomtide.operators.places import Order, residence_facts
from roomtide.operators.selection import in_sectors, is_eligible, require, sector_chosen
from roomtide.operators.shares import yearly_growth
from roomtide.schema import NOT_ELIGIBLE, PERIOD

MEASURES = ("applicants", "applicants_last_round", "offered", "leftover")


def yearly_demand(
    df: DataFrame, sectors: Sequence[str] | None = None, excluded: Sequence[str] = NOT_ELIGIBLE
) -> DataFrame:
    """Applicant counts per period from one pass over the rows.

    `applicants` counts each chosen sector an applicant applied in; the last-round counts are over
    all sectors, and the last round is that of the whole period.
    """
    rows = require(df, ["period", "sector", "applicant_id"]).select(
        "period",
        "sector",
        "applicant_id",
        is_eligible(excluded).alias("eligible"),
        round_from_all_digits(F.col("round_label")).alias("round"),
    )
    per_sector = rows.groupBy("period", "sector", "applicant_id").agg(
        F.max("round").alias("applicants_last_round"),
        F.max(F.when(F.col("eligible"), F.col("round"))).alias("eligible_last_round"),
    )
    per_applicant = per_sector.groupBy("period", "applicant_id").agg(
        F.count(F.when(sector_chosen(sectors), 1)).alias("sectors"),
        F.lit(0.0).alias("applicants"),
        F.max("applicants_last_round").alias("applicants_last_round"),
        F.max("eligible_last_round").alias("eligible_last_round"),
    )
    rules = ["applicants", "applicants_last_round", "eligible_last_round"]
    weight = F.when(F.col("rule") == "applicants", F.col("sectors")).otherwise(1)
    counts = count_by_rule(per_applicant, PERIOD, rules, weight).groupBy("period")
    return counts.agg(*[last_count(rule) for rule in rules]).withColumn(
        "applicants", F.when(F.col("applicants") > 0, F.col("applicants"))
    )


def yearly_places(
    df: DataFrame,
    order: Order,
    sectors: Sequence[str] | None = None,
    leftover_per: Sequence[str] = ("period", "sector", "residence"),
    residence_needed: bool = False,
) -> DataFrame:
    """All place measures per period from one pass over the rows.

    Offered places and `leftover` are those of the chosen sectors, capacity and renewals of all. Capacity
    takes the first row of each residence name in the period, whatever its sector. Leftover sums the
    distinct values per `leftover_per`, with `residence_needed` only of rows that name a residence.
    Periods without offered places in the selection are left out.
    """
    facts = residence_facts(require(df, ["period", "sector"]), order)
    named, chosen = F.col("residence").isNotNull(), sector_chosen(sectors)
    counted = chosen & named if residence_needed else chosen
    values = F.transform("leftovers", lambda v: F.struct(F.col("sector").alias("sector"), v.alias("value")))
    pairs_sum = F.aggregate(
        "renewal_pairs", F.lit(0.0), lambda a, pair: a + F.coalesce(pair["renewals_confirmed"], F.lit(0.0))
    )
    per_name = facts.groupBy("period", "residence").agg(
        F.min_by("capacity", F.when(named, F.col("capacity_order"))).alias("capacity"),
        F.sum(F.when(chosen & named, F.col("offered"))).alias("offered"),
        F.sum(F.when(named & (F.size("renewal_pairs") > 0), pairs_sum)).alias("renewals_confirmed"),
        # The values of a residence name, one for each sector and fact: a few.
        F.flatten(F.collect_list(F.when(counted, values))).alias("values"),
    )
    # A row for each leftover value; the other measures are on the first of a name.
    measures = ["capacity", "offered", "renewals_confirmed"]
    rows = per_name.select("period", "residence", *measures, F.posexplode_outer("values").alias("nth", "of"))
    first = F.coalesce(F.col("nth"), F.lit(0)) == 0
    rows = rows.select(
        "period",
        "residence",
        *[F.when(first, F.col(m)).alias(m) for m in measures],
        F.col("of.sector").alias("sector"),
        F.col("of.value").alias("leftover"),
    )
    per = [c for c in leftover_per if c != "period"]
    distinct = rows.groupBy("period", *per, "leftover").agg(*[F.sum(m).alias(m) for m in measures])
    per_period = distinct.groupBy("period").agg(
        F.sum("capacity").alias("capacity_total"),
        F.sum("offered").alias("offered"),
        F.sum("renewals_confirmed").alias("renewals_confirmed"),
        F.sum("leftover").alias("leftover"),
    )
    return require(per_period, ["offered"])


def _pressures() -> dict[str, Column]:
    offered = F.col("offered")
    return {
        "pressure_raw": raw_pressure(F.col("applicants"), offered),
        "pressure_adjusted": adjusted_pressure(F.col("eligible_last_round"), offered, F.col("leftover")),
    }


def yearly_overview(
    df: DataFrame,
    order: Order,
    sectors: Sequence[str] | None = None,
    excluded: Sequence[str] = NOT_ELIGIBLE,
    select_everywhere: bool = False,
    leftover_per: Sequence[str] = ("period", "sector", "residence"),
) -> DataFrame:
    """Demand, places and pressure per period, oldest first.

    The sector selection applies to offered places, applicants and leftover places; last-round counts
    stay over all sectors unless `select_everywhere`.
    """
    rows = in_sectors(df, sectors) if select_everywhere else df
    joined = star(
        yearly_places(rows, order, sectors, leftover_per),
        [yearly_demand(rows, sectors, excluded)],
        PERIOD,
    )
    return (
        joined.withColumns(_pressures())
        .select(
            "period",
            "offered",
            "applicants",
            "leftover",
            "applicants_last_round",
            "eligible_last_round",
            "pressure_adjusted",
            "pressure_raw",
        )
        .orderBy("period")
    )


def yearly_table(
    df: DataFrame,
    order: Order,
    sectors: Sequence[str] | None = None,
    excluded: Sequence[str] = NOT_ELIGIBLE,
    select_everywhere: bool = False,
    leftover_per: Sequence[str] = ("period", "residence"),
) -> DataFrame:
    """The yearly table with growth and renewals, oldest period first.

    As in `yearly_overview` only offered places, applicants and leftover places follow the selection;
    leftover counts each residence name once per period.
    """
    rows = in_sectors(df, sectors) if select_everywhere else df
    joined = star(
        yearly_places(rows, order, sectors, leftover_per, residence_needed=True),
        [yearly_demand(rows, sectors, excluded)],
        PERIOD,
    )
    complete = joined.withColumns(
        {
            **_pressures(),
            "leftover_pct": percent(F.col("leftover"), F.col("offered")),
            "renewal_pct": percent(F.col("renewals_confirmed"), F.col("capacity_total")),
        }
    )
    return (
        yearly_growth(complete)
        .select(
            "period",
            "capacity_total",
            "offered",
            "leftover",
            "leftover_pct",
            "applicants",
            "applicants_last_round",
            "pressure_raw",
            "pressure_adjusted",
            "offered_growth_pct",
            "applicants_growth_pct",
            "renewals_confirmed",
            "renewal_pct",
        )
        .orderBy("period")
    )


def yearly_long(overview: DataFrame) -> DataFrame:
    """The four measures of the overview as (period, type, value)."""
    doubles = overview.select("period", *[F.col(m).cast("double").alias(m) for m in MEASURES])
    return doubles.unpivot(["period"], list(MEASURES), "type", "value")


def yearly_dual_axis(overview: DataFrame) -> DataFrame:
    """Both pressures scaled to the axis of the counts.

    The scale is the largest measure over the largest pressure; missing values do not count. The
    overview has one row per period, so the window over all of it is a handful of rows.
    """
    whole = Window.partitionBy()
    largest = F.greatest(*[F.col(m).cast("double") for m in MEASURES])
    largest_ratio = F.greatest(*[missing_if_nan(F.col(p)) for p in ("pressure_raw", "pressure_adjusted")])
    scaled = overview.withColumn("max_y", F.max(largest).over(whole)).withColumn(
        "max_ratio", F.max(largest_ratio).over(whole)
    )

    def on_axis(name: str) -> Column:
        return ratio(F.col(name) * F.col("max_y"), F.col("max_ratio"))

    return scaled.select(
        "period",
        on_axis("pressure_raw").alias("raw_scaled"),
        on_axis("pressure_adjusted").alias("adjusted_scaled"),
        "max_y",
        "max_ratio",
    ).orderBy("period")
