"""Pressure, balance, renewals and the final table, per sector or residence.

The reports share two summaries, each one pass over the rows: applicants (`demand_summary`) and
places (`place_summary`). The passes read nearly disjoint columns. Everything after them works on one row
per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide.functions import adjusted_pressure, percent, raw_pressure
from roomtide.operators.demand import balance_demand, demand_summary
from roomtide.operators.joins import left_join_null_safe, star
from roomtide.operators.places import Order, place_summary, round_places
from roomtide.operators.selection import in_period, in_sectors, only_existing, require, sector_chosen
from roomtide.operators.shares import concentration
from roomtide.schema import NOT_ELIGIBLE, SECTOR


def _indicators(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    excluded: Sequence[str],
    sectors: Sequence[str] | None,
) -> DataFrame:
    """One row per group with applicants and every measure; the base of `pressure` and `report`.

    Applicants are needed of every sector, for the shares, and twice: per group and per period. Both
    uses read the same shuffle, as long as no filter is pushed into one of them only. Hence groups
    are required to be complete before and after counting, which leaves the planner no condition to
    add, and sectors are chosen by a condition that also needs the joined total.
    """
    rows = require(df, group)
    demand = demand_summary(rows, group, excluded)
    shared = concentration(require(demand, [*group, "applicants"]))
    if sectors is not None:
        shared = shared.filter(F.when(F.col("concentration_pct").isNotNull(), sector_chosen(sectors)))
        rows = in_sectors(rows, sectors)
    joined = star(shared, [place_summary(rows, group, order)], group)
    offered = F.col("offered")
    return joined.withColumn("pressure_raw", raw_pressure(F.col("applicants"), offered)).withColumn(
        "pressure_adjusted", adjusted_pressure(F.col("eligible_last_round"), offered, F.col("leftover"))
    )


def pressure(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    excluded: Sequence[str] = NOT_ELIGIBLE,
    period: str | None = None,
    sectors: Sequence[str] | None = None,
) -> DataFrame:
    """Demand, places, pressure and concentration of every sector or residence.

    Concentration is relative to the whole period: choose sectors with `sectors` or from the result,
    not before.
    """
    rows = df if period is None else in_period(df, period)
    # Coordinates exist at sector level only.
    return only_existing(
        _indicators(rows, group, order, excluded, sectors),
        [
            *group,
            "applicants",
            "capacity_total",
            "offered",
            "applicants_last_round",
            "leftover",
            "eligible_last_round",
            "latitude",
            "longitude",
            "pressure_raw",
            "pressure_adjusted",
            "concentration",
            "concentration_pct",
        ],
    )


def renewal(df: DataFrame, group: Sequence[str], order: Order) -> DataFrame:
    """Confirmed renewals, capacity and the share of capacity they fill."""
    places = place_summary(df, group, order)
    known = places.filter(
        F.col("renewals_confirmed").isNotNull() & F.col("period").isNotNull() & F.col("sector").isNotNull()
    )
    return known.select(
        *group,
        "renewals_confirmed",
        "capacity_total",
        percent(F.col("renewals_confirmed"), F.col("capacity_total")).alias("renewal_pct"),
    )


def balance(df: DataFrame, group: Sequence[str] = SECTOR) -> DataFrame:
    """Last-round applicants without a place: applicants minus the places of that round.

    May be negative; null if the table has no column for the round. Groups with a missing period or
    sector are kept, hence the null-safe join.
    """
    demand = balance_demand(df, group)
    joined = left_join_null_safe(demand, round_places(df, group), [*group, "round"])
    return joined.select(
        *group,
        "applicants_last_round_any",
        (F.col("applicants_last_round_any") - F.col("places")).alias("unplaced_last_round"),
    )


def _places_of_last_round(columns: Sequence[str]) -> Column:
    """The places column whose round is the row's last round."""
    chosen = [
        F.when(F.col("last_round_any") == float(c.removeprefix("places_")), F.col(c))
        for c in columns
        if c.startswith("places_")
    ]
    return F.coalesce(*chosen) if chosen else F.lit(None).cast("double")


def report(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    sectors: Sequence[str] | None = None,
    period: str | None = None,
    excluded: Sequence[str] = NOT_ELIGIBLE,
) -> DataFrame:
    """The final table: all indicators of the chosen sectors and period (every period if None).

    Has the groups with at least one row that has an applicant and offered places. Only the period
    may be chosen before aggregating: concentration needs every sector of it.
    """
    rows = df if period is None else in_period(df, period)
    joined = _indicators(rows, group, order, excluded, sectors)
    chosen = joined.filter(F.col("reportable_applicants").isNotNull())
    unplaced = F.col("applicants_last_round_any") - _places_of_last_round(joined.columns)
    return chosen.select(
        *group,
        "capacity_total",
        "offered",
        "leftover",
        percent(F.col("leftover"), F.col("offered")).alias("leftover_pct"),
        "applicants",
        "applicants_last_round",
        unplaced.alias("unplaced_last_round"),
        "concentration_pct",
        "pressure_raw",
        "pressure_adjusted",
        "renewals_confirmed",
        percent(F.col("renewals_confirmed"), F.col("capacity_total")).alias("renewal_pct"),
    )
