"""Sums of residence-level facts that repeat on every application row.

"First" always means first in the row order given by `order`, which must be unique per row: column
names or a `RowOrder`. With a single number as order, or a `RowOrder` with a unit, these aggregations
stay on the hash path; several columns are compared as a struct, which Spark aggregates by sorting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide.operators.reshape import round_columns
from roomtide.operators.selection import all_present, in_sectors, require
from roomtide.schema import RESIDENCE, SECTOR, RowOrder, row_order

Order = RowOrder | Sequence[str]

# Residence-level facts that repeat on every row.
FACTS = ["capacity", "offered_total", "leftover", "renewals_confirmed"]


def first_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    firsts: Mapping[str, tuple[Column, Mapping[str, str]]],
    sums: Mapping[str, Column] | None = None,
    largest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per key: values of first rows, with sums and maxima from the same pass.

    `firsts` gives, by the name for the place of the first row, the condition that row must satisfy
    and the columns to take from it, by result name. Values may be null; the place is null if no row
    satisfies the condition.
    """
    columns, unit = row_order(order)
    sums, largest = sums or {}, largest or {}
    totals = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max(c).alias(n) for n, c in largest.items()]
    if len(columns) == 1:
        return df.groupBy(*keys).agg(*_firsts_by_number(columns[0], firsts), *totals)
    if unit and len(columns) == unit + 1:
        stretch = columns[:unit]
        per_stretch = df.groupBy(*keys, *stretch).agg(*_firsts_by_number(columns[unit], firsts), *totals)
        winners = {
            place: (F.col(place).isNotNull(), {name: name for name in values})
            for place, (_, values) in firsts.items()
        }
        merged = [F.sum(n).alias(n) for n in sums] + [F.max(n).alias(n) for n in largest]
        return _firsts_by_struct(per_stretch, keys, {p: [*stretch, p] for p in firsts}, winners, merged)
    return _firsts_by_struct(df, keys, dict.fromkeys(firsts, columns), firsts, totals)


def _firsts_by_number(position: str, firsts) -> list[Column]:
    """Aggregates for an order by one column; their buffers are fixed-size, which hashing needs."""
    found = []
    for place, (where, values) in firsts.items():
        at = F.when(where, F.col(position))
        found.append(F.min(at).alias(place))
        found += [F.min_by(value, at).alias(name) for name, value in values.items()]
    return found


def _firsts_by_struct(df: DataFrame, keys, places: Mapping[str, Sequence[str]], firsts, totals) -> DataFrame:
    """First rows by an order of several columns: the values travel with the place, as one minimum."""
    found, results = [], []
    for place, (where, values) in firsts.items():
        row = F.struct(F.struct(*places[place]).alias(place), *[F.col(v).alias(n) for n, v in values.items()])
        found.append(F.min(F.when(where, row)).alias(f"first_{place}"))
        results += [F.col(f"first_{place}")[n].alias(n) for n in (place, *values)]
    grouped = df.groupBy(*keys).agg(*found, *totals)
    kept = [c for c in grouped.columns if c not in {f"first_{p}" for p in firsts}]
    return grouped.select(*kept, *results)


def sum_first_per(df: DataFrame, group: Sequence[str], value: str, order: Order, name: str) -> DataFrame:
    """Per group: the first present `value` of each residence, summed."""
    rows = require(df, ["sector", value, "residence", "period"])
    keys = list(dict.fromkeys([*group, "residence"]))
    first = first_values(rows, keys, order, {"place": (F.lit(True), {name: value})})
    if set(keys) == set(group):
        return first.select(*group, name)
    return first.groupBy(*group).agg(F.sum(name).alias(name))


def capacity(df: DataFrame, group: Sequence[str], order: Order) -> DataFrame:
    """Dwellings per group. At period level a residence name shared by two sectors counts once."""
    return sum_first_per(df, group, "capacity", order, "capacity_total")


def offered(df: DataFrame, group: Sequence[str], order: Order) -> DataFrame:
    """Offered places per group."""
    return sum_first_per(df, group, "offered_total", order, "offered")


def offered_per_period(df: DataFrame, order: Order, sectors=None) -> DataFrame:
    """Offered places per period over the residences of the chosen sectors."""
    per_residence = offered(in_sectors(df, sectors), RESIDENCE, order)
    return per_residence.groupBy("period").agg(F.sum("offered").alias("offered"))


def leftover(df: DataFrame, group: Sequence[str], strict: bool = False) -> DataFrame:
    """Unassigned places: the sum of the distinct values of each group.

    Two residences of a group with equal leftover count once. `strict` also requires a residence at
    sector level.
    """
    needed = ["sector", "period", "leftover"]
    if strict or "residence" in group:
        needed.append("residence")
    return require(df, needed).groupBy(*group).agg(F.sum_distinct("leftover").alias("leftover"))


def leftover_per_period(
    df: DataFrame,
    sectors=None,
    per: Sequence[str] = ("period", "sector", "residence"),
    residence_needed: bool = False,
) -> DataFrame:
    """Unassigned places per period: distinct values per `per`, summed.

    The yearly chart uses the default; the yearly table uses `per=("period", "residence")` with
    `residence_needed`.
    """
    needed = ["sector", "leftover", "period"] + (["residence"] if residence_needed else [])
    rows = in_sectors(require(df, needed), sectors)
    distinct = rows.select(*per, "leftover").distinct()
    return distinct.groupBy("period").agg(F.sum("leftover").alias("leftover"))


def renewals(df: DataFrame, group: Sequence[str], order: Order) -> DataFrame:
    """Confirmed renewals: those on the first row of each residence with a capacity, summed.

    A missing first value counts as 0 even if later rows have one.
    """
    rows = require(df, ["sector", "capacity", "period"] + (["residence"] if "residence" in group else []))
    keys = list(dict.fromkeys([*group, "residence"]))
    first = first_values(rows, keys, order, {"place": (F.lit(True), {"first": "renewals_confirmed"})})
    first = first.withColumn("renewals_confirmed", F.coalesce("first", F.lit(0.0)))
    if set(keys) == set(group):
        return first.select(*group, "renewals_confirmed")
    return first.groupBy(*group).agg(F.sum("renewals_confirmed").alias("renewals_confirmed"))


def renewals_per_period(df: DataFrame) -> DataFrame:
    """Confirmed renewals per period over the distinct (sector, residence, renewals, capacity)."""
    rows = require(df, ["sector", "capacity", "residence", "period"])
    distinct = rows.select(*RESIDENCE, "renewals_confirmed", "capacity").distinct()
    return distinct.groupBy("period").agg(
        F.coalesce(F.sum("renewals_confirmed"), F.lit(0.0)).alias("renewals_confirmed")
    )


def sector_coordinates(df: DataFrame) -> DataFrame:
    """Mean coordinates per period and sector over the rows that have both."""
    rows = require(df, ["sector", "latitude", "longitude", "period"])
    return rows.groupBy(*SECTOR).agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )


def round_places_wide(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group: places of each round, one column `places_<k>` per round number.

    The largest value per residence (0 if none), summed over the residences, those without a name
    included. The columns are folded before any reshaping, so no row is multiplied.
    """
    rounds = places_by_round(df)
    keys = list(dict.fromkeys([*group, "residence"]))
    per_residence = df.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in rounds.items()])
    if set(keys) == set(group):
        return per_residence.fillna(0.0, list(rounds))
    return per_residence.groupBy(*group).agg(
        *[F.sum(F.coalesce(n, F.lit(0.0))).alias(n) for n in rounds]
    )


def places_by_round(df: DataFrame) -> dict[str, Column]:
    """`places_<k>` for each round k: its column, or the largest if several name the same round."""
    return {
        f"places_{k}": F.greatest(*names) if len(names) > 1 else F.col(names[0])
        for k, names in round_columns(df).items()
    }


def round_places(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Places of each round, one row per group and round."""
    wide = round_places_wide(df, group)
    columns = [c for c in wide.columns if c not in group]
    long = wide.unpivot(list(group), columns, "name", "places")
    return long.select(*group, F.substring_index("name", "_", -1).cast("double").alias("round"), "places")


def folded(df: DataFrame, order: Order) -> DataFrame:
    """One row per residence of a period and combination of its facts, null keys included.

    Facts repeat on every row, so this is little more than one row per residence, and all place measures
    follow from it: the place of the first row of each combination in the order (`place`), the largest
    places per round, and coordinate sums over the rows that have both coordinates.
    """
    columns, unit = row_order(order)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    measures = [
        F.sum(F.when(located, F.col("latitude"))).alias("latitude_sum"),
        F.sum(F.when(located, F.col("longitude"))).alias("longitude_sum"),
        F.sum(F.when(located, 1).otherwise(0)).alias("located_rows"),
        *[F.max(c).alias(n) for n, c in places_by_round(df).items()],
    ]
    keys = [*RESIDENCE, *FACTS]
    if unit and len(columns) == unit + 1:
        # A number within each stretch of input; a struct with the stretch only for these few rows.
        rows = df.groupBy(*keys, *columns[:unit]).agg(F.min(columns[unit]).alias("place"), *measures)
        return rows.withColumn("place", F.struct(*columns[:unit], "place")).drop(*columns[:unit])
    place = F.min(columns[0] if len(columns) == 1 else F.struct(*columns))
    return df.groupBy(*keys).agg(place.alias("place"), *measures)


def residence_facts(df: DataFrame, order: Order) -> DataFrame:
    """Everything the reports need to know of a residence in a period, from one pass over the rows.

    One row per (period, sector, residence), null keys included: first present capacity and offered
    places, renewals on the first row with a capacity (null without one), largest places per round,
    coordinate sums over the rows that have both coordinates, the distinct leftover values and the
    distinct pairs of renewals and capacity.
    """
    with_capacity = F.when(F.col("capacity").isNotNull(), F.col("place"))
    with_offered = F.when(F.col("offered_total").isNotNull(), F.col("place"))
    pair = F.when(F.col("capacity").isNotNull(), F.struct("renewals_confirmed", "capacity"))
    facts = folded(df, order).groupBy(*RESIDENCE).agg(
        F.min(with_capacity).alias("capacity_order"),
        F.min_by("capacity", with_capacity).alias("capacity"),
        F.min_by("renewals_confirmed", with_capacity).alias("first_renewals"),
        F.min_by("offered_total", with_offered).alias("offered"),
        F.sum("latitude_sum").alias("latitude_sum"),
        F.sum("longitude_sum").alias("longitude_sum"),
        F.sum("located_rows").alias("located_rows"),
        *[F.max(n).alias(n) for n in places_by_round(df)],
        F.collect_set("leftover").alias("leftovers"),
        F.collect_set(pair).alias("renewal_pairs"),
    )
    renewed = F.when(F.col("capacity").isNotNull(), F.coalesce("first_renewals", F.lit(0.0)))
    return facts.withColumn("renewals_confirmed", renewed)


def place_summary(df: DataFrame, group: Sequence[str], order: Order) -> DataFrame:
    """All place measures of the sector or residence reports from one pass over the rows.

    Columns: the group, `capacity_total`, `offered`, `renewals_confirmed`, `leftover`, `places_<k>` and,
    at sector level, `latitude` and `longitude`. A measure is null where the single operator has no row.
    """
    facts = residence_facts(df, order)
    rounds = [c for c in facts.columns if c.startswith("places_")]
    placed = all_present(["period", "sector"])
    if "residence" in group:
        total = F.aggregate("leftovers", F.lit(0.0), lambda a, b: a + b)
        return facts.filter(F.col("residence").isNotNull()).select(
            *group,
            F.col("capacity").alias("capacity_total"),
            "offered",
            "renewals_confirmed",
            F.when(placed & (F.size("leftovers") > 0), total).alias("leftover"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in rounds],
        )
    # A row for each leftover value of a residence; its other measures are on the first of them.
    rows = facts.select("*", F.posexplode_outer("leftovers").alias("nth", "leftover_value"))
    first = F.coalesce(F.col("nth"), F.lit(0)) == 0
    named = first & F.col("residence").isNotNull()
    return rows.groupBy(*group).agg(
        F.sum(F.when(named, F.col("capacity"))).alias("capacity_total"),
        F.sum(F.when(named, F.col("offered"))).alias("offered"),
        F.sum(F.when(first, F.col("renewals_confirmed"))).alias("renewals_confirmed"),
        F.sum_distinct(F.when(placed, F.col("leftover_value"))).alias("leftover"),
        F.try_divide(F.sum(F.when(first, F.col("latitude_sum"))), F.sum(F.when(first, F.col("located_rows")))).alias(
            "latitude"
        ),
        F.try_divide(F.sum(F.when(first, F.col("longitude_sum"))), F.sum(F.when(first, F.col("located_rows")))).alias(
            "longitude"
        ),
        *[F.sum(F.when(first, F.coalesce(c, F.lit(0.0)))).alias(c) for c in rounds],
    )
