"""Applicant counts.

Every count of applicants first reduces the rows to one per group and applicant, with partial
aggregation before the shuffle. The shuffle key includes the applicant, so a group holding a large
share of the rows is still spread over all tasks, and an applicant with many rows is folded
before it travels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide.functions import round_from_all_digits, round_from_first_digits
from roomtide.operators.joins import salted_join
from roomtide.operators.selection import all_present, eligible, in_period, in_sectors, is_eligible, require
from roomtide.schema import NOT_ELIGIBLE, SECTOR


def needed_for_demand(group: Sequence[str]) -> list[str]:
    """Columns a row must have to count as demand, whatever the group."""
    needed = ["period", "sector", "applicant_id"]
    return needed + ["residence"] if "residence" in group else needed


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of `columns`."""
    return df.select(*columns).distinct()


def count_applicants(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distinct applicants per group."""
    rows = require(df, needed_for_demand(group))
    return rows.groupBy(*group).agg(F.count_distinct("applicant_id").alias("applicants"))


def _applicants_at_highest_round(rows: DataFrame, group: Sequence[str], round_number: Column) -> DataFrame:
    """Per group: its highest round and how many applicants have a row in it.

    An applicant has a row in the group's highest round exactly if their own highest round equals
    it, so one row per applicant suffices.
    """
    highest = rows.groupBy(*group, "applicant_id").agg(F.max(round_number).alias("round"))
    per_round = highest.filter("round IS NOT NULL").groupBy(*group, "round").agg(F.count("*").alias("n"))
    return per_round.groupBy(*group).agg(F.max("round").alias("round"), F.max_by("n", "round").alias("n"))


def last_round_applicants(
    df: DataFrame,
    group: Sequence[str],
    eligible_only: bool = False,
    excluded: Sequence[str] = NOT_ELIGIBLE,
) -> DataFrame:
    """Distinct applicants of each group's last round.

    With `eligible_only` the last round is that of the eligible rows, which may be an earlier one.
    """
    rows = require(df, needed_for_demand(group))
    if eligible_only:
        rows = eligible(rows, excluded)
    name = "eligible_last_round" if eligible_only else "applicants_last_round"
    counts = _applicants_at_highest_round(rows, group, round_from_all_digits(F.col("round_label")))
    return counts.select(*group, F.col("n").alias(name))


def _rows_with_round(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return require(df, needed_for_demand(group)).withColumn("round", round_from_all_digits(F.col("round_label")))


def last_rounds(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The number of the last round of each group, as `round`."""
    return _rows_with_round(df, group).groupBy(*group).agg(F.max("round").alias("round"))


def last_round_rows(df: DataFrame, group: Sequence[str], last: DataFrame | None = None) -> DataFrame:
    """The rows that belong to the last round of their group, with its number as `round`.

    The maximum is aggregated and joined back instead of taken over a window, so that no task has to
    hold a whole group. Groups and rounds are few, so the join is salted: rows of a large group go to many tasks.
    `last` may give the result of `last_rounds`, for instance read from a table or with a hint: where it
    is known to be small, a broadcast spares the shuffle of the rows.
    """
    rows = _rows_with_round(df, group)
    if last is not None:
        return rows.join(last, [*group, "round"], "left_semi")
    return salted_join(rows, last_rounds(df, group), [*group, "round"], "left_semi")


def balance_demand(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distinct applicants of the last round, for the balance.

    Unlike `last_round_applicants`, rows without period or sector count, and the round is the
    first run of digits of its label.
    """
    rows = require(df, ["applicant_id"] + (["residence"] if "residence" in group else []))
    counts = _applicants_at_highest_round(rows, group, round_from_first_digits(F.col("round_label")))
    return counts.select(*group, "round", F.col("n").alias("applicants_last_round_any"))


def wishes_per_applicant(df: DataFrame, group: Sequence[str], sectors=None, period=None) -> DataFrame:
    """Rows and distinct applicants per group among the rows with offered places."""
    needed = ["sector", "offered_total", "applicant_id"] + (["residence"] if "residence" in group else [])
    rows = in_period(in_sectors(require(df, needed), sectors), period)
    per_applicant = rows.groupBy(*group, "applicant_id").agg(F.count("*").alias("wishes"))
    return per_applicant.groupBy(*group).agg(
        F.count("*").alias("distinct_applicants"), F.sum("wishes").alias("total_wishes")
    )


def reportable_groups(df: DataFrame, group: Sequence[str], sectors=None, period=None) -> DataFrame:
    """Groups with at least one row of the selection that has offered places and an applicant."""
    needed = ["sector", "offered_total", "applicant_id"] + (["residence"] if "residence" in group else [])
    return distinct_pairs(in_period(in_sectors(require(df, needed), sectors), period), group)


def applicants_per_period(df: DataFrame, sectors=None) -> DataFrame:
    """Applicants per period, one count for each sector they applied in."""
    rows = in_sectors(require(df, ["period", "sector", "applicant_id"]), sectors)
    pairs = distinct_pairs(rows, ["period", "sector", "applicant_id"])
    return pairs.groupBy("period").agg(F.count("*").alias("applicants"))


def sector_applicants(df: DataFrame, sectors=None, period=None, case_sensitive: bool = False) -> DataFrame:
    """Distinct applicants per period and sector of the selection."""
    rows = in_period(require(df, ["sector", "applicant_id"]), period)
    rows = in_sectors(rows, sectors, case_sensitive)
    return rows.groupBy(*SECTOR).agg(F.count_distinct("applicant_id").alias("sector_applicants"))


def demand_summary(
    df: DataFrame, group: Sequence[str], excluded: Sequence[str] = NOT_ELIGIBLE
) -> DataFrame:
    """All applicant counts of the sector and residence reports from one pass over the rows.

    Columns: the group, `applicants`, `applicants_last_round`, `eligible_last_round`,
    `applicants_last_round_any` with its `last_round_any` (see `balance_demand`) and
    `reportable_applicants` (those with a row that has offered places). A count is null where the
    single operator would have no row for the group.

    Each applicant is first folded to their highest round under each rule. Counting applicants per
    (rule, round) then leaves few rows, from which `max_by` picks each rule's last round.
    """
    needed = ["applicant_id"] + (["residence"] if "residence" in group else [])
    # Each label is parsed once per rule, below the aggregation.
    rows = require(df, needed).select(
        *group,
        "applicant_id",
        all_present(needed_for_demand(group)).alias("counted"),
        is_eligible(excluded).alias("eligible"),
        F.col("offered_total").isNotNull().alias("has_places"),
        round_from_all_digits(F.col("round_label")).alias("round_all"),
        round_from_first_digits(F.col("round_label")).alias("round_first"),
    )
    per_applicant = rows.groupBy(*group, "applicant_id").agg(
        F.max(F.expr("if(counted, 0D, null)")).alias("applicants"),
        F.max(F.expr("if(counted, round_all, null)")).alias("applicants_last_round"),
        F.max(F.expr("if(counted AND eligible, round_all, null)")).alias("eligible_last_round"),
        F.max("round_first").alias("applicants_last_round_any"),
        F.max(F.expr("if(counted AND has_places, 0D, null)")).alias("reportable_applicants"),
    )
    rules = [
        "applicants",
        "applicants_last_round",
        "eligible_last_round",
        "applicants_last_round_any",
        "reportable_applicants",
    ]
    per_round = count_by_rule(per_applicant, group, rules)
    any_round = F.when(F.col("rule") == "applicants_last_round_any", F.col("round"))
    return per_round.groupBy(*group).agg(
        *[last_count(rule) for rule in rules], F.max(any_round).alias("last_round_any")
    )


def count_by_rule(
    per_applicant: DataFrame, group: Sequence[str], rules: Sequence[str], weight: Column | None = None
) -> DataFrame:
    """Long counts (group, rule, round, n) from one row per applicant with a round column per rule."""
    kept = [c for c in per_applicant.columns if c not in rules and c != "applicant_id"]
    # A generator rather than unpivot: it keeps what is known of the group columns, so that two uses
    # of the counts in one query are planned alike and share this shuffle.
    pairs = [part for rule in rules for part in (F.lit(rule), F.col(rule))]
    long = per_applicant.select(*kept, F.stack(F.lit(len(rules)), *pairs).alias("rule", "round"))
    n = F.count("*") if weight is None else F.sum(weight)
    return long.filter("round IS NOT NULL").groupBy(*group, "rule", "round").agg(n.alias("n"))


def last_count(rule: str) -> Column:
    """Aggregate: the count of the rule's highest round."""
    return F.max_by("n", F.when(F.col("rule") == rule, F.col("round"))).alias(rule)
