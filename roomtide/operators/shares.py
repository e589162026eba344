"""Shares of totals and changes between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtide.functions import growth_pct, ratio, round_to
from roomtide.operators.joins import salted_join


def concentration(counts: DataFrame) -> DataFrame:
    """Add each row's share of its period's applicants, relative to the mean share and in percent.

    The mean share is one over the number of rows, so `concentration` is n * rows / total. Totals
    are aggregated and joined back, salted: periods are few, and one may hold any number of residences.
    """
    totals = counts.groupBy("period").agg(
        F.sum("applicants").alias("period_applicants"), F.count("*").alias("period_rows")
    )
    n = F.col("applicants")
    return (
        salted_join(counts, totals, ["period"], "left")
        .withColumn("concentration", round_to(ratio(n * F.col("period_rows"), F.col("period_applicants")), 2))
        .withColumn("concentration_pct", round_to(ratio(n, F.col("period_applicants")) * 100.0, 2))
        .drop("period_applicants", "period_rows")
    )


def yearly_growth(yearly: DataFrame) -> DataFrame:
    """Add the change of applicants and offered places against the previous period present.

    `yearly` has one row per period, so the window over the whole table is a handful of rows.
    """
    in_time = Window.orderBy("period")
    return yearly.withColumn(
        "offered_growth_pct", growth_pct(F.col("offered"), F.lag("offered").over(in_time))
    ).withColumn("applicants_growth_pct", growth_pct(F.col("applicants"), F.lag("applicants").over(in_time)))
