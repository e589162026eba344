"""Joins on group keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(driver: DataFrame, others: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """Left-join each of `others` to the driver table on the group.

    The sides are aggregates. No broadcast is forced: adaptive execution sees their real size.
    """
    return reduce(lambda left, right: left.join(right, list(group), "left"), others, driver)


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a missing key matches a missing key."""
    renamed = right.select([F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    same = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"__{k}" for k in keys])


SALTS = 32


def salted_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join of many rows to a table of one row per key, of which one may have most of the rows.

    Rows are dealt over `salts` numbers by a hash of all their columns, and `small` is repeated for each, so no task gets
    a key alone even where neither side is broadcast. Equal rows share a number: fold those first. `how` is inner, left or
    left_semi; a missing key matches nothing.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def with_area(df: DataFrame, areas: DataFrame) -> DataFrame:
    """Add the area of each sector; rows of sectors without an area are left out.

    `areas` has `sector`, `area` and the frame of the area; a sector may belong to several areas.
    """
    return df.join(areas, "sector")


def in_frame(longitude: Column, latitude: Column) -> Column:
    """Whether a point lies within the frame of its area."""
    return longitude.between(F.col("xmin"), F.col("xmax")) & latitude.between(F.col("ymin"), F.col("ymax"))
