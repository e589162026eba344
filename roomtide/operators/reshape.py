"""Long and wide forms of tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide.functions import safe_name
from roomtide.schema import ROUND_PREFIX


def round_columns(df: DataFrame, prefix: str = ROUND_PREFIX) -> dict[int, list[str]]:
    """Round number -> its columns. The prefix is matched in any letter case."""
    found: dict[int, list[str]] = {}
    for name in df.columns:
        digits = re.search("[0-9]+", name[len(prefix) :])
        if name.lower().startswith(prefix.lower()) and digits:
            found.setdefault(int(digits.group()), []).append(name)
    return dict(sorted(found.items()))


def unpivot_rounds(df: DataFrame, ids: Sequence[str], prefix: str = ROUND_PREFIX) -> DataFrame:
    """One row per input row and round column: the ids, `round` and `places` (null kept)."""
    pairs = [
        part
        for k, names in round_columns(df, prefix).items()
        for name in names
        for part in (F.lit(float(k)), F.col(f"`{name}`"))
    ]
    return df.select(*ids, F.stack(F.lit(len(pairs) // 2), *pairs).alias("round", "places"))


def complete(
    counts: DataFrame, group: Sequence[str], key: str, other: str, count: str
) -> DataFrame:
    """Add the missing pairs of `key` and `other` within each `group` with a count of 0.

    The pairs are the result, so there are as many as keys times categories of a group.
    """
    keys = counts.select(*group, key).distinct()
    others = counts.select(*group, other).distinct()
    pairs = keys.join(others, list(group))
    filled = pairs.join(counts, [*group, key, other], "left")
    return filled.fillna(0, [count]).select(*group, key, other, count)


def band_column(band: str) -> str:
    """Column name for a band: "0 Bis" is band_0_bis, the empty band is band_blank."""
    plain = re.sub("[^a-z0-9]+", "_", band.lower().replace("è", "e").replace("é", "e"))
    return f"band_{plain or 'blank'}"


def band_columns(bands: Sequence[str]) -> dict[str, str]:
    """Band -> its column name, unique: a name that is taken gets a number."""
    names: dict[str, str] = {}
    for band in bands:
        plain, k = band_column(band), 1
        name = plain
        while name in names.values():
            k += 1
            name = f"{plain}_{k}"
        names[band] = name
    return names


#: Bands that become columns at most, if their names are looked up.
MOST_BANDS = 200


def present_bands(counts: DataFrame) -> list[str]:
    """The bands of a count table, sorted. Runs its plan. More than MOST_BANDS are an error, found before the driver gets
    more than one name beyond them: so many columns are no table to read, and a fixed list of bands has one for the rest."""
    found = counts.select("scale_band").filter("scale_band IS NOT NULL").distinct().limit(MOST_BANDS + 1).collect()
    if len(found) > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands; give the list of bands that become columns")
    return sorted((r[0] for r in found), key=lambda band: band.encode())


def band_sums(bands: Sequence[str] | None, counts: DataFrame, count: str) -> dict[str, Column]:
    """Column name -> aggregate that sums `count` over the rows of its band.

    With `bands` the columns are fixed, a band counts in any letter case, and every other band is
    summed in `band_other`. With None the bands present are looked up first, each as it is spelled.
    """
    amount, band = F.col(count), F.col("scale_band")
    if bands is None:
        conditions = {name: band == b for b, name in band_columns(present_bands(counts)).items()}
    else:
        folded = F.lower(band)
        conditions = {name: folded == b.lower() for b, name in band_columns(bands).items()}
        conditions["band_other"] = ~folded.isin([b.lower() for b in bands])
    return {name: F.coalesce(F.sum(F.when(c, amount)), F.lit(0)) for name, c in conditions.items()}


def pivot_bands(
    counts: DataFrame, group: Sequence[str], count: str, bands: Sequence[str] | None = None
) -> DataFrame:
    """One count column per band, 0 where a band is missing; see `band_sums` for the columns."""
    return counts.groupBy(*group).agg(*[c.alias(n) for n, c in band_sums(bands, counts, count).items()])


def add_safe_area(df: DataFrame) -> DataFrame:
    """The area name in a form usable in file paths, as `area_safe`."""
    return df.withColumn("area_safe", safe_name(F.col("area")))
