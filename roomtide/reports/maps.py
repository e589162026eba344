"""Point tables for maps and the residence chart. All start from the result of `pressure`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.functions import (
    map_label,
    marker_size,
    missing_if_nan,
    pressure_class,
    pressure_class_rank,
    residence_tooltip,
    shifted_latitude,
    shifted_longitude,
)
from roomtide.operators.joins import in_frame, with_area
from roomtide.operators.selection import in_period, in_sectors
from roomtide.schema import ADJUSTED_KIND, RAW_KIND


def map_points(
    sector_pressure: DataFrame,
    kind: str = RAW_KIND,
    sectors: Sequence[str] | None = None,
    period: str | None = None,
) -> DataFrame:
    """One point per sector with its pressure, class and label.

    `kind` "Brute" shows the raw pressure, anything else the adjusted one.
    """
    value = F.col("pressure_raw" if kind == RAW_KIND else "pressure_adjusted")
    rows = in_period(in_sectors(sector_pressure, sectors), period)
    return rows.select(
        "period",
        "sector",
        "latitude",
        "longitude",
        value.alias("value"),
        pressure_class(value).alias("pressure_class"),
        pressure_class_rank(value).alias("class_rank"),
        map_label(F.col("sector"), value).alias("label"),
    )


def area_map_points(sector_pressure: DataFrame, areas: DataFrame, period: str | None = None) -> DataFrame:
    """Two points per sector of each area: raw pressure at its place, adjusted pressure beside it.

    The second point is moved by the sizes of both markers, and has no place if either pressure has no
    class. `in_frame` says whether a point falls within the view of its area.
    """
    raw, adjusted = F.col("pressure_raw"), F.col("pressure_adjusted")
    latitude, longitude = F.col("latitude"), F.col("longitude")
    sizes = marker_size(raw), marker_size(adjusted)

    def point(kind, value, lat, lon):
        return F.struct(
            F.lit(kind).alias("kind"),
            value.alias("value"),
            pressure_class(value).alias("pressure_class"),
            pressure_class_rank(value).alias("class_rank"),
            marker_size(value).alias("size"),
            lat.alias("latitude"),
            lon.alias("longitude"),
            map_label(F.col("sector"), value, kind).alias("label"),
        )

    both = F.array(
        point(RAW_KIND, raw, latitude, longitude),
        point(
            ADJUSTED_KIND,
            adjusted,
            shifted_latitude(latitude, *sizes),
            shifted_longitude(longitude, latitude, *sizes),
        ),
    )
    rows = with_area(in_period(sector_pressure, period), areas)
    frame = ["xmin", "xmax", "ymin", "ymax"]
    points = rows.select("area", "period", "sector", *frame, F.inline(both))
    return points.withColumn("in_frame", in_frame(F.col("longitude"), F.col("latitude"))).drop(*frame)


def top_residences(
    residence_pressure: DataFrame,
    period: str,
    sectors: Sequence[str] | None = None,
    n: int = 10,
) -> DataFrame:
    """The `n` residences of the selection under the highest raw pressure, highest first.

    Ties go by sector and residence. Infinite pressure comes first, missing pressure last.
    """
    rows = in_period(in_sectors(residence_pressure, sectors), period)
    highest = missing_if_nan(F.col("pressure_raw")).desc_nulls_last()
    top = rows.orderBy(highest, "period", "sector", "residence").limit(n)
    columns = ["period", "residence", "offered", "applicants", "pressure_raw"]
    tooltip = residence_tooltip(*[F.col(c) for c in columns])
    return top.select(
        "period", "sector", "residence", "applicants", "offered", "pressure_raw", tooltip.alias("tooltip")
    )
