"""Application rows derived from order-and-supply tables, for checks and timings.

A line item is an application, its customer the applicant, its supplier the residence, the supplier's
nation the sector and region the area. Remainders spread missing values, bands and rounds over the
rows; no row is left out. All measures are whole numbers or binary fractions, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtide import schema

ROUNDS = (1, 2, 3, 4)

# Unique per line item at every scale; the first two alone are not.
ORDER_COLS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

# The bands of the domain, spelled without accents here.
NOT_ELIGIBLE, BANDS, BAND_ORDER = (
    tuple(band.replace("è", "e") for band in bands) for bands in (schema.NOT_ELIGIBLE, schema.BANDS, schema.BAND_ORDER)
)

# The columns used; declared, so that reading starts no job to look at the files.
_SCHEMAS = {
    "lineitem": """l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint,
        l_quantity double, l_extendedprice double""",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _unless_multiple(part: int, value: Column) -> Column:
    """`value`, missing where the part key is a multiple of `part`."""
    return F.when(F.col("l_partkey") % part != 0, value)


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem")


def joined(spark: SparkSession, folder: str) -> DataFrame:
    """The line items with what applications take from the other tables, and nothing else: fewer bytes than applications."""
    rows = (
        line_items(spark, folder)
        .join(
            _table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year")),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(_table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select(*ORDER_COLS, "o_custkey", "o_year", "s_name", "s_nationkey", "n_name", "r_name")


def applications(spark: SparkSession, folder: str) -> DataFrame:
    """One application per line item."""
    return derived(joined(spark, folder))


def derived(rows: DataFrame) -> DataFrame:
    """The applications of joined line items, in the order of these."""
    year = F.col("o_year")
    line, supplier, nation = F.col("l_linenumber"), F.col("l_suppkey"), F.col("s_nationkey")
    label = (
        F.when(line == 7, F.lit(None))
        .when(line == 6, "Phase complementaire")
        .when((line >= 4) & (nation % 3 == 0), "Tour 3")
        .when(line >= 4, "Tour 4")
        .otherwise(F.concat(F.lit("Tour "), line.cast("string")))
    )
    step = (F.col("o_custkey") + F.col("l_suppkey")) % 11
    band = (
        F.when((nation % 7 == 2) & line.isin(4, 5), "Hors Bareme")
        .when(step == 0, "0 Bis")
        .when(step == 8, "Hors Bareme")
        .when(step == 9, "")
        .when(step == 10, F.lit(None))
        .otherwise(step.cast("string"))
    )
    per_place = (
        F.when(nation % 5 == 0, 0.5)
        .when(nation % 5 == 1, 2.0)
        .when(nation % 5 == 2, 5.0)
        .when(nation % 5 == 3, 8.0)
        .otherwise(1.0)
    )
    places = (
        F.when(F.col("l_partkey") % 41 == 0, F.lit(None))
        .when((nation == 13) | (supplier % 23 == 7), 0.0)
        .otherwise(F.floor((24 + (supplier * 13 + year * 7) % 60) / per_place).cast("double"))
    )

    def round_places(k: int) -> Column:
        value = F.when(line == k, ((supplier * 7 + 5 * k + year) % 30).cast("double")).otherwise(0.0)
        return _unless_multiple(29, value) if k == 4 else value

    return rows.select(
        year.cast("string").alias("period"),
        F.col("n_name").alias("sector"),
        F.col("r_name").alias("area"),
        _unless_multiple(97, F.col("s_name")).alias("residence"),
        _unless_multiple(
            89, F.concat(F.lit("ID"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
        ).alias("applicant_id"),
        label.alias("round_label"),
        band.alias("scale_band"),
        _unless_multiple(47, (100 + (supplier * 37) % 400).cast("double")).alias("capacity"),
        places.alias("offered_total"),
        F.when(supplier % 10 != 3, ((supplier * 5 + year) % 15).cast("double")).alias("leftover"),
        _unless_multiple(31, ((supplier * 3 + year) % 40).cast("double")).alias("renewals_confirmed"),
        *[round_places(k).alias(f"offered_round_{k}") for k in ROUNDS],
        _unless_multiple(19, 50 + nation / 32).alias("latitude"),
        _unless_multiple(19, 2 + nation / 16).alias("longitude"),
        *ORDER_COLS,
    )


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as areas, each with the frame of a strip of the map."""
    regions = _table(spark, folder, "region")
    nations = _table(spark, folder, "nation")
    key = F.col("r_regionkey")
    return nations.join(regions, F.col("n_regionkey") == key).select(
        F.col("r_name").alias("area"),
        F.col("n_name").alias("sector"),
        (2 + key / 8).alias("xmin"),
        (3 + key / 8).alias("xmax"),
        (50 + key / 16).alias("ymin"),
        (50.5 + key / 16).alias("ymax"),
    )
