"""Every registered query: the Spark function and the SQL it is compared with."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles import sql
from roomtide.functions import (
    marker_size,
    number_text,
    percent,
    pressure_class,
    pressure_class_rank,
    round_from_all_digits,
    round_from_first_digits,
    safe_name,
)
from roomtide.operators import bands, demand, joins, places, reshape, selection, shares
from roomtide.reports import grants, maps, yearly
from roomtide.reports import pressure as pressures
from roomtide.schema import FILE_ORDER, NUMBER_COLUMNS, PERIOD, RESIDENCE, SECTOR, TEXT_COLUMNS
from roomtide.sources import trade_tables as trade
from roomtide.sources.applications import conform, read_applications

ORDER = trade.ORDER_COLS
KEYS = list(ORDER)
ROUND_COLUMNS = [f"offered_round_{k}" for k in trade.ROUNDS]
ONE_PERIOD = "1998"
# Letter case as typed by a user; comparison ignores it except where a report says otherwise.
SOME_SECTORS = ["nation_3", "Nation_8", "NATION_13", "nAtIoN_21"]
EXACT_SECTORS = ["NATION_3", "NATION_8", "NATION_13", "nation_21"]
EXACT_SQL = "sector IN ('NATION_3', 'NATION_8', 'NATION_13', 'nation_21')"


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


CATALOG: dict[str, Query] = {}


def register(name: str, body: str, areas: bool = False):
    """Register a function of the application table under `name`."""

    def add(build: Callable[[DataFrame], DataFrame]):
        CATALOG[name] = Query(
            lambda spark, folder: build(trade.applications(spark, folder)), sql.statement(body, areas)
        )
        return build

    return add


def register_with_areas(name: str, body: str):
    """Register a function of the application table and the area table under `name`."""

    def add(build: Callable[[DataFrame, DataFrame], DataFrame]):
        CATALOG[name] = Query(
            lambda spark, folder: build(trade.applications(spark, folder), trade.areas(spark, folder)),
            sql.statement(body, True),
        )
        return build

    return add


# --- sources and row filters ---

ALL_COLUMNS = [*TEXT_COLUMNS, "area", *NUMBER_COLUMNS, *ROUND_COLUMNS, *KEYS]
_all = ", ".join(ALL_COLUMNS)
_keys = ", ".join(KEYS)

register("scan_applications", f"SELECT {_all} FROM applications")(lambda a: a.select(*ALL_COLUMNS))


def _scratch(spark: SparkSession) -> str:
    """A new folder among those that all executors share; on this machine alone where that is where Spark runs."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="roomtide-files-")
    return f"{shared.rstrip('/')}/applications-{uuid.uuid4().hex}"


# One task sorts and writes a file, so a larger table takes more files, not longer ones.
ROWS_PER_FILE = 500_000
FEWEST_FILES = 5
# Spark numbers files with five digits; with more of them their names would no longer be in order.
MOST_FILES = 100_000


# A table of many files is written in slices of its first key, one after the other, so that the shuffles of one slice at a
# time take disk. Each slice reads the tables again, so there are few.
MOST_SLICES = 4


def _slices(items: DataFrame, number: int) -> list[Column]:
    """Conditions on the first key, in its order, that give every row to one slice, each about as many. Rows without that key,
    which have no order to join, are in none of several."""
    key = F.col(KEYS[0])
    cuts = [i / number for i in range(1, number)]
    found = items.agg(F.percentile_approx(key, cuts)).first()[0] if cuts else []
    edges = sorted(set(found or []))
    lower = [F.lit(True), *[key >= edge for edge in edges]]
    upper = [*[key < edge for edge in edges], F.lit(True)]
    return [low & high for low, high in zip(lower, upper)]


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Queries run in here remove their shuffle files at their end. Else they stay until the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _read_back(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    """The applications, written to several files in their order and read by the reader."""
    path = _scratch(spark)
    items = trade.line_items(spark, folder)
    # Without a mark for what is missing, CSV would not tell it from empty text.
    options = {"nullValue": "NA"} if fmt == "csv" else {}
    # Plain text takes many times the disk of the tables. A compressed file is not split, but its rows are bounded.
    packed = {} if fmt == "parquet" else {"compression": "gzip"}
    with _shuffles_removed(spark):
        # The files' footers have the number of line items; that of applications would take the joins once more.
        wanted = math.ceil(items.count() / ROWS_PER_FILE)
        for number, part in enumerate(_slices(items, min(max(wanted // FEWEST_FILES, 1), MOST_SLICES))):
            wanted = math.ceil(items.filter(part).count() / ROWS_PER_FILE)
            files = min(max(wanted, FEWEST_FILES), MOST_FILES)
            # Sorted before the columns of applications are made, which take twice the disk in a shuffle.
            a = trade.joined(spark, folder).filter(part).repartitionByRange(files, *KEYS).sortWithinPartitions(*KEYS)
            rows = trade.derived(a).select(*ALL_COLUMNS)
            rows.write.options(header=True, **options, **packed).format(fmt).save(f"{path}/slice={number}")
    read = conform(read_applications(spark, path, fmt, schema=rows.schema if fmt == "json" else None, **options))
    return read.withColumns({k: F.col(k).cast(kind) for k, kind in rows.dtypes if k in KEYS})


for _fmt in ("parquet", "csv", "json"):
    CATALOG[f"read_{_fmt}"] = Query(
        lambda spark, folder, f=_fmt: _read_back(spark, folder, f).select(*ALL_COLUMNS),
        sql.statement(f"SELECT {_all} FROM applications"),
    )
    # The first row of a residence, by the order of the files, is that by the keys that they were written in.
    CATALOG[f"read_{_fmt}_order"] = Query(
        lambda spark, folder, f=_fmt: places.capacity(_read_back(spark, folder, f), RESIDENCE, FILE_ORDER),
        sql.statement(sql.capacity(RESIDENCE)),
    )


@register("conform_applications", f"SELECT {_all} FROM applications")
def _conform(a):
    """All columns given as text, as from a CSV file, and coerced back."""
    untyped = a.select(
        *[F.col(c).cast("string").alias(c) for c in [*TEXT_COLUMNS, "area", *NUMBER_COLUMNS, *ROUND_COLUMNS]],
        *KEYS,
    )
    return conform(untyped).select(*ALL_COLUMNS)


@register(
    "conform_numeric_text",
    f"""SELECT {_keys}, period, CASE WHEN TRY_CAST(scale_band AS DOUBLE) IS NULL THEN NULL ELSE scale_band END AS scale_band
        FROM applications""",
)
def _conform_numbers(a):
    """Period and band given as numbers, as a spreadsheet reader returns them, and written out again."""
    numbers = {c: F.col(c).try_cast("double") for c in ("period", "scale_band")}
    return conform(a.withColumns(numbers)).select(*KEYS, "period", "scale_band")


_FILTERED = ["period", "sector", "residence", "scale_band", "capacity", *KEYS]
_filtered = f"SELECT {', '.join(_FILTERED)} FROM applications WHERE"

register("filter_required", f"{_filtered} residence IS NOT NULL AND capacity IS NOT NULL")(
    lambda a: selection.require(a, ["residence", "capacity"]).select(*_FILTERED)
)
register("filter_eligible", f"{_filtered} {sql.ELIGIBLE}")(
    lambda a: selection.eligible(a, trade.NOT_ELIGIBLE).select(*_FILTERED)
)
register("filter_sectors_ci", f"{_filtered} {sql.chosen(SOME_SECTORS)}")(
    lambda a: selection.in_sectors(a, SOME_SECTORS).select(*_FILTERED)
)
register("filter_sectors_cs", f"{_filtered} {EXACT_SQL}")(
    lambda a: selection.in_sectors(a, EXACT_SECTORS, case_sensitive=True).select(*_FILTERED)
)
register("filter_period", f"{_filtered} period = '{ONE_PERIOD}'")(
    lambda a: selection.in_period(a, int(ONE_PERIOD)).select(*_FILTERED)
)
register("filter_period_numeric", f"SELECT sector, residence, {_keys} FROM applications WHERE period = '{ONE_PERIOD}'")(
    lambda a: selection.in_period(a.withColumn("period", F.col("period").cast("double")), ONE_PERIOD).select(
        "sector", "residence", *KEYS
    )
)
register("list_periods", "SELECT DISTINCT period FROM applications WHERE period IS NOT NULL")(selection.periods)
register(
    "filter_newest_period", f"{_filtered} period = (SELECT max(period) FROM applications)"
)(lambda a: a.filter(F.col("period") == selection.newest_period(a)).select(*_FILTERED))
register("distinct_pairs", f"SELECT DISTINCT period, sector, applicant_id FROM applications")(
    lambda a: demand.distinct_pairs(a, ["period", "sector", "applicant_id"])
)

# --- scalar functions over all rows ---

register("round_all_digits", f"SELECT {_keys}, round_label, {sql.ALL_DIGITS} AS round FROM applications")(
    lambda a: a.select(*KEYS, "round_label", round_from_all_digits(F.col("round_label")).alias("round"))
)
register("round_first_digits", f"SELECT {_keys}, round_label, {sql.FIRST_DIGITS} AS round FROM applications")(
    lambda a: a.select(*KEYS, "round_label", round_from_first_digits(F.col("round_label")).alias("round"))
)
register(
    "safe_name",
    """SELECT DISTINCT residence, regexp_replace(strip_accents(residence), '[^a-zA-Z0-9]', '_', 'g') AS safe
       FROM applications""",
)(lambda a: a.select("residence").distinct().withColumn("safe", safe_name(F.col("residence"))))

_ACCENTS = ("Suplier0123", "ŠüpłîéŕàÇøñ")
register(
    "safe_name_accented",
    f"""SELECT DISTINCT residence, regexp_replace(
          replace(replace(strip_accents(translate(residence, '{_ACCENTS[0]}', '{_ACCENTS[1]}')), 'ł', 'l'), 'ø', 'o'),
          '[^a-zA-Z0-9]', '_', 'g') AS safe
        FROM applications""",
)(
    lambda a: a.select("residence")
    .distinct()
    .withColumn("safe", safe_name(F.translate("residence", *_ACCENTS)))
)
_VALUES = {
    "small": "l_extendedprice / 1e9::DOUBLE / (l_partkey + 1)",
    "long": "l_extendedprice / 7.0::DOUBLE",
    "large": "l_extendedprice * 1e11::DOUBLE * l_suppkey",
    "whole": "CAST(l_partkey * 100000 AS DOUBLE)",
}
register(
    "number_text",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{kind}' AS kind, x, {sql.number_text('x')} AS label FROM (SELECT {value} AS x FROM applications)"
        for kind, value in _VALUES.items()
    ),
)(
    lambda a: a.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), F.expr(value.replace("1e9::DOUBLE", "1e9D").replace("1e11::DOUBLE", "1e11D").replace("7.0::DOUBLE", "7D")).cast("double").alias("x"))
                    for kind, value in _VALUES.items()
                ]
            )
        )
    )
    .distinct()
    .withColumn("label", number_text(F.col("x")))
)

# --- applicant counts ---

for _level, _group in (("sector", SECTOR), ("residence", RESIDENCE), ("period", PERIOD)):
    register(f"applicants_{_level}", sql.applicants(_group))(
        lambda a, g=_group: demand.count_applicants(a, g)
    )
    register(f"last_round_{_level}", sql.last_round(_group))(
        lambda a, g=_group: demand.last_round_applicants(a, g)
    )
    register(f"eligible_last_round_{_level}", sql.last_round(_group, True))(
        lambda a, g=_group: demand.last_round_applicants(a, g, True, trade.NOT_ELIGIBLE)
    )
    register(f"capacity_{_level}", sql.capacity(_group))(lambda a, g=_group: places.capacity(a, g, ORDER))

_last_rows = sql.last_round_rows(SECTOR, sql.ALL_DIGITS, sql.present(sql.demand_needs(SECTOR)))
register("last_round_rows", f"SELECT period, sector, applicant_id, round, {_keys} FROM ({_last_rows})")(
    lambda a: demand.last_round_rows(a, SECTOR).select(*SECTOR, "applicant_id", "round", *KEYS)
)
register("applicants_period_pairs", sql.pairs_per_period())(demand.applicants_per_period)
register("wishes_per_applicant", sql.reportable(SECTOR))(lambda a: demand.wishes_per_applicant(a, SECTOR))
register(
    "sector_applicants_one_period", sql.sector_applicants(f"period = '{ONE_PERIOD}'")
)(lambda a: demand.sector_applicants(a, period=ONE_PERIOD))
register("concentration_sector", sql.concentrated(sql.applicants(SECTOR)))(
    lambda a: shares.concentration(demand.count_applicants(a, SECTOR))
)
register("concentration_residence", sql.concentrated(sql.applicants(RESIDENCE)))(
    lambda a: shares.concentration(demand.count_applicants(a, RESIDENCE))
)

# --- places ---

for _level, _group in (("sector", SECTOR), ("residence", RESIDENCE)):
    register(f"offered_{_level}", sql.offered(_group))(lambda a, g=_group: places.offered(a, g, ORDER))
    register(f"leftover_{_level}", sql.leftover(_group))(lambda a, g=_group: places.leftover(a, g))
    register(f"leftover_{_level}_strict", sql.leftover(_group, True))(
        lambda a, g=_group: places.leftover(a, g, strict=True)
    )
    register(f"renewals_{_level}", sql.renewals(_group))(lambda a, g=_group: places.renewals(a, g, ORDER))
    register(f"round_places_{_level}", sql.round_places(_group))(
        lambda a, g=_group: places.round_places(a, g)
    )
    register(f"balance_demand_{_level}", sql.balance_demand(_group))(
        lambda a, g=_group: demand.balance_demand(a, g)
    )

register("offered_period", sql.offered_period(SOME_SECTORS))(
    lambda a: places.offered_per_period(a, ORDER, SOME_SECTORS)
)
register("leftover_period_chart", sql.leftover_chart())(places.leftover_per_period)
register("leftover_period_table", sql.leftover_table())(
    lambda a: places.leftover_per_period(a, None, ("period", "residence"), True)
)
register("renewals_period", sql.RENEWALS_PERIOD)(places.renewals_per_period)
register("sector_coordinates", sql.COORDINATES)(places.sector_coordinates)
register("unpivot_rounds", f"SELECT {_keys}, round, places FROM ({sql.LONG_ROUNDS})")(
    lambda a: reshape.unpivot_rounds(a, KEYS)
)
register(
    "leftover_pct_sector",
    f"""SELECT period, sector, {sql.percent("leftover", "offered")} AS leftover_pct
        FROM ({sql.offered(SECTOR)}) LEFT JOIN ({sql.leftover(SECTOR)}) USING (period, sector)""",
)(
    lambda a: joins.star(places.offered(a, SECTOR, ORDER), [places.leftover(a, SECTOR)], SECTOR).select(
        *SECTOR, percent(F.col("leftover"), F.col("offered")).alias("leftover_pct")
    )
)
register("renewal_pct_sector", f"SELECT period, sector, renewal_pct FROM ({sql.renewal(SECTOR)})")(
    lambda a: pressures.renewal(a, SECTOR, ORDER).select(*SECTOR, "renewal_pct")
)

# --- joins ---

_star = ["applicants", "capacity_total", "offered", "applicants_last_round", "leftover", "eligible_last_round"]
register("join_star_sector", f"SELECT period, sector, {', '.join(_star)} FROM ({sql.joined(SECTOR)})")(
    lambda a: joins.star(
        demand.count_applicants(a, SECTOR),
        [
            places.capacity(a, SECTOR, ORDER),
            places.offered(a, SECTOR, ORDER),
            demand.last_round_applicants(a, SECTOR),
            places.leftover(a, SECTOR),
            demand.last_round_applicants(a, SECTOR, True, trade.NOT_ELIGIBLE),
        ],
        SECTOR,
    ).select(*SECTOR, *_star)
)
register(
    "join_null_safe_round",
    f"""SELECT p.period, p.sector, p.residence, p.round, p.places, t.places AS places_next_sum
        FROM ({sql.round_places(RESIDENCE)}) p
        LEFT JOIN ({sql.round_places(["sector", "residence"])}) t
          ON p.sector IS NOT DISTINCT FROM t.sector AND p.residence IS NOT DISTINCT FROM t.residence
            AND p.round IS NOT DISTINCT FROM t.round""",
)(
    # Residences without a name find each other.
    lambda a: joins.left_join_null_safe(
        places.round_places(a, RESIDENCE),
        places.round_places(a, ["sector", "residence"]).withColumnRenamed("places", "places_next_sum"),
        ["sector", "residence", "round"],
    )
)
register(
    "semi_reportable_groups",
    f"""SELECT * FROM ({sql.applicants(SECTOR)}) SEMI JOIN
        ({sql.reportable(SECTOR, SOME_SECTORS)}) USING (period, sector)""",
)(
    lambda a: demand.count_applicants(a, SECTOR).join(
        demand.reportable_groups(a, SECTOR, SOME_SECTORS), SECTOR, "left_semi"
    )
)
register_with_areas(
    "join_area_lookup",
    f"""SELECT areas.area, period, sector, applicants FROM ({sql.applicants(SECTOR)})
        JOIN areas USING (sector)""",
)(
    lambda a, areas: joins.with_area(demand.count_applicants(a, SECTOR), areas).select(
        "area", *SECTOR, "applicants"
    )
)
register_with_areas(
    "range_area_frame",
    f"""SELECT areas.area, period, sector, latitude, longitude,
          longitude >= xmin AND longitude <= xmax AND latitude >= ymin AND latitude <= ymax AS in_frame
        FROM ({sql.COORDINATES}) JOIN areas USING (sector)""",
)(
    lambda a, areas: joins.with_area(places.sector_coordinates(a), areas).select(
        "area",
        *SECTOR,
        "latitude",
        "longitude",
        joins.in_frame(F.col("longitude"), F.col("latitude")).alias("in_frame"),
    )
)

# --- bands ---

register("top_band_per_applicant", sql.top_band())(lambda a: bands.top_band_per_applicant(a, ORDER))
register("band_counts", sql.band_counts())(lambda a: bands.band_counts(a, ORDER))
register("complete_sector_band", sql.completed())(
    lambda a: reshape.complete(bands.band_counts(a, ORDER), PERIOD, "sector", "scale_band", "applicants")
)
register("band_pivot", sql.pivoted())(
    lambda a: reshape.pivot_bands(bands.band_counts(a, ORDER), SECTOR, "applicants", trade.BANDS)
)
register("band_table_with_total", sql.band_table())(
    lambda a: grants.band_table(a, ORDER, bands=trade.BANDS)
)
register("band_table_discovered", sql.band_table_discovered())(lambda a: grants.band_table(a, ORDER, bands=None))
_one = f"period = '{ONE_PERIOD}' AND {sql.chosen(SOME_SECTORS)}"
register("band_table", sql.band_table(_one))(
    lambda a: grants.band_table(a, ORDER, SOME_SECTORS, ONE_PERIOD, trade.BANDS)
)
register("band_distribution", sql.distribution())(
    lambda a: grants.band_distribution(a, ORDER, band_order=trade.BAND_ORDER)
)
register("band_distribution_selection", sql.distribution(f"period = '{ONE_PERIOD}' AND {EXACT_SQL}"))(
    lambda a: grants.band_distribution(a, ORDER, EXACT_SECTORS, ONE_PERIOD, trade.BAND_ORDER)
)

# --- reports ---


def _pressure(a: DataFrame, group: list[str], period=None, sectors=None) -> DataFrame:
    return pressures.pressure(a, group, ORDER, trade.NOT_ELIGIBLE, period, sectors)


for _level, _group in (("sector", SECTOR), ("residence", RESIDENCE)):
    register(f"pressure_{_level}", sql.pressure(_group))(lambda a, g=_group: _pressure(a, g))
    register(f"renewal_{_level}", sql.renewal(_group))(lambda a, g=_group: pressures.renewal(a, g, ORDER))
    register(f"balance_{_level}", sql.balance(_group))(lambda a, g=_group: pressures.balance(a, g))
    register(f"report_{_level}", sql.report(_group))(
        lambda a, g=_group: pressures.report(a, g, ORDER, excluded=trade.NOT_ELIGIBLE)
    )
    register(f"report_{_level}_selection", sql.report(_group, SOME_SECTORS, ONE_PERIOD))(
        lambda a, g=_group: pressures.report(a, g, ORDER, SOME_SECTORS, ONE_PERIOD, trade.NOT_ELIGIBLE)
    )

register(
    "pressure_class",
    f"""SELECT period, sector, residence, pressure_raw,
          {sql.pressure_class("pressure_raw")} AS raw_class, {sql.class_rank("pressure_raw")} AS raw_rank,
          {sql.marker("pressure_raw")} AS raw_size, pressure_adjusted,
          {sql.pressure_class("pressure_adjusted")} AS adjusted_class,
          {sql.class_rank("pressure_adjusted")} AS adjusted_rank,
          {sql.marker("pressure_adjusted")} AS adjusted_size
        FROM ({sql.pressure(RESIDENCE)})""",
)(
    lambda a: _pressure(a, RESIDENCE).select(
        *RESIDENCE,
        *[
            column
            for kind in ("raw", "adjusted")
            for column in (
                F.col(f"pressure_{kind}"),
                pressure_class(F.col(f"pressure_{kind}")).alias(f"{kind}_class"),
                pressure_class_rank(F.col(f"pressure_{kind}")).alias(f"{kind}_rank"),
                marker_size(F.col(f"pressure_{kind}")).alias(f"{kind}_size"),
            )
        ],
    )
)
register("map_raw", sql.map_points("pressure_raw"))(lambda a: maps.map_points(_pressure(a, SECTOR)))
register("map_adjusted", sql.map_points("pressure_adjusted", SOME_SECTORS))(
    lambda a: maps.map_points(_pressure(a, SECTOR, sectors=SOME_SECTORS), "réajustée", SOME_SECTORS)
)
register_with_areas("area_map_points", sql.area_points())(
    lambda a, areas: maps.area_map_points(_pressure(a, SECTOR), areas)
)
register("top_residences", sql.top_residences(ONE_PERIOD))(
    lambda a: maps.top_residences(_pressure(a, RESIDENCE, ONE_PERIOD), ONE_PERIOD)
)


def _overview(a: DataFrame, sectors=None) -> DataFrame:
    return yearly.yearly_overview(a, ORDER, sectors, trade.NOT_ELIGIBLE)


register("yearly_overview", sql.overview())(_overview)
register("yearly_overview_selection", sql.overview(SOME_SECTORS))(lambda a: _overview(a, SOME_SECTORS))
register("yearly_table", sql.yearly_table())(
    lambda a: yearly.yearly_table(a, ORDER, excluded=trade.NOT_ELIGIBLE)
)
register("yearly_table_selection", sql.yearly_table(SOME_SECTORS))(
    lambda a: yearly.yearly_table(a, ORDER, SOME_SECTORS, trade.NOT_ELIGIBLE)
)
register(
    "yearly_growth",
    f"SELECT period, offered, applicants, offered_growth_pct, applicants_growth_pct FROM ({sql.yearly_table()})",
)(
    lambda a: shares.yearly_growth(
        joins.star(places.offered_per_period(a, ORDER), [demand.applicants_per_period(a)], PERIOD)
    )
)
register("yearly_long", sql.YEARLY_LONG)(lambda a: yearly.yearly_long(_overview(a)))
register("yearly_dual_axis", sql.DUAL_AXIS)(lambda a: yearly.yearly_dual_axis(_overview(a)))
