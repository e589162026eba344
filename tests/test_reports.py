import pytest
from pyspark.sql import functions as F

from roomtide.reports import grants, maps, pressure, yearly
from roomtide.schema import RESIDENCE, SECTOR
from roomtide.sources.areas import default_areas

ORDER = ["id"]
INF = float("inf")
A25, B25, A24 = ("2025", "A"), ("2025", "B"), ("2024", "A")


def test_pressure_sector(micro, rows):
    got = rows(pressure.pressure(micro, SECTOR, ORDER), 2)
    # applicants, capacity, offered, last round, leftover, eligible, lat, lon, raw, adjusted, conc., conc. %
    assert got == {
        A25: (4, 140, 15, 3, 4, 2, 50.5, 3.0, 0.27, 0.87, 1.33, 66.67),
        B25: (2, 80, 0, 1, 2, 1, 50.25, 2.0, INF, -INF, 0.67, 33.33),
        A24: (1, 90, 8, 1, 1, None, 50.5, 3.0, 0.12, None, 1.0, 100.0),
    }


def test_pressure_residence(micro, rows):
    got = rows(pressure.pressure(micro, RESIDENCE, ORDER).select(*RESIDENCE, "applicants", "applicants_last_round", "eligible_last_round"), 3)
    assert got == {
        ("2025", "A", "R1"): (2, 1, 1),
        ("2025", "A", "R2"): (2, 1, None),
        ("2025", "B", "R3"): (2, 1, 1),
        ("2024", "A", "R1"): (1, 1, None),
    }


def test_renewal(micro, rows):
    assert rows(pressure.renewal(micro, SECTOR, ORDER), 2) == {
        A25: (50, 140, 35.71),
        B25: (30, 80, 37.5),
        A24: (45, 90, 50),
    }


def test_balance(micro, rows):
    assert rows(pressure.balance(micro, SECTOR), 2) == {A25: (3, -4), B25: (1, 1), A24: (1, -3)}
    by_residence = rows(pressure.balance(micro, RESIDENCE), 3)
    assert by_residence == {
        ("2025", "A", "R1"): (1, -4),
        ("2025", "A", "R2"): (1, -1),
        ("2025", "B", "R3"): (1, 1),
        ("2024", "A", "R1"): (1, -3),
    }


def test_balance_keeps_missing_sector_and_first_digits(make, rows):
    df = make(
        [
            (1, "2025", None, "R1", "S1", "Tour 1 - phase 2", "3", 1, 1, 1, 1, 5, 9),
            (2, "2025", None, "R1", "S2", "Tour 1", "3", 1, 1, 1, 1, 4, 9),
            (3, "2025", "A", "R1", "S2", "Tour 3", "3", 1, 1, 1, 1, 4, 9),
        ]
    )
    got = rows(pressure.balance(df, SECTOR), 2)
    # No column for round 3: nothing to subtract.
    assert got == {("2025", None): (2, -3), A25: (1, None)}


def test_report(micro, rows):
    got = rows(pressure.report(micro, SECTOR, ORDER), 2)
    # capacity, offered, leftover, leftover %, applicants, last, unplaced, conc. %, raw, adjusted, renewals, %
    assert got == {
        A25: (140, 15, 4, 26.67, 4, 3, -4, 66.67, 0.27, 0.87, 50, 35.71),
        B25: (80, 0, 2, INF, 2, 1, 1, 33.33, INF, -INF, 30, 37.5),
        A24: (90, 8, 1, 12.5, 1, 1, -3, 100, 0.12, None, 45, 50),
    }


def test_report_selection_keeps_shares_of_the_whole_period(micro, rows):
    whole = rows(pressure.report(micro, SECTOR, ORDER), 2)
    assert rows(pressure.report(micro, SECTOR, ORDER, ["b"], 2025), 2) == {B25: whole[B25]}
    assert rows(pressure.report(micro, SECTOR, ORDER, [])) == set()
    chosen = rows(pressure.pressure(micro, SECTOR, ORDER, sectors=["b"]), 2)
    assert chosen == {B25: rows(pressure.pressure(micro, SECTOR, ORDER), 2)[B25]}


def test_report_needs_offered_places(make, rows):
    df = make(
        [
            (1, "2025", "A", "R1", "S1", "Tour 1", "3", 1, 1, 1, 1, 1, 1),
            (2, "2025", "B", "R2", "S1", "Tour 1", "3", 1, None, 1, 1, 1, 1),
            (3, "2025", "B", "R2", None, "Tour 1", "3", 1, 1, 1, 1, 1, 1),
        ]
    )
    assert set(rows(pressure.report(df, SECTOR, ORDER), 2)) == {A25}
    assert set(rows(pressure.pressure(df, SECTOR, ORDER), 2)) == {A25, B25}


@pytest.mark.parametrize("group", [SECTOR, RESIDENCE])
def test_report_is_made_of_the_single_reports(micro, rows, group):
    """Renewals, balance and pressure computed alone agree with the shared passes."""
    n = len(group)
    table = pressure.report(micro, group, ORDER)
    renewal = rows(pressure.renewal(micro, group, ORDER).select(*group, "renewals_confirmed", "renewal_pct"), n)
    balance = rows(pressure.balance(micro, group).select(*group, "unplaced_last_round"), n)
    for key, row in rows(table.select(*group, "renewals_confirmed", "renewal_pct", "unplaced_last_round"), n).items():
        assert row == (*renewal.get(key, (None, None)), *balance.get(key, (None,)))


def test_yearly_table(micro, rows):
    got = rows(yearly.yearly_table(micro, ORDER), 1)
    # capacity, offered, leftover, %, applicants, last, raw, adjusted, offered growth, demand growth, renewals, %
    assert got == {
        ("2024",): (90, 8, 1, 12.5, 1, 1, 0.12, None, None, None, 45, 50),
        ("2025",): (220, 15, 10, 66.67, 6, 3, 0.4, 0.47, 87.5, 500, 100, 45.45),
    }


def test_yearly_selection_scope(micro, rows):
    """Only offered places, applicants and leftover follow the selection unless asked otherwise."""
    names = ["capacity_total", "offered", "leftover", "applicants", "applicants_last_round", "renewals_confirmed"]
    got = rows(yearly.yearly_table(micro, ORDER, ["a"]).select("period", *names), 1)
    assert got[("2025",)] == (220, 15, 8, 4, 3, 100)
    everywhere = yearly.yearly_table(micro, ORDER, ["a"], select_everywhere=True)
    assert rows(everywhere.select("period", *names), 1)[("2025",)] == (140, 15, 8, 4, 3, 70)


def test_yearly_drops_periods_without_offered_places(make, rows):
    df = make(
        [
            (1, "2024", "A", "R1", "S1", "Tour 1", "3", 1, None, 1, 1, 1, 1),
            (2, "2025", "A", "R1", "S1", "Tour 1", "3", 1, 2, 1, 1, 1, 1),
            (3, "2025", "B", "R1", "S1", "Tour 1", "3", 1, 2, 1, 1, 1, 1),
        ]
    )
    assert set(rows(yearly.yearly_overview(df, ORDER), 1)) == {("2025",)}
    assert rows(yearly.yearly_overview(df, ORDER, ["c"])) == set()


def test_last_round_of_the_whole_period(make, rows):
    """A sector with fewer rounds adds nothing to the period's last round."""
    df = make(
        [
            (1, "2025", "A", "R1", "S1", "Tour 2", "3", 1, 1, 1, 1, 1, 1),
            (2, "2025", "B", "R2", "S2", "Tour 1", "3", 1, 1, 1, 1, 1, 1),
            (3, "2025", "B", "R2", "S3", "Tour 1", "3", 1, 1, 1, 1, 1, 1),
        ]
    )
    assert rows(yearly.yearly_demand(df), 1) == {("2025",): (3, 1, 1)}


def test_yearly_long_and_dual_axis(micro, rows):
    overview = yearly.yearly_overview(micro, ORDER)
    assert [r.period for r in overview.collect()] == ["2024", "2025"]
    long = rows(yearly.yearly_long(overview), 2)
    assert long[("2025", "applicants")] == (6,) and long[("2024", "offered")] == (8,) and len(long) == 8
    axis = rows(yearly.yearly_dual_axis(overview), 1)
    assert axis[("2024",)] == (pytest.approx(0.12 * 15 / 0.47), None, 15, 0.47)
    assert axis[("2025",)] == (pytest.approx(0.4 * 15 / 0.47), 15, 15, 0.47)


def test_band_table(micro, rows):
    table = grants.band_table(micro, ORDER, period="2025", bands=["0 Bis", "2", "5", "7"])
    assert [c for c in table.columns] == ["period", "sector", "band_0_bis", "band_2", "band_5", "band_7", "band_other", "non_grant", "total"]
    assert [tuple(r) for r in table.collect()] == [
        ("2025", "A", 1, 0, 1, 0, 0, 2, 4),
        ("2025", "B", 0, 1, 0, 1, 0, 0, 2),
        ("2025", "Total", 1, 1, 1, 1, 0, 2, 6),
    ]
    found = grants.band_table(micro, ORDER, period="2025", bands=None)
    assert found.columns[2:-2] == ["band_0_bis", "band_2", "band_5", "band_7"]
    # Other bands are not lost from the sums.
    few = grants.band_table(micro, ORDER, period="2025", bands=["2"])
    assert rows(few, 2)[("2025", "Total")] == (1, 3, 2, 6)


def test_band_table_leaves_out_sectors_without_bands(make, rows):
    df = make(
        [
            (1, "2025", "A", "R1", "S1", "Tour 1", "3", 1, 1, 1, 1, 1, 1),
            (2, "2025", "B", "R1", "S2", "Tour 1", None, 1, 1, 1, 1, 1, 1),
        ]
    )
    assert {r.sector for r in grants.band_table(df, ORDER).collect()} == {"A", "Total"}


def test_band_distribution(micro):
    got = [tuple(r) for r in grants.band_distribution(micro, ORDER, period="2025").collect()]
    assert got == [
        ("2025", "0 Bis", 1, 16.7, 6),
        ("2025", "2", 1, 16.7, 6),
        ("2025", "5", 1, 16.7, 6),
        ("2025", "7", 1, 16.7, 6),
        ("2025", "Non-boursiers", 2, 33.3, 6),
    ]
    # Sectors are compared exactly here, unlike in the table.
    assert grants.band_distribution(micro, ORDER, ["b"], "2025").collect() == []
    assert len(grants.band_table(micro, ORDER, ["b"], "2025").collect()) == 2


def test_map_points(micro, rows):
    points = pressure.pressure(micro, SECTOR, ORDER)
    raw = rows(maps.map_points(points, sectors=["a"], period="2025"))
    assert raw == {("2025", "A", 50.5, 3.0, 0.27, "≤1", 5, "A\n0.27")}
    adjusted = rows(maps.map_points(points, "other", period="2025"), 2)
    assert adjusted[B25] == (50.25, 2.0, -INF, "≤1", 5, "B\n-Inf")


def test_area_map_points(micro, spark, rows):
    areas = spark.createDataFrame(
        [("West", "A", 2.0, 3.001, 50.0, 51.0), ("East", "B", 0.0, 1.0, 50.0, 51.0)],
        "area string, sector string, xmin double, xmax double, ymin double, ymax double",
    )
    points = pressure.pressure(micro, SECTOR, ORDER)
    got = {(r.sector, r.kind): r for r in maps.area_map_points(points, areas, "2025").collect()}
    assert set(got) == {("A", "Brute"), ("A", "Réajustée"), ("B", "Brute"), ("B", "Réajustée")}
    first, second = got[("A", "Brute")], got[("A", "Réajustée")]
    assert (first.longitude, first.in_frame, first.label) == (3.0, True, "A\nBrute\n0.27")
    assert second.latitude == pytest.approx(50.5 - 0.004) and second.in_frame is False
    # No class for infinite pressure: no size, and no place for the second marker.
    assert got[("B", "Brute")]["size"] is None and got[("B", "Brute")].in_frame is False
    assert got[("B", "Réajustée")].longitude is None and got[("B", "Réajustée")].in_frame is None


def test_default_areas(spark):
    areas = default_areas(spark)
    assert areas.count() == 13 and areas.select("area").distinct().count() == 4


def test_top_residences(micro):
    points = pressure.pressure(micro, RESIDENCE, ORDER)
    got = [r.residence for r in maps.top_residences(points, "2025").collect()]
    assert got == ["R3", "R2", "R1"]
    assert [r.residence for r in maps.top_residences(points, "2025", ["a"], n=1).collect()] == ["R2"]


def test_properties(micro, rows):
    table = pressure.pressure(micro, SECTOR, ORDER)
    for total in table.groupBy("period").agg(F.sum("concentration_pct")).collect():
        assert total[1] == pytest.approx(100, abs=0.05)
    assert table.filter("applicants < applicants_last_round").count() == 0


def test_result_does_not_depend_on_partitions(micro, rows):
    wanted = rows(pressure.report(micro, SECTOR, ORDER)), rows(grants.band_table(micro, ORDER))
    for parts in (1, 7):
        shuffled = micro.repartition(parts, F.rand(parts))
        assert rows(pressure.report(shuffled, SECTOR, ORDER)) == wanted[0]
        assert rows(grants.band_table(shuffled, ORDER)) == wanted[1]


ONE_NUMBER = [
    "capacity_sector", "offered_residence", "renewals_sector", "report_sector", "report_residence_selection",
    "pressure_residence", "yearly_overview", "yearly_table", "top_band_per_applicant", "band_table", "band_distribution",
]


@pytest.mark.parametrize("name", ONE_NUMBER)
def test_one_number_as_order_gives_the_same(spark, monkeypatch, name):
    """The order that files have, a single number, against the order of six columns."""
    from pyspark.sql import Window

    from oracles import catalog
    from roomtide.schema import RowOrder
    from roomtide.sources import trade_tables as trade

    folder = "/root/testdata/sf0.001"
    want = catalog.CATALOG[name].run(spark, folder).collect()
    plain = trade.applications
    number = F.row_number().over(Window.orderBy(*trade.ORDER_COLS))

    def numbered(spark, folder):
        rows = plain(spark, folder).withColumn("position", number.cast("long"))
        return rows.withColumns({"file": F.lit("f"), "block": F.floor(F.col("position") / 500), "row": F.col("position") % 500})

    monkeypatch.setattr(trade, "applications", numbered)
    for order in (["position"], RowOrder(("file", "block", "row"), unit=2)):
        monkeypatch.setattr(catalog, "ORDER", order)
        assert sorted(map(repr, catalog.CATALOG[name].run(spark, folder).collect())) == sorted(map(repr, want))
