import json
import re

import pytest
from pyspark.sql import functions as F

from roomtide.operators.places import capacity
from roomtide.reports import maps, pressure
from roomtide.schema import FILE_ORDER, SECTOR, SPREADSHEET_HEADERS
from roomtide.sources.applications import conform, read_applications
from roomtide.sources.features import bind_layers, read_features
from roomtide.sources.sinks import write_area_maps, write_report


def spreadsheet(micro):
    """The micro table under its spreadsheet headers."""
    names = {new: old for old, new in SPREADSHEET_HEADERS.items() if old != "Renouvellements confirmés"}
    names |= {"offered_round_1": "Places Tour 1", "offered_round_2": "places tour 2"}
    return micro.orderBy("id").withColumnsRenamed(names)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_round_trip(spark, micro, tmp_path, rows, fmt):
    path = str(tmp_path / fmt)
    writer = spreadsheet(micro).coalesce(1).write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    schema = spreadsheet(micro).schema if fmt == "json" else None
    df = conform(read_applications(spark, path, fmt, schema=schema))
    assert dict(df.dtypes)["offered_round_2"] == "double"
    got = rows(pressure.report(df, SECTOR, FILE_ORDER))
    assert got == rows(pressure.report(micro, SECTOR, ["id"]))


def test_file_order_is_the_row_order(spark, tmp_path, rows):
    """The first row of a residence is the first in the file, whatever the split."""
    path = str(tmp_path / "rows")
    data = [(i, "2025", "A", "R", float(1000 - i)) for i in range(5000)]
    df = spark.createDataFrame(data, "i int, period string, sector string, residence string, capacity double")
    df.coalesce(1).write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = read_applications(spark, path, "csv")
        assert read.rdd.getNumPartitions() > 1
        read = read.withColumn("capacity", F.col("capacity").cast("double"))
        assert rows(capacity(read, SECTOR, FILE_ORDER)) == {("2025", "A", 1000.0)}
        assert rows(capacity(read, SECTOR, FILE_ORDER.columns)) == {("2025", "A", 1000.0)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_conform(spark, micro):
    with pytest.raises(ValueError, match="scale_band"):
        conform(micro.drop("scale_band"))
    as_text = micro.select([F.col(c).cast("string").alias(c) for c in micro.columns])
    back = conform(as_text).drop("id")
    assert back.dtypes == micro.drop("id").dtypes
    assert back.exceptAll(micro.drop("id")).count() == 0
    odd = as_text.limit(1).withColumns({"capacity": F.lit("many"), "scale_band": F.lit("")})
    assert conform(odd).select("capacity", "scale_band").first() == (None, "")
    assert conform(odd, blank_is_missing=True).first().scale_band is None
    not_a_number = micro.limit(1).withColumn("capacity", F.lit(float("nan")))
    assert conform(not_a_number).first().capacity is None


def feature(code, name, kind, coordinates):
    return {
        "type": "Feature",
        "properties": {"code": code, "nom": name},
        "geometry": {"type": kind, "coordinates": coordinates},
    }


def test_features(spark, tmp_path, rows):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    first = feature("1", "Un", "Polygon", square)
    second = feature("2", "Deux", "MultiPolygon", [square, square])
    paths = []
    for item in (first, second):
        path = tmp_path / f"{item['properties']['code']}.json"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": [item]}, indent=1))
        paths.append(str(path))
    lines = tmp_path / "lines.json"
    lines.write_text(json.dumps(first) + "\n" + json.dumps(second) + "\n")
    got = rows(read_features(spark, paths), 1)
    assert got[("1",)][:2] == ("Un", "Polygon") and json.loads(got[("1",)][2]) == square
    assert json.loads(got[("2",)][2]) == [square, square]
    assert rows(read_features(spark, str(lines), one_per_line=True), 1) == got
    layers = bind_layers(read_features(spark, paths[0]), read_features(spark, paths[1]))
    assert rows(layers, 1) == got


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_report(spark, micro, tmp_path, fmt):
    table = pressure.report(micro, SECTOR, ["id"])
    path = tmp_path / fmt
    write_report(table, str(path), fmt)
    assert {p.name for p in path.iterdir() if p.is_dir()} == {"period=2024", "period=2025"}
    back = spark.read.format(fmt).option("header", True).load(str(path))
    assert back.count() == 3 and set(back.columns) == set(table.columns)


def test_write_area_maps(spark, micro, tmp_path):
    areas = spark.createDataFrame(
        [("Lens-Liévin", "A", 2.0, 4.0, 50.0, 51.0), ("Vide", "Z", 2.0, 4.0, 50.0, 51.0)],
        "area string, sector string, xmin double, xmax double, ymin double, ymax double",
    )
    points = maps.area_map_points(pressure.pressure(micro, SECTOR, ["id"]), areas, "2025")
    write_area_maps(points, str(tmp_path / "maps"))
    assert [p.name for p in (tmp_path / "maps").iterdir() if p.is_dir()] == ["area_safe=Lens_Lievin"]


def files_of(path):
    """Data files by folder."""
    found = {}
    for file in path.rglob("part-*"):
        found.setdefault(str(file.parent.relative_to(path)), []).append(file.name)
    return found


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_replacing_one_period(spark, tmp_path, fmt):
    """Only the periods written are replaced; a second run gives the same folders and rows."""
    path = tmp_path / "report"

    def write(rows, mode):
        write_report(spark.createDataFrame(rows, "period string, sector string, n int"), str(path), fmt, mode=mode)

    def stored():
        back = spark.read.format(fmt).option("header", True).load(str(path))
        return sorted((str(r["period"]), r["sector"], int(r["n"])) for r in back.collect())

    write([("2023", "A", 1), ("2024", "A", 2), ("2024", "B", 3), ("2025", "A", 4)], "error")
    for _ in range(2):
        write([("2025", "A", 5), ("2025", "C", 6)], "replace")
        assert stored() == [("2023", "A", 1), ("2024", "A", 2), ("2024", "B", 3), ("2025", "A", 5), ("2025", "C", 6)]
        assert {k: len(v) for k, v in files_of(path).items()} == {"period=2023": 1, "period=2024": 1, "period=2025": 1}
    write([("2026", "A", 7)], "replace")
    assert len(stored()) == 6
    write_report(spark.createDataFrame([], "period string, sector string, n int"), str(path), fmt, mode="replace")
    assert len(stored()) == 6
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write([("2030", "A", 8)], "overwrite")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert stored() == [("2030", "A", 8)]


def test_only_folders_are_replaced(spark, tmp_path):
    with pytest.raises(ValueError, match="overwrite"):
        write_report(spark.range(3), str(tmp_path / "x"), partition_by=None, mode="replace")


def test_few_files_in_a_folder(spark, tmp_path):
    table = spark.range(0, 3000, 1, 8).selectExpr("CAST(2023 + id % 3 AS STRING) AS period", "id")
    write_report(table, str(tmp_path / "r"))
    assert {k: len(v) for k, v in files_of(tmp_path / "r").items()} == {f"period={y}": 1 for y in (2023, 2024, 2025)}


def test_files_follow_the_size_of_an_area(spark, tmp_path):
    """An area with most rows is written by several tasks, the others have a file each."""
    points = spark.range(0, 60_000, 1, 8).selectExpr(
        "IF(id % 20 = 0, concat('Area ', id % 7), 'Large') AS area", "'2025' AS period", "id", "sha2(string(id), 256) AS label"
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        write_area_maps(points, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = {k.split("/")[0]: len(v) for k, v in files_of(tmp_path / "m").items()}
    assert 3 <= files.pop("area_safe=Large") <= 20
    # One of the seven shares the hash partition of the large one here.
    assert len(files) == 7 and sorted(files.values())[:6] == [1] * 6
    assert spark.read.parquet(str(tmp_path / "m")).count() == 60_000


def test_json_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        read_applications(spark, str(tmp_path), "json")


def test_both_renewal_headers(spark, micro, tmp_path):
    """The first counts, the other stays under its own name."""
    path = str(tmp_path / "both")
    sheet = spreadsheet(micro).withColumn("Renouvellements confirmés", F.lit(-1.0))
    sheet.write.parquet(path)
    df = conform(read_applications(spark, path))
    assert {r[0] for r in df.select("Renouvellements confirmés").collect()} == {-1.0}
    assert df.agg(F.sum("renewals_confirmed")).first()[0] == micro.agg(F.sum("renewals_confirmed")).first()[0]


def test_numbers_in_text_columns(spark, micro, rows):
    as_numbers = micro.withColumns(
        {"period": F.col("period").cast("double"), "round_label": F.lit(2.0), "applicant_id": F.lit(100000.0)}
    )
    df = conform(as_numbers)
    assert {r.period for r in df.collect()} == {"2024", "2025"}
    assert {(r.round_label, r.applicant_id) for r in df.collect()} == {("2", "100000")}
    found = pressure.report(conform(micro.withColumn("period", F.col("period").cast("double"))), SECTOR, ["id"], period="2025")
    assert rows(found) == rows(pressure.report(micro, SECTOR, ["id"], period="2025")) and found.count() > 0


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_period_is_chosen_before_rows_are_numbered(spark, micro, tmp_path, rows, fmt):
    path = str(tmp_path / fmt)
    writer = micro.write.partitionBy("period").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    schema = micro.schema if fmt == "json" else None
    df = conform(read_applications(spark, path, fmt, schema=schema, period="2025"))
    result = pressure.report(df, SECTOR, FILE_ORDER, period="2025")
    plan = result._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert filters and all("2025" in f for f in filters)
    assert {r.period for r in result.collect()} == {"2025"}
