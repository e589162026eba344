"""Every registered query against its SQL, exactly, and the driver's contract."""

import time

import pytest

import __spark_entry__ as registered
import compare
from oracles import catalog
from oracles.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(FOLDER)


def test_contract(spark):
    assert registered.oracle_sql().keys() <= registered.queries().keys()
    assert CATALOG.keys() <= registered.oracle_sql().keys()
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_same_as_sql(spark, db, name):
    assert compare.difference(spark, db, name, FOLDER) is None


@pytest.mark.parametrize("name", ["read_json", "read_parquet_order", "read_csv", "read_csv_order", "read_json_order", "read_parquet"])
def test_files_read_back_have_a_bounded_number_of_rows(spark, db, tmp_path, monkeypatch, name):
    """One task sorts a file, so a larger table is written to more files; the results stay."""
    path = f"file://{tmp_path}/rows"
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 500, raising=False)
    monkeypatch.setattr(catalog, "_scratch", lambda spark: path)
    assert compare.difference(spark, db, name, FOLDER) is None
    fmt = name.split("_")[1]
    stored = spark.read.options(header=True).schema("l_orderkey long").format(fmt).load(path)
    counts = [r["count"] for r in stored.groupBy("_metadata.file_name").count().collect()]
    assert sum(counts) == 6000 and max(counts) <= 1000


@pytest.fixture
def sorted_for_files(spark, tmp_path, monkeypatch):
    """Round trips in many small files in the test's folder; returns the tables that are sorted for them."""
    tables, frame = [], type(spark.range(0))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: tables.append(self) or deal(self, *a))
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 500)
    monkeypatch.setattr(catalog, "_scratch", lambda spark: f"file://{tmp_path}/rows")
    return tables


@pytest.mark.parametrize("name", ["read_json_order", "read_json", "read_csv_order", "read_csv"])
def test_files_take_little_disk(spark, tmp_path, sorted_for_files, name):
    """A line item takes about 480 bytes of plain JSON and 150 of CSV."""
    registered.queries()[name](spark, FOLDER)
    assert sum(p.stat().st_size for p in (tmp_path / "rows").rglob("part-*")) < 100 * 6000


@pytest.mark.parametrize("name", ["read_json_order", "read_json", "read_csv_order", "read_csv"])
def test_shuffles_for_files_take_little_disk(spark, tmp_path, sorted_for_files, name):
    """Few columns are sorted, not all rows at once, and the files of these shuffles go when the rows are written."""
    jvm = spark.sparkContext._jvm

    def shuffled():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}

    before = shuffled()
    registered.queries()[name](spark, FOLDER)
    for _ in range(20):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
    assert all(len(t.columns) <= 12 for t in sorted_for_files)
    counts = [t.count() for t in sorted_for_files]
    assert sum(counts) == 6000 and max(counts) <= 4000
