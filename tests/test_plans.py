"""Physical plans of the registered queries."""

import re

import pytest

from oracles.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan_of(spark):
    def explain(name):
        result = CATALOG[name].run(spark, FOLDER)
        return result._jdf.queryExecution().executedPlan().toString()

    return explain


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_operators_in_plan(plan_of, name):
    """No Python, no cartesian product, and windows only over one row per period or band."""
    plan = plan_of(name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan
    windows = [line for line in plan.split("\n") if re.search(r"\bWindow\b", line)]
    small = ("yearly_growth", "yearly_table", "yearly_table_selection", "yearly_dual_axis", "band_distribution", "band_distribution_selection")
    assert not windows or name in small


def passes(spark, name):
    """Scans of the line items that the query really runs."""
    result = CATALOG[name].run(spark, FOLDER)
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet \[l_", final))


@pytest.mark.parametrize(
    "name, most",
    [
        ("report_sector", 2),
        ("report_sector_selection", 2),
        ("report_residence", 2),
        ("report_residence_selection", 2),
        ("pressure_sector", 2),
        ("area_map_points", 2),
        ("top_residences", 2),
        ("yearly_overview", 2),
        ("yearly_table", 2),
        ("band_table", 1),
        ("band_distribution", 1),
        ("complete_sector_band", 2),
        ("concentration_residence", 1),
    ],
)
def test_number_of_passes(spark, name, most):
    assert passes(spark, name) <= most


def test_scans_read_only_needed_columns(plan_of):
    plan = plan_of("leftover_sector")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    read = {field.split(":")[0] for schema in schemas for field in schema.split(",")}
    assert "o_custkey" not in read and "l_quantity" not in read and "s_name" not in read


def test_period_filter_reaches_the_scan(spark, micro, tmp_path):
    from roomtide.reports.pressure import report
    from roomtide.schema import SECTOR

    path = str(tmp_path / "applications")
    micro.write.partitionBy("period").parquet(path)
    df = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    df = df.withColumn("period", df["period"].cast("string"))
    plan = report(df, SECTOR, ["id"], period="2025")._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert filters and all("2025" in f for f in filters)


def test_single_order_column_aggregates_by_hash(micro):
    from roomtide.operators.places import place_summary
    from roomtide.schema import SECTOR

    plan = place_summary(micro, SECTOR, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["top_band", "band_table", "band_distribution"])
def test_bands_by_hash_in_one_pass(spark, make, tmp_path, name):
    """With a whole number as order no rows of applicants are sorted for an aggregate, and the table is read once."""
    from roomtide.operators.bands import credits, top_band_per_applicant
    from roomtide.reports import grants

    from conftest import MICRO

    make(MICRO).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    folds = top_band_per_applicant if name == "top_band" else credits
    plan = folds(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    result = folds(df, ["id"]) if name == "top_band" else getattr(grants, name)(df, ["id"])
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan parquet", final)) == 1


def test_complete_gathers_nothing(plan_of):
    assert "collect_set" not in plan_of("complete_sector_band")


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def no_broadcast(spark):
    settings = NO_BROADCAST | {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_a_task(result):
    """Rows of a result by the task that makes them, without what adaptive execution could mend."""
    from pyspark.sql import functions as F

    return [r[0] for r in result.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]


def test_last_round_rows_of_a_large_group(spark, no_broadcast):
    """Without broadcasts and without splitting of skewed joins, a group with most rows goes to many tasks."""
    from pyspark.sql import functions as F

    from roomtide.operators.demand import last_round_rows
    from roomtide.schema import SECTOR

    rows = spark.range(0, 50_000, 1, 8).select(
        F.lit("2025").alias("period"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("S"), F.col("id") % 97)).otherwise("large").alias("sector"),
        F.sha2(F.col("id").cast("string"), 256).alias("applicant_id"),
        F.lit("Tour 1").alias("round_label"),
    )
    result = last_round_rows(rows, SECTOR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "applicant_id" not in line]
    join = plan[: plan.index("HashAggregate")]
    assert keyed and all("_salt" in line for line in join.split("\n") if "Exchange hashpartitioning(" in line)
    counts = rows_a_task(result)
    assert sum(counts) == 50_000 and max(counts) < 10_000


def test_concentration_of_a_large_period(spark, no_broadcast):
    """Totals reach the groups of a period that has nearly all of them over many tasks."""
    from roomtide.operators.shares import concentration

    counts = spark.range(0, 40_000, 1, 8).selectExpr("IF(id % 100 = 0, '2024', '2025') AS period", "concat('S', id) AS sector", "id AS applicants")
    result = concentration(counts)
    found = rows_a_task(result)
    assert sum(found) == 40_000 and max(found) < 8_000
    share = result.filter("sector = 'S39999'").first()
    total = sum(i for i in range(40_000) if i % 100)
    assert share["concentration"] == pytest.approx(39999 * 39600 / total, abs=0.01)
