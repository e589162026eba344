"""Session settings.

On a cluster pass your own session to the library; these are settings to start from. Nothing here
sets a checkpoint folder: reports never cut lineage, and the text operators, which do, take the cluster's own
`spark.checkpoint.dir` and refuse to run on a cluster without it.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    # Sizes of shuffles and join sides are only known at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(name: str, cores: int | str | None = None) -> SparkSession:
    """A session on this machine, for tests and timings."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
