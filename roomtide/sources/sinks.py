"""Writing report tables.

Rows are dealt to the folders that they go to before they are written, so that a folder has few files: adaptive execution
(`spark.sql.adaptive.advisoryPartitionSizeInBytes`) puts small folders together in one task, which writes a file in
each, and splits a large one over several tasks of about that size, together with any that its hash falls together with.
Without it a folder would get a file from every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.operators.reshape import add_safe_area

#: Beside Spark's own modes: only the folders that the table has rows for are replaced, all others stay.
REPLACE = "replace"


def _write(df: DataFrame, path: str, fmt: str, folders: Sequence[str], mode: str) -> None:
    if mode == REPLACE and not folders:
        raise ValueError("only folders can be replaced; a table without `partition_by` is written with mode overwrite")
    rows = df.hint("rebalance", *[F.col(f) for f in folders]) if folders else df
    writer = rows.write.format(fmt).mode("overwrite" if mode == REPLACE else mode)
    # Said for each write, so that a setting of the session changes neither mode.
    writer = writer.option("partitionOverwriteMode", "dynamic" if mode == REPLACE else "static")
    if folders:
        writer = writer.partitionBy(*folders)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_report(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "period", mode: str = "error"
) -> None:
    """Write a report table, one directory per period unless `partition_by` says otherwise.

    With mode "replace" the periods of the table take the place of the same periods under `path`, and other periods stay:
    one year can be written again, and a second run leaves the same folders. "overwrite" clears all of `path` first.
    Either takes effect when all tasks are done, so a lost executor leaves the old rows. A table without rows
    replaces nothing.
    """
    _write(df, path, fmt, [] if partition_by is None else [partition_by], mode)


def write_area_maps(points: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write the map points, one directory per area and period. Areas without points get none. Modes as in `write_report`."""
    _write(add_safe_area(points), path, fmt, ["area_safe", "period"], mode)
