import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roomtide.schema import applications_schema  # noqa: E402
from roomtide.session import local_session  # noqa: E402

from pyspark.sql import types as T  # noqa: E402

COLUMNS = (
    "id period sector residence applicant_id round_label scale_band capacity offered_total leftover "
    "renewals_confirmed latitude longitude offered_round_1 offered_round_2"
).split()

# The hand-worked applications: ten rows, then the coordinates added below.
MICRO = [
    (1, "2025", "A", "R1", "S1", "Tour 1", "3", 100, 10, 4, 50, 6, 0),
    (2, "2025", "A", "R1", "S1", "Tour 2", "3", 100, 10, 4, 50, 0, 5),
    (3, "2025", "A", "R1", "S2", "Tour 1", "0 Bis", 100, 10, 4, 50, 6, 0),
    (4, "2025", "A", "R2", "S2", "Tour 2", "Hors Barème", 40, 5, 4, None, 0, 2),
    (5, "2025", "A", "R2", "S3", "Tour 1", None, 40, 5, 4, 20, 3, 0),
    (6, "2025", "A", None, "S4", "Tour 2", "5", None, None, None, None, 0, 0),
    (7, "2025", "B", "R3", "S1", "Tour 1", "7", 80, 0, 2, 30, 0, 0),
    (8, "2025", "B", "R3", "S5", "Phase", "2", 80, 0, 2, 30, 0, 0),
    (9, "2025", "B", "R3", None, "Tour 1", "1", 80, 0, 2, 30, 0, 0),
    (10, "2024", "A", "R1", "S6", "Tour 1", "Hors Barème", 90, 8, 1, 45, 4, 0),
]


def application_rows(rows):
    """Rows of the short form above with sector coordinates."""
    number = lambda v: None if v is None else float(v)
    full = []
    for row in rows:
        text, numbers = row[:7], [number(v) for v in row[7:]]
        where = {"A": (50.5, 3.0), "B": (50.25, 2.0)}.get(row[2], (None, None))
        full.append((*text, *numbers[:4], *where, *numbers[4:]))
    return full


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def make(spark):
    """Build an application table from short rows."""
    fields = {f.name: f for f in applications_schema(2).fields}
    schema = T.StructType([T.StructField("id", T.LongType())] + [fields[c] for c in COLUMNS[1:]])

    def build(rows):
        return spark.createDataFrame(application_rows(rows), schema)

    return build


@pytest.fixture(scope="session")
def micro(make):
    return make(MICRO).cache()


@pytest.fixture(scope="session")
def rows():
    """Results as a set of tuples, or a dict keyed by the first columns."""

    def collect(df, keys=0):
        found = [tuple(r) for r in df.collect()]
        if not keys:
            return set(found)
        table = {r[:keys]: r[keys:] for r in found}
        assert len(table) == len(found)
        return table

    return collect
