"""Column names, grouping levels and the fixed values of the domain."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import types as T

PERIOD = ["period"]
SECTOR = ["period", "sector"]
RESIDENCE = ["period", "sector", "residence"]

TEXT_COLUMNS = [
    "period",
    "sector",
    "residence",
    "applicant_id",
    "round_label",
    "scale_band",
]
NUMBER_COLUMNS = [
    "capacity",
    "offered_total",
    "leftover",
    "renewals_confirmed",
    "latitude",
    "longitude",
]
REQUIRED_COLUMNS = TEXT_COLUMNS + NUMBER_COLUMNS

# One column per round, `offered_round_1` ... `offered_round_n`, found by prefix.
ROUND_PREFIX = "offered_round_"


class RowOrder(NamedTuple):
    """Columns that together order all rows without ties.

    The first `unit` of them may name a stretch of input that is read in one go, such as a file. The
    first row is then found per stretch by one number, and only those winners are compared in full.
    """

    columns: tuple[str, ...]
    unit: int = 0


# File position added by `sources.read_applications`: the order of rows as the files hold them.
FILE_ORDER = RowOrder(("source_file", "source_block", "source_row"), unit=2)


def row_order(order: RowOrder | Sequence[str]) -> RowOrder:
    return order if isinstance(order, RowOrder) else RowOrder(tuple(order))


# --- fixed values: these must be spelled exactly like this for results to match ---

# Spreadsheet headers of the application table and their names here.
SPREADSHEET_HEADERS = {
    "Année de gestion": "period",
    "Secteur": "sector",
    "Résidence": "residence",
    "INE": "applicant_id",
    "Sous-phase (Libellé)": "round_label",
    "Echelon social": "scale_band",
    "Nombre logement": "capacity",
    "Places Total": "offered_total",
    "Places phase complémentaire": "leftover",
    "Renouvellement confirmé": "renewals_confirmed",
    "Renouvellements confirmés": "renewals_confirmed",
    "Latitude": "latitude",
    "Longitude": "longitude",
}
SPREADSHEET_ROUND_PREFIX = "Places Tour "

# Bands that do not count as eligible (besides a missing one).
NOT_ELIGIBLE = ("", "Hors Barème")

# Bands in display order.
BANDS = ("0 Bis", "1", "2", "3", "4", "5", "6", "7", "Hors Barème")
NON_GRANT = "Non-boursiers"
BAND_ORDER = ("0 Bis", "1", "2", "3", "4", "5", "6", "7", "Non-boursiers", "Hors Barème")
TOTAL = "Total"

# Pressure classes: label, lower bound (included), upper bound (excluded), marker size.
PRESSURE_CLASSES = (
    ("≤1", float("-inf"), 1.0, 2.0),
    ("1 à 4", 1.0, 5.0, 4.0),
    ("5 à 7", 5.0, 8.0, 8.0),
    ("8 à 9", 8.0, 10.0, 12.0),
    (">10", 10.0, float("inf"), 16.0),
)

# Shift of the second marker of a sector, in degrees per unit of marker size.
MARKER_SHIFT = 0.002

# Words of the residence tooltip, each before its value.
TOOLTIP_WORDS = ("Année :", "<br>Résidence :", "<br>Places:", "<br>Demandes:", "<br>Tension:")

# Names of the two ratios on the area maps.
RAW_KIND = "Brute"
ADJUSTED_KIND = "Réajustée"

# Areas: name -> (sectors, xmin, xmax, ymin, ymax).
AREAS = {
    "Lille": (("Lille Centre", "Roubaix - Tourcoing", "Lille Est"), 2.8, 3.35, 50.5, 50.83),
    "Littoral": (
        ("Boulogne-sur-Mer", "Calais", "Longuenesse - Saint Omer", "Dunkerque"),
        1.5,
        2.7,
        50.5,
        51.2,
    ),
    "Artois": (("Lens-Liévin", "Béthune", "Arras"), 2.3, 3.1, 50.22, 50.60),
    "Valenciennois": (("Cambrai", "Valenciennes", "Maubeuge"), 3.15, 4.1, 49.95, 50.55),
}

AREA_SCHEMA = T.StructType(
    [
        T.StructField("area", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("xmin", T.DoubleType()),
        T.StructField("xmax", T.DoubleType()),
        T.StructField("ymin", T.DoubleType()),
        T.StructField("ymax", T.DoubleType()),
    ]
)


def applications_schema(rounds: int) -> T.StructType:
    """Declared schema of the application table with `rounds` round columns."""
    numbers = NUMBER_COLUMNS + [f"{ROUND_PREFIX}{k}" for k in range(1, rounds + 1)]
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
        + [T.StructField(c, T.DoubleType()) for c in numbers]
    )
