"""Round numbers, pressure classes, map labels and file names as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtide.functions.numbers import number_text
from roomtide.schema import BAND_ORDER, MARKER_SHIFT, PRESSURE_CLASSES, TOOLTIP_WORDS

# Letters that no accent makes of a plain one, and their plain form, for file names.
_LIGATURES = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"))
_STROKES = str.maketrans("łŁøØđĐħĦıŧŦ", "lLoOdDhHitT")


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and the plain letters that they are made of."""
    blocks = [chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
    plain = {c: unicodedata.normalize("NFD", c)[0].translate(_STROKES) for c in blocks}
    found = {c: p for c, p in plain.items() if p != c and p.isascii()}
    return "".join(found), "".join(found.values())


_ACCENTED, _PLAIN = _plain_letters()


def round_from_all_digits(label: Column) -> Column:
    """Round number from every digit of the label: "Tour 1 - phase 2" is 12."""
    return _digits_to_number(F.regexp_replace(label, "[^0-9]", ""))


def round_from_first_digits(label: Column) -> Column:
    """Round number from the first run of digits: "Tour 1 - phase 2" is 1."""
    return _digits_to_number(F.regexp_extract(label, "([0-9]+)", 1))


def _digits_to_number(digits: Column) -> Column:
    """Text of digits to double, null if empty. Whole numbers parse much faster than doubles."""
    return F.coalesce(digits.try_cast("bigint").cast("double"), digits.try_cast("double"))


def _by_class(x: Column, answers: list) -> Column:
    """The answer of the class `x` falls in; null, NaN and +Infinity fall in none."""
    steps = list(zip((c[2] for c in PRESSURE_CLASSES), answers))
    first_upper, first_answer = steps[0]
    return reduce(
        lambda chain, step: chain.when(x < step[0], F.lit(step[1])),
        steps[1:],
        F.when(x < first_upper, F.lit(first_answer)),
    )


def pressure_class(x: Column) -> Column:
    return _by_class(x, [c[0] for c in PRESSURE_CLASSES])


def pressure_class_rank(x: Column) -> Column:
    """Legend order, the highest class first (1)."""
    return _by_class(x, list(range(len(PRESSURE_CLASSES), 0, -1)))


def marker_size(x: Column) -> Column:
    return _by_class(x, [c[3] for c in PRESSURE_CLASSES])


def shifted_longitude(longitude: Column, latitude: Column, size_a: Column, size_b: Column) -> Column:
    """Longitude of the second marker: moved east by half the summed sizes, widened by latitude."""
    return longitude + F.lit(MARKER_SHIFT) * (size_a + size_b) / (F.lit(2.0) * F.cos(latitude * pi / 180.0))


def shifted_latitude(latitude: Column, size_a: Column, size_b: Column) -> Column:
    """Latitude of the second marker: moved south by half the summed sizes."""
    return latitude - F.lit(MARKER_SHIFT) * (size_a + size_b) / 2.0


def text_or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit("NA"))


def map_label(sector: Column, value: Column, kind: str | None = None) -> Column:
    """Sector, optional kind and value on separate lines."""
    parts = [text_or_na(sector)] + ([F.lit(kind)] if kind else []) + [number_text(value)]
    return F.concat_ws("\n", *parts)


def residence_tooltip(period: Column, residence: Column, offered: Column, applicants: Column, pressure: Column) -> Column:
    texts = [
        text_or_na(period),
        text_or_na(residence),
        number_text(offered),
        text_or_na(applicants.cast("string")),
        number_text(pressure),
    ]
    return F.concat_ws(
        " ",
        *[part for word, text in zip(TOOLTIP_WORDS, texts) for part in (F.lit(word), text)],
    )


def band_rank(band: Column, order: tuple = BAND_ORDER) -> Column:
    """Place of a band in the display order (from 1); bands it does not name come last, "0 bis" among them."""
    place = F.array_position(F.array(*[F.lit(b) for b in order]), band)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("int")


def safe_name(text: Column) -> Column:
    """A name usable in file paths: accents dropped, anything but letters and digits to "_"."""
    plain = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _LIGATURES, text)
    return F.regexp_replace(F.translate(plain, _ACCENTED, _PLAIN), "[^a-zA-Z0-9]", "_")
