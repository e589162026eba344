"""Division, rounding and number formatting as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")

# From this size on every double is whole, so there is nothing to round; below it floor() stays a bigint.
_ALL_WHOLE = float(2**52)


def ratio(a: Column, b: Column) -> Column:
    """a / b in floating point: x/0 is +-Infinity, 0/0 is NaN, null if either side is null."""
    a, b = a.cast("double"), b.cast("double")
    # try_divide is null only for a missing side or a zero divisor; a * (0 + Infinity) settles the latter.
    return F.coalesce(F.try_divide(a, b), a * (b + F.lit(_INF)))


def round_to(x: Column, digits: int) -> Column:
    """Round to the nearest decimal, a tie going to the even last digit.

    Both neighbours are compared by their distance to `x`, so the answer does not depend on
    how an engine scales doubles. NaN, infinities and values too large for decimals pass unchanged.
    """
    scale = F.lit(float(10**digits))

    def neighbour(whole: Column, sign: int) -> Column:
        value = whole.cast("double") / scale
        distance = x - value if sign < 0 else value - x
        return F.struct(distance.alias("distance"), F.pmod(whole, F.lit(2)).alias("odd"), value.alias("value"))

    nearest = F.least(neighbour(F.floor(x * scale), -1), neighbour(F.ceil(x * scale), 1))
    return F.when(F.abs(x) < _ALL_WHOLE, nearest["value"]).otherwise(x)


def percent(a: Column, b: Column) -> Column:
    """a as a percentage of b, 2 decimals."""
    return round_to(ratio(a, b) * 100.0, 2)


def growth_pct(now: Column, before: Column) -> Column:
    """Change from `before` to `now` in percent, 1 decimal."""
    return round_to((ratio(now, before) - 1.0) * 100.0, 1)


def raw_pressure(applicants: Column, offered: Column) -> Column:
    """Applicants per offered place, 2 decimals."""
    return round_to(ratio(applicants, offered), 2)


def adjusted_pressure(eligible: Column, offered: Column, leftover: Column) -> Column:
    """Eligible last-round applicants plus reserved places, per offered place, 2 decimals."""
    return round_to(ratio(eligible + (offered - leftover), offered), 2)


def missing_if_nan(x: Column) -> Column:
    """Null for NaN, so that sorts and maxima ignore it."""
    return F.when(~F.isnan(x), x)


def parse_number(text: Column) -> Column:
    """Text to double, null if it is not a plain number."""
    plain = text.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$")
    return F.when(plain, F.trim(text).try_cast("double"))


def plain_text(column: Column, kind: str) -> Column:
    """A column of type `kind` as text, numbers written out: 2025.0 is "2025", 100000.0 is "100000", NaN is missing.

    For periods, identifiers and bands that a file holds as numbers. `number_text` is for labels.
    """
    if kind.startswith("decimal"):
        text = F.regexp_replace(column.cast("string"), r"(\.[0-9]*?)0+$", "$1")
        return F.regexp_replace(text, r"\.$", "")
    if kind not in ("double", "float"):
        return column.cast("string")
    x = column.cast("double")
    whole = (x == F.rint(x)) & (F.abs(x) < 1e38)
    return F.when(whole, x.try_cast("decimal(38,0)").cast("string")).when(~F.isnan(x), column.cast("string"))


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build` of a value that is computed once a row, however often `build` uses it.

    A column used twice is written twice into the plan, so helpers that use their arguments several times multiply its
    size. Here the value is the element of an array of one, and `build` a lambda over it.
    """
    return F.get(F.transform(F.array(value), build), 0)


# One digit, a point, 14 digits, "E" and the power: rounded from the exact double, a tie to the even digit.
_SCIENTIFIC = "0.00000000000000E0"


def _whole_digits(x: Column) -> Column:
    """The nearest whole number of a double below 2^95, all digits written out."""
    step, x = F.lit(float(2**32)), F.rint(x)
    high = F.floor(x / step)
    low = (x - high.cast("double") * step).cast("bigint")
    return (high.cast("decimal(19,0)") * F.lit(2**32).cast("decimal(10,0)") + low.cast("decimal(10,0)")).cast("string")


def _written(x: Column, digits: Column, power: Column) -> Column:
    """The shorter of both forms of the positive x with these digits, the first of them worth 10^power."""
    n = F.length(digits)
    fixed = (
        # Beyond 15 digits the whole number is written out; the scientific form is shorter from 21 on.
        F.when(power.between(15, 20), _whole_digits(x))
        .when(power >= n - 1, F.rpad(digits, power + 1, "0"))
        .when(power >= 0, F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    )
    scientific = F.concat(
        digits.substr(1, 1),
        F.when(n > 1, F.concat(F.lit("."), digits.substr(F.lit(2), n))).otherwise(""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    return bound(
        F.struct(fixed.alias("fixed"), scientific.alias("scientific")),
        lambda both: F.when(F.length(both.fixed) <= F.length(both.scientific), both.fixed).otherwise(both.scientific),
    )


def _label(x: Column) -> Column:
    """`number_text` of a value that is cheap to repeat."""
    form = F.call_function("format_number", F.abs(x), F.lit(_SCIENTIFIC))
    parts = bound(
        form,
        lambda text: F.struct(
            F.regexp_replace(F.regexp_replace(text, r"E.*|\.", ""), "0+$", "").alias("digits"),
            F.substring_index(text, "E", -1).try_cast("int").alias("power"),
        ),
    )
    sign = F.when(x < 0, "-").otherwise("")
    return (
        F.when(x.isNull(), "NA")
        .when(F.isnan(x), "NaN")
        .when(F.abs(x) == _INF, F.concat(sign, F.lit("Inf")))
        .when(x == 0, "0")
        .otherwise(F.concat(sign, bound(parts, lambda p: _written(F.abs(x), p.digits, p.power))))
    )


def number_text(x: Column) -> Column:
    """A number as a label: up to 15 significant digits after which decimals end, "NA" for null, "Inf"/"-Inf"/"NaN" spelled out.

    Written out, or in the scientific form where that is shorter: 100000 is "1e+05", 120000 stays
    "120000", 0.0001 is "1e-04", 1e15 is "1e+15". The digits are those of the exact double, at every size; a tie goes to
    the even digit. Only subnormal numbers (below 2.3e-308) can miss the last digit.
    """
    return bound(x.cast("double"), _label)
