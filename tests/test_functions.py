import inspect
import math
import random
import time
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roomtide import functions as fn

INF, NAN = float("inf"), float("nan")


def evaluate(spark, inputs, build, kind="double"):
    """Results of one expression over a column of inputs, in order."""
    schema = f"i int, x {kind}"
    df = spark.createDataFrame(list(enumerate(inputs)), schema)
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_ratio_by_zero(spark):
    pairs = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (NAN, 0.0), (None, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    got = [r[0] for r in df.orderBy("i").select(fn.ratio(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.5, INF, -INF]
    assert math.isnan(got[3]) and math.isnan(got[6])
    assert got[4] is None and got[5] is None and got[7] is None


def test_ratio_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert evaluate(spark, [1.0, 0.0], lambda x: fn.ratio(F.lit(1), x)) == [1.0, INF]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_round_to(spark):
    inputs = [0.125, 0.375, 2.675, -0.125, -0.3, 0.27, 1e15, INF, -INF, None, 0.0, 2e13 + 0.126, 2.0**52 + 1]
    want = [0.12, 0.38, 2.67, -0.12, -0.3, 0.27, 1e15, INF, -INF, None, 0.0, 20000000000000.12, 2.0**52 + 1]
    assert evaluate(spark, inputs, lambda x: fn.round_to(x, 2)) == want
    assert math.isnan(evaluate(spark, [NAN], lambda x: fn.round_to(x, 2))[0])
    assert evaluate(spark, [0.25, 0.35, 12.5], lambda x: fn.round_to(x, 1)) == [0.2, 0.3, 12.5]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.fractions(min_value=-50, max_value=50, max_denominator=400), min_size=50, max_size=200))
def test_round_to_is_nearest(spark, fractions):
    """Never farther from the value than the exact decimal rounding of the double."""
    values = [float(f) for f in fractions]
    for value, got in zip(values, evaluate(spark, values, lambda x: fn.round_to(x, 2))):
        exact = Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        assert abs(got - value) <= abs(float(exact) - value)
        assert round(got * 100) == pytest.approx(got * 100, abs=1e-9)


def test_round_numbers(spark):
    labels = ["Tour 1 - phase 2", "Phase", "Tour 3", None, "", "2025 Tour 10"]
    assert evaluate(spark, labels, fn.round_from_all_digits, "string") == [12, None, 3, None, None, 202510]
    assert evaluate(spark, labels, fn.round_from_first_digits, "string") == [1, None, 3, None, None, 2025]
    assert evaluate(spark, ["Tour 123456789012345678901234"], fn.round_from_all_digits, "string") == [
        123456789012345678901234.0
    ]


def test_pressure_classes(spark):
    values = [-1.0, 0.99, 1.0, 4.99, 5.0, 8.0, 10.0, INF, NAN, -INF, None]
    classes = ["≤1", "≤1", "1 à 4", "1 à 4", "5 à 7", "8 à 9", ">10", None, None, "≤1", None]
    ranks = [5, 5, 4, 4, 3, 2, 1, None, None, 5, None]
    sizes = [2, 2, 4, 4, 8, 12, 16, None, None, 2, None]
    assert evaluate(spark, values, fn.pressure_class) == classes
    assert evaluate(spark, values, fn.pressure_class_rank) == ranks
    assert evaluate(spark, values, fn.marker_size) == sizes


def test_number_text(spark):
    cases = {
        2.0: "2",
        1.5: "1.5",
        0.27: "0.27",
        0.0: "0",
        -4.0: "-4",
        10.0: "10",
        100000.0: "1e+05",
        120000.0: "120000",
        123456.0: "123456",
        12000000.0: "1.2e+07",
        12345678.25: "12345678.25",
        12345678.125: "12345678.125",
        0.0001: "1e-04",
        0.001: "0.001",
        0.00012345: "0.00012345",
        -1.5e-7: "-1.5e-07",
        1e15: "1e+15",
        123456789012345.0: "123456789012345",
        1234567890123456.0: "1234567890123456",
        2.0**53: "9007199254740992",
        1.5e19: "1.5e+19",
        1 / 3: "0.333333333333333",
        200 / 3: "66.6666666666667",
        1e100: "1e+100",
        None: "NA",
        INF: "Inf",
        -INF: "-Inf",
    }
    assert evaluate(spark, list(cases), fn.number_text) == list(cases.values())
    assert evaluate(spark, [NAN], fn.number_text) == ["NaN"]


def written_number(x):
    """The label of a number, from the digits that C's printf rounds exactly."""
    sign, x = "-" if x < 0 else "", abs(x)
    if x in (0.0, INF):
        return sign + "Inf" if x else "0"
    mantissa, power = (f"{x:.14e}").split("e")
    power, digits = int(power), mantissa.replace(".", "").rstrip("0")
    if power >= 15:
        fixed = f"{x:.0f}"
    elif power >= len(digits) - 1:
        fixed = digits.ljust(power + 1, "0")
    elif power >= 0:
        fixed = f"{digits[: power + 1]}.{digits[power + 1 :]}"
    else:
        fixed = "0." + "0" * (-power - 1) + digits
    point = "." if len(digits) > 1 else ""
    scientific = f"{digits[0]}{point}{digits[1:]}e{'-' if power < 0 else '+'}{abs(power):02d}"
    return sign + min(fixed, scientific, key=len)


def test_number_text_is_exact_at_every_size(spark):
    """Also for numbers of 16 digits that end with 5, ties or nearly so, and for whole numbers of many digits."""
    rng = random.Random(1)
    values = [rng.uniform(-1000, 1000) * 10.0 ** rng.randint(-300, 300) for _ in range(4000)]
    values += [float(f"{rng.randint(10**14, 10**15 - 1)}5e{rng.randint(-60, 60)}") for _ in range(8000)]
    values += [rng.randint(1, 2**53) / 2 ** rng.randint(0, 60) for _ in range(4000)]
    values += [float(rng.randint(10**15, 10**21)) for _ in range(4000)]
    assert evaluate(spark, values, fn.number_text) == [written_number(v) for v in values]


TWICE = {
    "ratio": lambda x: fn.ratio(x, x),
    "round_to": lambda x: fn.round_to(fn.ratio(x, x), 2),
    "percent": lambda x: fn.percent(x, x),
    "growth_pct": lambda x: fn.growth_pct(x, x),
    "raw_pressure": lambda x: fn.raw_pressure(x, x),
    "adjusted_pressure": lambda x: fn.adjusted_pressure(x, x, x),
    "missing_if_nan": fn.missing_if_nan,
    "plain_text": lambda x: fn.plain_text(x, "double"),
    "parse_number": lambda x: fn.parse_number(x.cast("string")),
    "round_from_all_digits": lambda x: fn.round_from_all_digits(x.cast("string")),
    "round_from_first_digits": lambda x: fn.round_from_first_digits(x.cast("string")),
    "pressure_class": fn.pressure_class,
    "pressure_class_rank": fn.pressure_class_rank,
    "marker_size": fn.marker_size,
    "shifted_longitude": lambda x: fn.shifted_longitude(x, x, x, x),
    "shifted_latitude": lambda x: fn.shifted_latitude(x, x, x),
    "band_rank": lambda x: fn.band_rank(x.cast("string")),
    "safe_name": lambda x: fn.safe_name(x.cast("string")),
    "number_text": fn.number_text,
    "map_label": lambda x: fn.map_label(x.cast("string"), x, "Brute"),
    "residence_tooltip": lambda x: fn.residence_tooltip(x.cast("string"), x.cast("string"), x, x, x),
}


@pytest.mark.parametrize("name", TWICE)
def test_plans_stay_small(spark, name):
    """A column of any function, here of a computed argument, takes a short plan and few seconds."""
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double").select(TWICE[name](F.col("x") / 3 + 1).alias("y"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    start = time.monotonic()
    assert df.count() == len(df.collect()) == 10
    assert time.monotonic() - start < 10


def test_every_function_has_a_plan_test():
    public = {name for name, value in vars(fn).items() if inspect.isfunction(value)}
    assert public == set(TWICE)


def test_parse_number(spark):
    cases = {"5": 5.0, " 7 ": 7.0, "1e2": 100.0, "-.5": -0.5, "0 Bis": None, "5D": None, "NaN": None, "": None, None: None}
    assert evaluate(spark, list(cases), fn.parse_number, "string") == list(cases.values())


def test_safe_name(spark):
    cases = {"Škoda Łódź": "Skoda_Lodz", "Ǻřǿ ệ": "Aro_e", "Lens-Liévin": "Lens_Lievin", "Béthune": "Bethune", "Cœur d'Îlot": "Coeur_d_Ilot", "Lille": "Lille"}
    assert evaluate(spark, list(cases), fn.safe_name, "string") == list(cases.values())


def test_labels(spark):
    assert evaluate(spark, [2.0, None], lambda x: fn.map_label(F.lit("A"), x)) == ["A\n2", "A\nNA"]
    assert evaluate(spark, [1.5], lambda x: fn.map_label(F.lit("A"), x, "Brute")) == ["A\nBrute\n1.5"]
    tooltip = evaluate(
        spark,
        [2.0],
        lambda x: fn.residence_tooltip(F.lit("2025"), F.lit("R1"), F.lit(10.0), F.lit(20), x),
    )
    assert tooltip == ["Année : 2025 <br>Résidence : R1 <br>Places: 10 <br>Demandes: 20 <br>Tension: 2"]


def test_band_rank(spark):
    bands = ["0 Bis", "7", "Non-boursiers", "Hors Barème", "0 bis", "", None]
    assert evaluate(spark, bands, fn.band_rank, "string") == [1, 9 - 1, 9, 10, 11, 11, 11]


def test_second_marker(spark):
    lat, size = F.lit(60.0), F.lit(4.0)
    assert evaluate(spark, [3.0], lambda x: fn.shifted_longitude(x, lat, size, size)) == pytest.approx([3.016])
    assert evaluate(spark, [60.0], lambda x: fn.shifted_latitude(x, size, size)) == pytest.approx([59.992])
    assert evaluate(spark, [60.0], lambda x: fn.shifted_latitude(x, F.lit(None).cast("double"), size)) == [None]


def test_plain_text(spark):
    numbers = [2025.0, 100000.0, 2025.5, -3.0, 0.0, 1e20, None, NAN]
    want = ["2025", "100000", "2025.5", "-3", "0", "100000000000000000000", None, None]
    assert evaluate(spark, numbers, lambda x: fn.plain_text(x, "double")) == want
    decimals = [Decimal("2025.00"), Decimal("20.50"), Decimal("100"), None]
    assert evaluate(spark, decimals, lambda x: fn.plain_text(x, "decimal(12,2)"), "decimal(12,2)") == ["2025", "20.5", "100", None]
    assert evaluate(spark, [2025, None], lambda x: fn.plain_text(x, "bigint"), "bigint") == ["2025", None]
    assert evaluate(spark, ["2025.0"], lambda x: fn.plain_text(x, "string"), "string") == ["2025.0"]
