from roomtide.functions.labels import (
    band_rank,
    map_label,
    marker_size,
    pressure_class,
    pressure_class_rank,
    residence_tooltip,
    round_from_all_digits,
    round_from_first_digits,
    safe_name,
    shifted_latitude,
    shifted_longitude,
)
from roomtide.functions.numbers import (
    adjusted_pressure,
    growth_pct,
    missing_if_nan,
    number_text,
    parse_number,
    percent,
    plain_text,
    ratio,
    raw_pressure,
    round_to,
)
