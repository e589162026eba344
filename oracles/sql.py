"""The registered queries as DuckDB SQL, written out from the definitions.

These follow the wording of each indicator (window maxima over raw rows, row_number, unpivot before
aggregation), not the rewrites the Spark code uses, so that the two check each other.
"""

from __future__ import annotations

SECTOR = ["period", "sector"]
RESIDENCE = ["period", "sector", "residence"]

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

APPLICATIONS = f"""
applications AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS period,
    n_name AS sector,
    r_name AS area,
    CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE s_name END AS residence,
    CASE WHEN l_partkey % 89 = 0 THEN NULL
         ELSE 'ID' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS applicant_id,
    CASE WHEN l_linenumber = 7 THEN NULL
         WHEN l_linenumber = 6 THEN 'Phase complementaire'
         WHEN l_linenumber >= 4 AND s_nationkey % 3 = 0 THEN 'Tour 3'
         WHEN l_linenumber >= 4 THEN 'Tour 4'
         ELSE 'Tour ' || CAST(l_linenumber AS VARCHAR) END AS round_label,
    CASE WHEN s_nationkey % 7 = 2 AND l_linenumber IN (4, 5) THEN 'Hors Bareme'
         WHEN (o_custkey + l_suppkey) % 11 = 0 THEN '0 Bis'
         WHEN (o_custkey + l_suppkey) % 11 = 8 THEN 'Hors Bareme'
         WHEN (o_custkey + l_suppkey) % 11 = 9 THEN ''
         WHEN (o_custkey + l_suppkey) % 11 = 10 THEN NULL
         ELSE CAST((o_custkey + l_suppkey) % 11 AS VARCHAR) END AS scale_band,
    CASE WHEN l_partkey % 47 = 0 THEN NULL
         ELSE CAST(100 + (s_suppkey * 37) % 400 AS DOUBLE) END AS capacity,
    CASE WHEN l_partkey % 41 = 0 THEN NULL
         WHEN s_nationkey = 13 OR s_suppkey % 23 = 7 THEN 0.0::DOUBLE
         ELSE floor(CAST(24 + (s_suppkey * 13 + year(o_orderdate) * 7) % 60 AS DOUBLE)
           / CAST(CASE s_nationkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 1 END
                  AS DOUBLE)) END AS offered_total,
    CASE WHEN s_suppkey % 10 = 3 THEN NULL
         ELSE CAST((s_suppkey * 5 + year(o_orderdate)) % 15 AS DOUBLE) END AS leftover,
    CASE WHEN l_partkey % 31 = 0 THEN NULL
         ELSE CAST((s_suppkey * 3 + year(o_orderdate)) % 40 AS DOUBLE) END AS renewals_confirmed,
    {", ".join(f'''CASE {"WHEN l_partkey % 29 = 0 THEN NULL" if k == 4 else ""} WHEN l_linenumber = {k}
         THEN CAST((s_suppkey * 7 + {5 * k} + year(o_orderdate)) % 30 AS DOUBLE)
         ELSE 0.0::DOUBLE END AS offered_round_{k}''' for k in (1, 2, 3, 4))},
    CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 50 + CAST(s_nationkey AS DOUBLE) / 32 END AS latitude,
    CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 2 + CAST(s_nationkey AS DOUBLE) / 16 END AS longitude,
    {ORDER}
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

AREAS = """
areas AS (
  SELECT r_name AS area, n_name AS sector,
    2 + CAST(r_regionkey AS DOUBLE) / 8 AS xmin, 3 + CAST(r_regionkey AS DOUBLE) / 8 AS xmax,
    50 + CAST(r_regionkey AS DOUBLE) / 16 AS ymin, 50.5 + CAST(r_regionkey AS DOUBLE) / 16 AS ymax
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

ALL_DIGITS = "TRY_CAST(regexp_replace(round_label, '[^0-9]', '', 'g') AS DOUBLE)"
FIRST_DIGITS = "TRY_CAST(regexp_extract(round_label, '[0-9]+') AS DOUBLE)"
ELIGIBLE = "scale_band IS NOT NULL AND scale_band NOT IN ('', 'Hors Bareme')"

BANDS = {
    "0 Bis": "band_0_bis",
    **{str(k): f"band_{k}" for k in range(1, 8)},
    "Hors Bareme": "band_hors_bareme",
}


# --- scalar rules ---


def ratio(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"""(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL
      WHEN {b} <> 0 THEN {a} / {b}
      WHEN isnan({a}) OR {a} = 0 THEN 'NaN'::DOUBLE
      WHEN {a} > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END)"""


def rounded(x: str, digits: int) -> str:
    s = f"{10 ** digits}.0::DOUBLE"
    low, high = f"(floor({x} * {s}) / {s})", f"(ceil({x} * {s}) / {s} + 0.0::DOUBLE)"
    return f"""(CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) >= 4503599627370496::DOUBLE THEN {x}
      WHEN {x} - {low} < {high} - {x} THEN {low}
      WHEN {x} - {low} > {high} - {x} THEN {high}
      WHEN floor({x} * {s}) % 2 = 0 THEN {low} ELSE {high} END)"""


def percent(a: str, b: str) -> str:
    return rounded(f"({ratio(a, b)} * 100.0::DOUBLE)", 2)


def growth(now: str, before: str) -> str:
    return rounded(f"(({ratio(now, before)} - 1.0::DOUBLE) * 100.0::DOUBLE)", 1)


RAW = rounded(ratio("applicants", "offered"), 2)
ADJUSTED = rounded(ratio("(eligible_last_round + (offered - leftover))", "offered"), 2)


def in_class(x: str, answers: list[str]) -> str:
    bounds = ["1", "5", "8", "10"]
    steps = " ".join(f"WHEN {x} < {b} THEN {a}" for b, a in zip(bounds, answers))
    return f"""(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 'Infinity'::DOUBLE THEN NULL
      {steps} ELSE {answers[4]} END)"""


def pressure_class(x: str) -> str:
    return in_class(x, ["'≤1'", "'1 à 4'", "'5 à 7'", "'8 à 9'", "'>10'"])


def class_rank(x: str) -> str:
    return in_class(x, ["5", "4", "3", "2", "1"])


def marker(x: str) -> str:
    return in_class(x, ["2.0::DOUBLE", "4.0::DOUBLE", "8.0::DOUBLE", "12.0::DOUBLE", "16.0::DOUBLE"])


def number_text(x: str) -> str:
    """Up to 15 significant digits, written out or scientific, whichever is shorter."""
    form = f"printf('%.14e', abs({x}))"
    power = f"CAST(split_part({form}, 'e', 2) AS INTEGER)"
    digits = f"rtrim(replace(split_part({form}, 'e', 1), '.', ''), '0')"
    fixed = f"""(CASE WHEN {power} >= 15 THEN printf('%.0f', abs({x})) WHEN {power} >= length({digits}) - 1 THEN rpad({digits}, {power} + 1, '0')
      WHEN {power} >= 0 THEN substr({digits}, 1, {power} + 1) || '.' || substr({digits}, {power} + 2)
      ELSE '0.' || repeat('0', -{power} - 1) || {digits} END)"""
    scientific = f"""(substr({digits}, 1, 1) || CASE WHEN length({digits}) > 1 THEN '.' || substr({digits}, 2) ELSE '' END
      || CASE WHEN {power} < 0 THEN 'e-' ELSE 'e+' END
      || CASE WHEN abs({power}) < 10 THEN '0' ELSE '' END || CAST(abs({power}) AS VARCHAR))"""
    return f"""(CASE WHEN {x} IS NULL THEN 'NA' WHEN isnan({x}) THEN 'NaN'
      WHEN {x} = 'Infinity'::DOUBLE THEN 'Inf' WHEN {x} = '-Infinity'::DOUBLE THEN '-Inf' WHEN {x} = 0 THEN '0'
      ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END
        || CASE WHEN length({fixed}) <= length({scientific}) THEN {fixed} ELSE {scientific} END END)"""


# --- indicator tables ---


def cols(group: list[str]) -> str:
    return ", ".join(group)


def present(names: list[str]) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


def demand_needs(group: list[str]) -> list[str]:
    return ["period", "sector", "applicant_id"] + (["residence"] if "residence" in group else [])


def applicants(group: list[str], name: str = "applicants") -> str:
    return f"""SELECT {cols(group)}, count(*) AS {name}
      FROM (SELECT DISTINCT {cols(group)}, applicant_id FROM applications WHERE {present(demand_needs(group))})
      GROUP BY {cols(group)}"""


def last_round_rows(group: list[str], number: str, where: str) -> str:
    return f"""SELECT * FROM (
        SELECT *, max(round) OVER (PARTITION BY {cols(group)}) AS highest
        FROM (SELECT *, {number} AS round FROM applications WHERE {where}))
      WHERE round = highest"""


def last_round(group: list[str], eligible: bool = False) -> str:
    where = present(demand_needs(group)) + (f" AND {ELIGIBLE}" if eligible else "")
    name = "eligible_last_round" if eligible else "applicants_last_round"
    return f"""SELECT {cols(group)}, count(DISTINCT applicant_id) AS {name}
      FROM ({last_round_rows(group, ALL_DIGITS, where)}) GROUP BY {cols(group)}"""


def first_rows(keys: list[str], needs: list[str], source: str = "applications") -> str:
    """The first row of each key among the rows that have everything in `needs`."""
    return f"""SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY {cols(keys)} ORDER BY {ORDER}) AS rn
        FROM {source} WHERE {present(needs)})
      WHERE rn = 1"""


def summed_first(group: list[str], value: str, name: str) -> str:
    keys = list(dict.fromkeys([*group, "residence"]))
    return f"""SELECT {cols(group)}, sum({value}) AS {name}
      FROM ({first_rows(keys, ["sector", value, "residence", "period"])}) GROUP BY {cols(group)}"""


def capacity(group: list[str]) -> str:
    return summed_first(group, "capacity", "capacity_total")


def offered(group: list[str]) -> str:
    return summed_first(group, "offered_total", "offered")


def chosen(sectors: list[str] | None) -> str:
    if sectors is None:
        return "sector IS NOT NULL"
    return f"lower(sector) IN ({', '.join(repr(s.lower()) for s in sectors)})"


def offered_period(sectors: list[str] | None = None) -> str:
    rows = f"(SELECT * FROM applications WHERE {chosen(sectors)})"
    return f"""SELECT period, sum(offered_total) AS offered
      FROM ({first_rows(RESIDENCE, ["offered_total", *RESIDENCE], rows)}) GROUP BY period"""


def leftover(group: list[str], strict: bool = False) -> str:
    needs = ["sector", "period", "leftover"] + (["residence"] if strict or "residence" in group else [])
    return f"""SELECT {cols(group)}, sum(leftover) AS leftover
      FROM (SELECT DISTINCT {cols(group)}, leftover FROM applications WHERE {present(needs)})
      GROUP BY {cols(group)}"""


def leftover_period(key: list[str], needs: list[str], sectors: list[str] | None = None) -> str:
    return f"""SELECT period, sum(leftover) AS leftover
      FROM (SELECT DISTINCT {cols(key)}, leftover FROM applications
            WHERE {present(["sector", "leftover", "period", *needs])} AND {chosen(sectors)})
      GROUP BY period"""


def leftover_chart(sectors: list[str] | None = None) -> str:
    return leftover_period(RESIDENCE, [], sectors)


def leftover_table(sectors: list[str] | None = None) -> str:
    return leftover_period(["period", "residence"], ["residence"], sectors)


def renewals(group: list[str]) -> str:
    keys = list(dict.fromkeys([*group, "residence"]))
    needs = ["sector", "capacity", "period"] + (["residence"] if "residence" in group else [])
    return f"""SELECT {cols(group)}, coalesce(sum(renewals_confirmed), 0.0::DOUBLE) AS renewals_confirmed
      FROM ({first_rows(keys, needs)}) GROUP BY {cols(group)}"""


RENEWALS_PERIOD = f"""SELECT period, coalesce(sum(renewals_confirmed), 0.0::DOUBLE) AS renewals_confirmed
  FROM (SELECT DISTINCT period, sector, residence, renewals_confirmed, capacity FROM applications
        WHERE {present(["sector", "capacity", "residence", "period"])}) GROUP BY period"""

COORDINATES = f"""SELECT period, sector, avg(latitude) AS latitude, avg(longitude) AS longitude
  FROM applications WHERE {present(["sector", "latitude", "longitude", "period"])} GROUP BY period, sector"""


def balance_demand(group: list[str]) -> str:
    where = present(["applicant_id", "round_label"] + (["residence"] if "residence" in group else []))
    return f"""SELECT {cols(group)}, round, count(DISTINCT applicant_id) AS applicants_last_round_any
      FROM ({last_round_rows(group, FIRST_DIGITS, where)}) GROUP BY {cols(group)}, round"""


LONG_ROUNDS = " UNION ALL ".join(
    f"SELECT *, {k}.0::DOUBLE AS round, offered_round_{k} AS places FROM applications" for k in (1, 2, 3, 4)
)


def round_places(group: list[str]) -> str:
    keys = list(dict.fromkeys([*group, "residence"]))
    return f"""SELECT {cols(group)}, round, sum(places_res) AS places
      FROM (SELECT {cols(keys)}, round, CASE WHEN count(places) = 0 THEN 0.0::DOUBLE ELSE max(places) END
              AS places_res
            FROM ({LONG_ROUNDS}) GROUP BY {cols(keys)}, round)
      GROUP BY {cols(group)}, round"""


def balance(group: list[str]) -> str:
    same = " AND ".join(f"d.{c} IS NOT DISTINCT FROM p.{c}" for c in [*group, "round"])
    return f"""SELECT {cols(["d." + c for c in group])}, d.applicants_last_round_any,
        d.applicants_last_round_any - p.places AS unplaced_last_round
      FROM ({balance_demand(group)}) d LEFT JOIN ({round_places(group)}) p ON {same}"""


def joined(group: list[str]) -> str:
    using = f"USING ({cols(group)})"
    located = "" if "residence" in group else f"LEFT JOIN ({COORDINATES}) {using}"
    return f"""SELECT * FROM ({applicants(group)})
      LEFT JOIN ({capacity(group)}) {using} LEFT JOIN ({offered(group)}) {using}
      LEFT JOIN ({last_round(group)}) {using} LEFT JOIN ({leftover(group)}) {using}
      LEFT JOIN ({last_round(group, True)}) {using} {located}"""


def concentrated(source: str) -> str:
    weighed = f"""SELECT *, weight / avg(weight) OVER (PARTITION BY period) AS relative
      FROM (SELECT *, CAST(applicants AS DOUBLE) / sum(applicants) OVER (PARTITION BY period) AS weight
            FROM ({source}))"""
    return f"""SELECT * EXCLUDE (weight, relative), {rounded("relative", 2)} AS concentration,
        {rounded("(weight * 100.0::DOUBLE)", 2)} AS concentration_pct FROM ({weighed})"""


def pressure(group: list[str]) -> str:
    located = "" if "residence" in group else "latitude, longitude,"
    return f"""SELECT {cols(group)}, applicants, capacity_total, offered, applicants_last_round, leftover,
        eligible_last_round, {located} {RAW} AS pressure_raw, {ADJUSTED} AS pressure_adjusted,
        concentration, concentration_pct
      FROM ({concentrated(joined(group))})"""


def renewal(group: list[str]) -> str:
    return f"""SELECT {cols(group)}, renewals_confirmed, capacity_total,
        {percent("renewals_confirmed", "capacity_total")} AS renewal_pct
      FROM ({renewals(group)}) LEFT JOIN ({capacity(group)}) USING ({cols(group)})"""


def reportable(group: list[str], sectors: list[str] | None = None, period: str | None = None) -> str:
    needs = ["sector", "offered_total", "applicant_id"] + (["residence"] if "residence" in group else [])
    when = "period IS NOT NULL" if period is None else f"period = '{period}'"
    return f"""SELECT {cols(group)}, count(*) AS distinct_applicants, sum(wishes)::BIGINT AS total_wishes
      FROM (SELECT {cols(group)}, applicant_id, count(*) AS wishes FROM applications
            WHERE {present(needs)} AND {chosen(sectors)} AND {when} GROUP BY {cols(group)}, applicant_id)
      GROUP BY {cols(group)}"""


def report(group: list[str], sectors: list[str] | None = None, period: str | None = None) -> str:
    using = f"USING ({cols(group)})"
    return f"""SELECT {cols(group)}, t.capacity_total, offered, leftover,
        {percent("leftover", "offered")} AS leftover_pct, applicants, applicants_last_round,
        unplaced_last_round, concentration_pct, pressure_raw, pressure_adjusted, renewals_confirmed,
        renewal_pct
      FROM ({reportable(group, sectors, period)}) LEFT JOIN ({pressure(group)}) t {using}
      LEFT JOIN ({renewal(group)}) {using} LEFT JOIN ({balance(group)}) {using}"""


def pairs_per_period(sectors: list[str] | None = None) -> str:
    return f"""SELECT period, count(*) AS applicants FROM (
        SELECT DISTINCT period, sector, applicant_id FROM applications
        WHERE {present(["period", "sector", "applicant_id"])} AND {chosen(sectors)}) GROUP BY period"""


def overview(sectors: list[str] | None = None) -> str:
    return f"""SELECT period, offered, applicants, leftover, applicants_last_round, eligible_last_round,
        {ADJUSTED} AS pressure_adjusted, {RAW} AS pressure_raw
      FROM ({offered_period(sectors)}) LEFT JOIN ({pairs_per_period(sectors)}) USING (period)
      LEFT JOIN ({leftover_chart(sectors)}) USING (period)
      LEFT JOIN ({last_round(["period"])}) USING (period)
      LEFT JOIN ({last_round(["period"], True)}) USING (period)"""


def yearly_table(sectors: list[str] | None = None) -> str:
    return f"""SELECT period, capacity_total, offered, leftover,
        {percent("leftover", "offered")} AS leftover_pct, applicants, applicants_last_round,
        {RAW} AS pressure_raw, {ADJUSTED} AS pressure_adjusted,
        {growth("offered", "offered_before")} AS offered_growth_pct,
        {growth("applicants", "applicants_before")} AS applicants_growth_pct,
        renewals_confirmed, {percent("renewals_confirmed", "capacity_total")} AS renewal_pct
      FROM (SELECT *, lag(offered) OVER (ORDER BY period) AS offered_before,
              lag(applicants) OVER (ORDER BY period) AS applicants_before
            FROM ({offered_period(sectors)}) LEFT JOIN ({capacity(["period"])}) USING (period)
            LEFT JOIN ({pairs_per_period(sectors)}) USING (period)
            LEFT JOIN ({last_round(["period"])}) USING (period)
            LEFT JOIN ({leftover_table(sectors)}) USING (period)
            LEFT JOIN ({RENEWALS_PERIOD}) USING (period)
            LEFT JOIN ({last_round(["period"], True)}) USING (period))"""


MEASURES = ["applicants", "applicants_last_round", "offered", "leftover"]

YEARLY_LONG = " UNION ALL ".join(
    f"SELECT period, '{m}' AS type, CAST({m} AS DOUBLE) AS value FROM ({overview()})" for m in MEASURES
)

DUAL_AXIS = f"""SELECT period, {ratio("(pressure_raw * max_y)", "max_ratio")} AS raw_scaled,
    {ratio("(pressure_adjusted * max_y)", "max_ratio")} AS adjusted_scaled, max_y, max_ratio
  FROM ({overview()}),
    (SELECT max(value) AS max_y FROM ({YEARLY_LONG})),
    (SELECT max(p) AS max_ratio FROM (SELECT pressure_raw AS p FROM ({overview()})
      UNION ALL SELECT pressure_adjusted FROM ({overview()})) WHERE NOT isnan(p))"""


def top_band(where: str = "sector IS NOT NULL") -> str:
    return f"""SELECT period, applicant_id, sector, scale_band FROM (
        SELECT *, row_number() OVER (PARTITION BY period, applicant_id
          ORDER BY TRY_CAST(scale_band AS DOUBLE) DESC NULLS LAST, {ORDER}) AS rn
        FROM applications
        WHERE {present(["applicant_id", "scale_band", "period", "sector"])} AND {where})
      WHERE rn = 1"""


def band_counts(where: str = "sector IS NOT NULL") -> str:
    return f"""SELECT period, sector, scale_band, count(*) AS applicants
      FROM ({top_band(where)}) GROUP BY period, sector, scale_band"""


def completed() -> str:
    return f"""SELECT s.period, s.sector, b.scale_band, coalesce(n.applicants, 0) AS applicants
      FROM (SELECT DISTINCT period, sector FROM ({band_counts()})) s
      JOIN (SELECT DISTINCT period, scale_band FROM ({band_counts()})) b ON s.period = b.period
      LEFT JOIN ({band_counts()}) n
        ON n.period = s.period AND n.sector = s.sector AND n.scale_band = b.scale_band"""


def pivoted(where: str = "sector IS NOT NULL") -> str:
    known = ", ".join(f"'{b}'" for b in BANDS)
    sums = ", ".join(
        f"coalesce(sum(applicants) FILTER (scale_band = '{b}'), 0)::BIGINT AS {c}" for b, c in BANDS.items()
    )
    return f"""SELECT period, sector, {sums},
        coalesce(sum(applicants) FILTER (scale_band NOT IN ({known})), 0)::BIGINT AS band_other
      FROM ({band_counts(where)}) GROUP BY period, sector"""


def sector_applicants(where: str = "sector IS NOT NULL") -> str:
    return f"""SELECT period, sector, count(DISTINCT applicant_id) AS sector_applicants FROM applications
      WHERE {present(["applicant_id", "sector", "period"])} AND {where} GROUP BY period, sector"""


def band_table(where: str = "sector IS NOT NULL", total: bool = True) -> str:
    names = [*BANDS.values(), "band_other"]
    plus = " + ".join(names)
    table = f"""SELECT period, sector, {cols(names)}, non_grant, {plus} + non_grant AS total
      FROM (SELECT *, greatest(sector_applicants - ({plus}), 0) AS non_grant
            FROM ({pivoted(where)}) LEFT JOIN ({sector_applicants(where)}) USING (period, sector))"""
    sums = ", ".join(f"sum({m})::BIGINT AS {m}" for m in [*names, "non_grant", "total"])
    added = f"{table} UNION ALL SELECT period, 'Total' AS sector, {sums} FROM ({table}) GROUP BY period"
    return added if total else table


def band_table_discovered() -> str:
    """The table with a column for each band that someone is credited with: here the known ones and the empty one."""
    names = {**BANDS, "": "band_blank"}
    sums = ", ".join(f"coalesce(sum(applicants) FILTER (scale_band = '{b}'), 0)::BIGINT AS {c}" for b, c in names.items())
    plus = " + ".join(names.values())
    table = f"""SELECT period, sector, {cols(list(names.values()))}, non_grant, {plus} + non_grant AS total
      FROM (SELECT *, greatest(sector_applicants - ({plus}), 0) AS non_grant
            FROM (SELECT period, sector, {sums} FROM ({band_counts()}) GROUP BY period, sector)
            LEFT JOIN ({sector_applicants()}) USING (period, sector))"""
    total = ", ".join(f"sum({m})::BIGINT AS {m}" for m in [*names.values(), "non_grant", "total"])
    return f"{table} UNION ALL SELECT period, 'Total' AS sector, {total} FROM ({table}) GROUP BY period"


def distribution(where: str = "sector IS NOT NULL") -> str:
    parts = f"""SELECT period, scale_band, applicants FROM ({band_counts(where)})
      UNION ALL SELECT period, 'Non-boursiers', non_grant FROM ({band_table(where, False)})"""
    counts = f"SELECT period, scale_band, sum(applicants)::BIGINT AS applicants FROM ({parts}) GROUP BY ALL"
    share = rounded("(100.0::DOUBLE * applicants / total)", 1)
    return f"""SELECT period, scale_band, applicants, {share} AS share_pct, total
      FROM (SELECT *, (sum(applicants) OVER (PARTITION BY period))::BIGINT AS total
            FROM ({counts}) WHERE applicants > 0)"""


def map_points(value: str, sectors: list[str] | None = None, period: str | None = None) -> str:
    when = "period IS NOT NULL" if period is None else f"period = '{period}'"
    return f"""SELECT period, sector, latitude, longitude, {value} AS value,
        {pressure_class(value)} AS pressure_class, {class_rank(value)} AS class_rank,
        sector || chr(10) || {number_text(value)} AS label
      FROM ({pressure(SECTOR)}) WHERE {chosen(sectors)} AND {when}"""


def area_points() -> str:
    sizes = f"({marker('pressure_raw')} + {marker('pressure_adjusted')})"
    east = f"longitude + 0.002::DOUBLE * {sizes} / (2.0::DOUBLE * cos(latitude * pi() / 180.0::DOUBLE))"
    south = f"latitude - 0.002::DOUBLE * {sizes} / 2.0::DOUBLE"
    source = f"({pressure(SECTOR)}) JOIN areas USING (sector)"
    points = f"""SELECT *, 'Brute' AS kind, pressure_raw AS value, latitude AS lat, longitude AS lon
        FROM {source}
      UNION ALL SELECT *, 'Réajustée' AS kind, pressure_adjusted AS value, {south} AS lat, {east} AS lon
        FROM {source}"""
    return f"""SELECT area, period, sector, kind, value, {pressure_class("value")} AS pressure_class,
        {class_rank("value")} AS class_rank, {marker("value")} AS size, lat AS latitude, lon AS longitude,
        sector || chr(10) || kind || chr(10) || {number_text("value")} AS label,
        lon >= xmin AND lon <= xmax AND lat >= ymin AND lat <= ymax AS in_frame
      FROM ({points})"""


def top_residences(period: str, sectors: list[str] | None = None) -> str:
    return f"""SELECT period, sector, residence, applicants, offered, pressure_raw,
        'Année : ' || period || ' <br>Résidence : ' || residence || ' <br>Places: ' || {number_text("offered")}
          || ' <br>Demandes: ' || CAST(applicants AS VARCHAR) || ' <br>Tension: '
          || {number_text("pressure_raw")} AS tooltip
      FROM ({pressure(RESIDENCE)}) WHERE period = '{period}' AND {chosen(sectors)}
      ORDER BY CASE WHEN isnan(pressure_raw) THEN NULL ELSE pressure_raw END DESC NULLS LAST,
        period, sector, residence
      LIMIT 10"""


def statement(body: str, areas: bool = False) -> str:
    tables = APPLICATIONS + ("," + AREAS if areas else "")
    return f"WITH {tables.strip()}\n{body}"
