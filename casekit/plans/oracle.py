"""DuckDB oracle SQL building blocks.

``with_ctes(body)`` prefixes a query with ``cases`` (FIXTURES.md §2) and
``feat`` (the same labels and features as ``plans.features.case_features``),
written independently in DuckDB's dialect (FIXTURES.md §3 pairs).
"""

from __future__ import annotations

from casekit.sources.cases import cases_sql_duckdb


def _in(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


CRIT = ["Tortured", "Chained"]
NONCRIT = ["Neglected", "No Shelter", "In Car", "Noise, Barking Dog (NR5)", "Other (complaint details)"]
MOD = ["Neglected", "No Shelter"]
LEVE = ["In Car", "Noise, Barking Dog (NR5)", "Other (complaint details)"]


def _flag(pred: str) -> str:
    return f"CAST(coalesce({pred}, false) AS INTEGER)"


FEATURES_SQL = f"""
feat0 AS (
  SELECT *,
    CASE WHEN descriptor IN ({_in(CRIT)}) THEN 'CRITICO' WHEN descriptor IN ({_in(NONCRIT)}) THEN 'NO_CRITICO' END AS priority,
    CASE WHEN descriptor IN ({_in(CRIT)}) THEN 'SEVERO' WHEN descriptor IN ({_in(MOD)}) THEN 'MODERADO'
         WHEN descriptor IN ({_in(LEVE)}) THEN 'LEVE' END AS severity,
    CASE WHEN descriptor IN ({_in(CRIT)}) THEN 'SEVERO' WHEN descriptor IN ({_in(MOD)}) THEN 'MODERADO'
         WHEN descriptor IN ({_in(LEVE)}) THEN 'LEVE' ELSE 'UNKNOWN' END AS severity_group,
    CAST(hour(created_ts) AS INTEGER) AS hour,
    CAST(isodow(created_ts) - 1 AS INTEGER) AS day_of_week,
    CAST(month(created_ts) AS INTEGER) AS month,
    CAST(quarter(created_ts) AS INTEGER) AS quarter,
    (epoch_us(closed_ts) - epoch_us(created_ts)) / 3.6e9 AS resolution_hours
  FROM cases),
feat1 AS (
  SELECT *,
    {_flag("day_of_week IN (5, 6)")} AS is_weekend,
    {_flag("hour BETWEEN 9 AND 17")} AS is_business_hours,
    {_flag("hour BETWEEN 18 AND 22")} AS is_evening,
    {_flag("hour >= 22 OR hour <= 6")} AS is_night,
    {_flag("hour >= 23 OR hour <= 6")} AS is_late_night,
    {_flag("hour BETWEEN 0 AND 6")} AS is_madrugada,
    {_flag("hour BETWEEN 5 AND 9")} AS is_early_morning,
    {_flag("hour BETWEEN 0 AND 8")} AS is_early_0_8,
    {_flag("hour = 0")} AS is_hour_0,
    {_flag("hour = 2")} AS is_hour_2,
    {_flag("hour = 5")} AS is_hour_5,
    {_flag("hour = 7")} AS is_hour_7,
    {_flag("hour = 20")} AS is_hour_20,
    {_flag("hour IN (0, 2, 5, 7, 20)")} AS is_high_risk_hours,
    {_flag("day_of_week IN (5, 6) AND hour BETWEEN 0 AND 6")} AS is_weekend_madrugada,
    {_flag("day_of_week IN (0, 1, 2, 3, 4) AND hour BETWEEN 18 AND 22")} AS is_weekday_evening,
    CASE WHEN month IN (12, 1, 2) THEN 'Invierno' WHEN month IN (3, 4, 5) THEN 'Primavera'
         WHEN month IN (6, 7, 8) THEN 'Verano' WHEN month IN (9, 10, 11) THEN 'Otoño' END AS season,
    resolution_hours / 24.0 AS resolution_days,
    CAST(closed_ts IS NOT NULL AS INTEGER) AS has_resolution,
    {_flag("resolution_hours <= 24")} AS fast_resolution_24,
    {_flag("resolution_hours <= 4")} AS fast_resolution_4,
    CAST(latitude IS NOT NULL AS INTEGER) AS has_coordinates,
    CAST(incident_address IS NOT NULL AS INTEGER) AS has_address,
    CAST(incident_zip IS NOT NULL AS INTEGER) AS has_zip,
    CAST(street_name IS NOT NULL AS INTEGER) AS has_street,
    CAST(cross_street_1 IS NOT NULL AND cross_street_2 IS NOT NULL AS INTEGER) AS has_cross_streets,
    CAST(floor(coalesce(incident_zip, 0.0) / 100) AS BIGINT) AS zip_region,
    CAST(floor(coalesce(incident_zip, 11000.0) / 10) AS BIGINT) AS zip_district,
    {_flag("agency = 'NYPD'")} AS is_nypd,
    {_flag("status = 'Closed'")} AS is_closed,
    {_flag("borough IN ('BRONX', 'BROOKLYN')")} AS is_high_risk_borough,
    {_flag("location_type IN ('Park/Playground', 'Subway Station', 'Street/Sidewalk', 'Store/Commercial')")} AS is_high_risk_location,
    {_flag("location_type IN ('Park/Playground', 'Subway Station', 'Street/Sidewalk')")} AS is_high_risk_location_3,
    {_flag("latitude > 40.7318")} AS is_high_latitude,
    {_flag("latitude BETWEEN 40.65 AND 40.8")} AS is_central_latitude,
    {_flag("borough = 'BRONX'")} AS is_bronx,
    {_flag("borough = 'BROOKLYN'")} AS is_brooklyn,
    {_flag("borough = 'MANHATTAN'")} AS is_manhattan,
    {_flag("borough = 'QUEENS'")} AS is_queens,
    {_flag("borough = 'STATEN ISLAND'")} AS is_staten_island,
    {_flag("location_type = 'Park/Playground'")} AS is_park,
    {_flag("location_type = 'Subway Station'")} AS is_subway,
    {_flag("location_type = 'Street/Sidewalk'")} AS is_street,
    {_flag("location_type = 'Store/Commercial'")} AS is_store,
    {_flag("location_type = 'Residential Building/House'")} AS is_residential
  FROM feat0),
feat AS (
  SELECT *,
    {_flag("season IN ('Otoño', 'Verano')")} AS is_high_risk_season,
    is_bronx * is_park AS bronx_park,
    is_bronx * is_street AS bronx_street,
    is_bronx * is_madrugada AS bronx_madrugada,
    is_park * is_madrugada AS park_madrugada,
    is_park * is_high_risk_hours AS park_high_risk_hours,
    is_brooklyn * is_street AS brooklyn_street,
    is_brooklyn * is_madrugada AS brooklyn_madrugada,
    is_high_risk_borough * is_high_risk_location AS high_risk_borough_location
  FROM feat1)
"""


def with_ctes(body: str, extra: str = "") -> str:
    """``WITH cases AS (...), feat... [, extra] <body>``."""
    ctes = f"WITH cases AS ({cases_sql_duckdb()}),\n{FEATURES_SQL}"
    if extra:
        ctes += ",\n" + extra
    return ctes + "\n" + body


def cnt(expr: str = "*") -> str:
    return f"CAST(count({expr}) AS BIGINT)"


def cnt_if(pred: str) -> str:
    return f"CAST(count_if({pred}) AS BIGINT)"
