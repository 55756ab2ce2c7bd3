"""The wide feature table: every derived label, time, place and interaction
column (P1-P4, T2-T19, G1-G10) added in one projection over the case table.

It is a single narrow ``select``: no shuffle, codegen'd, and Catalyst prunes
every column a downstream query does not read (including the lineitem join
behind ``closed_ts`` when no resolution feature is used).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.functions import labels as L
from casekit.functions import place as G
from casekit.functions import time as T


def with_labels(df: DataFrame, descriptor: str = "descriptor") -> DataFrame:
    return df.withColumns({
        "priority": L.binary_priority(descriptor),
        "severity": L.severity(descriptor),
        "severity_group": L.severity_group(descriptor),
    })


def with_time_features(df: DataFrame, created: str = "created_ts", closed: str | None = "closed_ts",
                       wrap_night: bool = True) -> DataFrame:
    h, d = F.col("hour"), F.col("day_of_week")
    df = df.withColumns({
        "hour": T.hour(created),
        "day_of_week": T.day_of_week(created),
        "month": T.month(created),
        "quarter": T.quarter(created),
    })
    cols = {
        "is_weekend": T.is_weekend(d),
        "is_business_hours": T.hour_in_range(h, 9, 17),
        "is_evening": T.hour_in_range(h, 18, 22),
        "is_night": T.hour_in_range(h, 22, 6, wrap=wrap_night),
        "is_late_night": T.hour_in_range(h, 23, 6, wrap=wrap_night),
        "is_madrugada": T.hour_in_range(h, 0, 6),
        "is_early_morning": T.hour_in_range(h, 5, 9),
        "is_early_0_8": T.hour_in_range(h, 0, 8),
        "is_hour_0": T.hour_is(h, 0),
        "is_hour_2": T.hour_is(h, 2),
        "is_hour_5": T.hour_is(h, 5),
        "is_hour_7": T.hour_is(h, 7),
        "is_hour_20": T.hour_is(h, 20),
        "is_high_risk_hours": T.hour_in_set(h, G.HIGH_RISK_HOURS),
        "is_weekend_madrugada": T.weekend_early(d, h),
        "is_weekday_evening": T.weekday_evening(d, h),
        "season": L.season(F.col("month")),
    }
    df = df.withColumns(cols).withColumn("is_high_risk_season", L.is_high_risk_season("season"))
    if closed:
        df = df.withColumn("resolution_hours", T.resolution_hours(created, closed))
        df = df.withColumns({
            "resolution_days": T.resolution_days("resolution_hours"),
            "has_resolution": T.has_value(closed),
            "fast_resolution_24": T.fast_resolution("resolution_hours", 24),
            "fast_resolution_4": T.fast_resolution("resolution_hours", 4),
        })
    return df


BOROUGH_FLAGS = {"is_bronx": "BRONX", "is_brooklyn": "BROOKLYN", "is_manhattan": "MANHATTAN",
                 "is_queens": "QUEENS", "is_staten_island": "STATEN ISLAND"}
LOCATION_FLAGS = {"is_park": "Park/Playground", "is_subway": "Subway Station", "is_street": "Street/Sidewalk",
                  "is_store": "Store/Commercial", "is_residential": "Residential Building/House"}


def with_place_features(df: DataFrame) -> DataFrame:
    cols = {
        "has_coordinates": G.present("latitude"),
        "has_address": G.present("incident_address"),
        "has_zip": G.present("incident_zip"),
        "has_street": G.present("street_name"),
        "has_cross_streets": G.both_present("cross_street_1", "cross_street_2"),
        "zip_region": G.zip_region("incident_zip", G.ZIP_FILL_ZERO),
        "zip_district": G.zip_district("incident_zip", G.ZIP_FILL_CITY),
        "is_nypd": G.equals_flag("agency", "NYPD"),
        "is_closed": G.equals_flag("status", "Closed"),
        "is_high_risk_borough": G.in_set_flag("borough", G.HIGH_RISK_BOROUGHS),
        "is_high_risk_location": G.in_set_flag("location_type", G.HIGH_RISK_LOCATIONS_4),
        "is_high_risk_location_3": G.in_set_flag("location_type", G.HIGH_RISK_LOCATIONS_3),
        "is_high_latitude": G.above_flag("latitude"),
        "is_central_latitude": G.between_flag("latitude"),
    }
    cols.update({k: G.equals_flag("borough", v) for k, v in BOROUGH_FLAGS.items()})
    cols.update({k: G.equals_flag("location_type", v) for k, v in LOCATION_FLAGS.items()})
    return df.withColumns(cols)


INTERACTIONS = {
    "bronx_park": ("is_bronx", "is_park"),
    "bronx_street": ("is_bronx", "is_street"),
    "bronx_madrugada": ("is_bronx", "is_madrugada"),
    "park_madrugada": ("is_park", "is_madrugada"),
    "park_high_risk_hours": ("is_park", "is_high_risk_hours"),
    "brooklyn_street": ("is_brooklyn", "is_street"),
    "brooklyn_madrugada": ("is_brooklyn", "is_madrugada"),
    "high_risk_borough_location": ("is_high_risk_borough", "is_high_risk_location"),
}


def with_interactions(df: DataFrame, pairs: dict | None = None) -> DataFrame:
    return df.withColumns({k: G.interaction(a, b) for k, (a, b) in (pairs or INTERACTIONS).items()})


def case_features(df: DataFrame, wrap_night: bool = True) -> DataFrame:
    """Case table -> case table + labels + all derived features."""
    closed = "closed_ts" if "closed_ts" in df.columns else None
    out = with_labels(df)
    out = with_time_features(out, closed=closed, wrap_night=wrap_night)
    out = with_place_features(out)
    return with_interactions(out)
