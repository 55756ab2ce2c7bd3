"""Feature queries: time (T1-T19), place and interactions (G1-G10), encodings
(G11/J1, P5) and feature-set projection (G12, F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit.functions import time as T
from casekit.operators import encode as E
from casekit.plans.features import BOROUGH_FLAGS, INTERACTIONS, LOCATION_FLAGS
from casekit.plans.oracle import with_ctes
from casekit.plans.registry import cases, feats, register

TIME_COLS = ["hour", "day_of_week", "month", "quarter", "is_weekend", "is_business_hours", "is_evening", "is_night",
             "is_late_night", "is_madrugada", "is_early_morning", "is_early_0_8", "is_hour_0", "is_hour_2",
             "is_hour_5", "is_hour_7", "is_hour_20", "is_high_risk_hours", "is_weekend_madrugada",
             "is_weekday_evening", "season", "is_high_risk_season", "resolution_hours", "resolution_days",
             "has_resolution", "fast_resolution_24", "fast_resolution_4"]
PLACE_COLS = (["has_coordinates", "has_address", "has_zip", "has_street", "has_cross_streets", "zip_region",
               "zip_district", "is_nypd", "is_closed", "is_high_risk_borough", "is_high_risk_location",
               "is_high_risk_location_3", "is_high_latitude", "is_central_latitude"]
              + list(BOROUGH_FLAGS) + list(LOCATION_FLAGS))
INTERACTION_COLS = list(INTERACTIONS)
SUPER_FEATURES = ["hour", "day_of_week", "month", "is_hour_2", "is_hour_5", "is_hour_0", "is_madrugada",
                  "is_bronx", "is_brooklyn", "is_park", "is_subway", "is_street", "bronx_park", "park_madrugada",
                  "bronx_madrugada", "has_coordinates"]


@register("time_features", with_ctes(
    "SELECT case_id, " + ", ".join(TIME_COLS) + ", CAST(0 AS INTEGER) AS is_night_between FROM feat"))
def q_time_features(spark, sf):
    f = feats(spark, sf)
    return f.select("case_id", *TIME_COLS, T.hour_in_range("hour", 22, 6, wrap=False).alias("is_night_between"))


_TS_FMT_SPARK = "MM/dd/yyyy hh:mm:ss a"
_TS_FMT_DUCK = "%m/%d/%Y %I:%M:%S %p"


@register("parse_timestamps", with_ctes(
    "SELECT case_id, txt, try_strptime(txt, '" + _TS_FMT_DUCK + "') AS parsed FROM ("
    "SELECT case_id, CASE WHEN case_id % 13 = 0 THEN 'not a date' "
    "ELSE strftime(created_ts, '" + _TS_FMT_DUCK + "') END AS txt FROM cases)"))
def q_parse_timestamps(spark, sf):
    """Text timestamps (as in the complaint file) parsed back; junk -> NULL."""
    c = cases(spark, sf)
    txt = F.when(F.col("case_id") % 13 == 0, F.lit("not a date")).otherwise(
        F.date_format("created_ts", _TS_FMT_SPARK))
    return c.select("case_id", txt.alias("txt")).withColumn("parsed", T.parse_ts("txt", _TS_FMT_SPARK))


@register("place_features", with_ctes("SELECT case_id, " + ", ".join(PLACE_COLS) + " FROM feat"))
def q_place_features(spark, sf):
    return feats(spark, sf).select("case_id", *PLACE_COLS)


@register("interaction_features", with_ctes("SELECT case_id, " + ", ".join(INTERACTION_COLS) + " FROM feat"))
def q_interactions(spark, sf):
    return feats(spark, sf).select("case_id", *INTERACTION_COLS)


@register("frequency_encoding", with_ctes(
    "SELECT case_id, borough, location_type, agency, "
    "CASE WHEN borough IS NOT NULL THEN (SELECT CAST(count(*) AS BIGINT) FROM cases c2 "
    "WHERE c2.borough = c.borough) END AS borough_freq, "
    "coalesce((SELECT CAST(count(*) AS BIGINT) FROM cases c3 WHERE c3.location_type = c.location_type), 0) "
    "AS location_type_freq, "
    "(SELECT CAST(count(*) AS BIGINT) FROM cases c4 WHERE c4.agency = c.agency) AS agency_freq FROM cases c"))
def q_frequency_encoding(spark, sf):
    c = cases(spark, sf).select("case_id", "borough", "location_type", "agency")
    c = E.frequency_encode(c, "borough", "borough_freq")
    c = E.frequency_encode(c, "location_type", "location_type_freq", null_value=0)
    return E.frequency_encode(c, "agency", "agency_freq")


@register("label_encoding", with_ctes(
    "SELECT case_id, borough, CAST(dense_rank() OVER (ORDER BY coalesce(borough, 'nan')) - 1 AS INTEGER) "
    "AS borough_code FROM cases"))
def q_label_encoding(spark, sf):
    return E.label_encode(cases(spark, sf).select("case_id", "borough"), "borough", "borough_code")


@register("super_feature_set", with_ctes(
    "SELECT case_id, " + ", ".join(SUPER_FEATURES) + ", priority FROM feat WHERE priority IS NOT NULL"))
def q_super_feature_set(spark, sf):
    return E.select_features(feats(spark, sf), SUPER_FEATURES, "priority")
