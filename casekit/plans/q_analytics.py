"""Analytics queries: profiles and critical-rate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit.functions.labels import CRITICAL
from casekit.operators import profile as P
from casekit.operators import risk as R
from casekit.plans.oracle import cnt, cnt_if, with_ctes
from casekit.plans.registry import cases, feats, register
from casekit.sources.cases import CASE_COLUMNS

PROFILED = [c for c in CASE_COLUMNS if c != "case_id"]
KEY_MISSING_COLS = ["incident_address", "incident_zip", "latitude", "longitude", "location_type", "closed_ts"]
TEXT_FIELDS = ["descriptor", "location_type", "status", "resolution_description", "community_board"]
NUMERIC_PROFILED = ["incident_zip", "latitude", "longitude"]
SUPER_FLAGS = ["is_hour_2", "is_hour_5", "is_hour_0", "is_madrugada", "is_bronx", "is_brooklyn", "is_park",
               "is_subway", "is_street", "bronx_park", "park_madrugada", "bronx_madrugada", "has_coordinates"]


def _vc_sql(col: str, src: str = "feat", denom: str = "all") -> str:
    tot = (f"(SELECT count(*) FROM {src})" if denom == "all"
           else f"(SELECT count(*) FROM {src} WHERE {col} IS NOT NULL)")
    return with_ctes(f"SELECT {col}, {cnt()} AS n, {cnt()} * 100 / {tot} AS pct FROM {src} "
                     f"WHERE {col} IS NOT NULL GROUP BY {col}")


# ---- S2, S3 ---------------------------------------------------------------
@register("cases_shape", with_ctes(f"SELECT {cnt()} AS n_rows, CAST(17 AS BIGINT) AS n_cols FROM cases"))
def q_cases_shape(spark, sf):
    return P.table_shape(cases(spark, sf))


@register("cases_preview", with_ctes("SELECT * FROM cases ORDER BY case_id LIMIT 5"))
def q_cases_preview(spark, sf):
    return P.preview(cases(spark, sf), 5)


# ---- A1, A2, A16, F10 -----------------------------------------------------
@register("descriptor_counts", _vc_sql("descriptor"))
def q_descriptor_counts(spark, sf):
    return P.value_counts(feats(spark, sf), "descriptor")


@register("priority_counts", _vc_sql("priority"))
def q_priority_counts(spark, sf):
    return P.value_counts(feats(spark, sf), "priority")


@register("severity_counts", _vc_sql("severity"))
def q_severity_counts(spark, sf):
    return P.value_counts(feats(spark, sf), "severity")


@register("severity_group_counts", _vc_sql("severity_group"))
def q_severity_group_counts(spark, sf):
    return P.value_counts(feats(spark, sf), "severity_group")


@register("borough_counts_non_null", _vc_sql("borough", denom="non_null"))
def q_borough_counts(spark, sf):
    return P.value_counts(feats(spark, sf), "borough", denom="non_null")


@register("status_counts", _vc_sql("status"))
def q_status_counts(spark, sf):
    return P.value_counts(feats(spark, sf), "status")


@register("descriptor_imbalance", with_ctes(
    "SELECT max(n) AS n_max, min(n) AS n_min, CAST(count(*) AS BIGINT) AS n_classes, max(n) / min(n) AS ratio, "
    "CAST(max(n) / min(n) > 3 AS INTEGER) AS imbalanced FROM "
    f"(SELECT descriptor, {cnt()} AS n FROM feat WHERE descriptor IS NOT NULL GROUP BY descriptor)"))
def q_descriptor_imbalance(spark, sf):
    return P.imbalance_ratio(feats(spark, sf), "descriptor")


@register("distinct_severity_classes", with_ctes(
    "SELECT severity, (SELECT CAST(count(DISTINCT severity) AS BIGINT) FROM feat) AS n_classes "
    "FROM feat WHERE severity IS NOT NULL GROUP BY severity"))
def q_distinct_classes(spark, sf):
    return P.distinct_classes(feats(spark, sf), "severity")


@register("minority_descriptors", with_ctes(
    f"SELECT descriptor, n, pct FROM (SELECT descriptor, {cnt()} AS n, {cnt()} * 100 / (SELECT count(*) FROM feat) AS pct "
    "FROM feat WHERE descriptor IS NOT NULL GROUP BY descriptor) WHERE pct < 1.0"))
def q_minority(spark, sf):
    return P.minority_classes(feats(spark, sf), "descriptor", 0.01)


# ---- A9, A10, A11, A12, A13, A20, F6, F7, O7 --------------------------------
def _unpivot_sql(cols: list[str], select_per_col) -> str:
    return " UNION ALL ".join(select_per_col(c) for c in cols)


def _missing_sql(cols, only_missing=True, src="cases"):
    body = _unpivot_sql(cols, lambda c: f"SELECT '{c}' AS column, {cnt_if(f'{c} IS NULL')} AS n_missing, "
                                        f"{cnt_if(f'{c} IS NULL')} * 100 / count(*) AS pct_missing FROM {src}")
    return f"SELECT * FROM ({body})" + (" WHERE n_missing > 0" if only_missing else "")


@register("missing_profile", with_ctes(_missing_sql(PROFILED)))
def q_missing_profile(spark, sf):
    return P.missing_profile(cases(spark, sf), PROFILED)


_KIND = {"created_ts": "datetime", "closed_ts": "datetime", "incident_zip": "numeric", "latitude": "numeric",
         "longitude": "numeric"}


@register("column_profile_top10", with_ctes(
    "SELECT * FROM (" + _unpivot_sql(PROFILED, lambda c: (
        f"SELECT '{c}' AS column, {cnt_if(f'{c} IS NULL')} AS n_missing, {cnt_if(f'{c} IS NULL')} * 100 / count(*) "
        f"AS pct_missing, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, '{_KIND.get(c, 'categorical')}' AS kind "
        "FROM cases")) + ") ORDER BY pct_missing DESC, \"column\" LIMIT 10"))
def q_column_profile(spark, sf):
    return P.column_profile(cases(spark, sf), PROFILED, top=10)


@register("text_field_profile", with_ctes(_unpivot_sql(TEXT_FIELDS, lambda c: (
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"{cnt_if(f'{c} IS NULL')} * 100 / count(*) AS pct_missing FROM cases"))))
def q_text_field_profile(spark, sf):
    return P.text_field_profile(cases(spark, sf), TEXT_FIELDS)


@register("describe_numeric", with_ctes(_unpivot_sql(NUMERIC_PROFILED, lambda c: (
    f"SELECT '{c}' AS column, {cnt(c)} AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM cases"))))
def q_describe_numeric(spark, sf):
    d = P.describe_numeric(cases(spark, sf), NUMERIC_PROFILED)
    return d.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


@register("non_null_counts", with_ctes(_unpivot_sql(PROFILED, lambda c: (
    f"SELECT '{c}' AS column, {cnt(c)} AS n_non_null FROM cases"))))
def q_non_null_counts(spark, sf):
    return P.non_null_counts(cases(spark, sf), PROFILED)


SUPER_FEATURES = ["hour", "day_of_week", "month", "is_hour_2", "is_hour_5", "is_hour_0", "is_madrugada",
                  "is_bronx", "is_brooklyn", "is_park", "is_subway", "is_street", "bronx_park", "park_madrugada",
                  "bronx_madrugada", "has_coordinates"]
FEATURE_SET_16 = ["hour", "day_of_week", "month", "quarter", "is_weekend", "is_business_hours", "is_night",
                  "has_coordinates", "has_address", "zip_region", "incident_zip", "latitude", "longitude",
                  "resolution_hours", "borough", "location_type"]


@register("feature_missing_pct", with_ctes(_missing_sql(FEATURE_SET_16, only_missing=False, src="feat")))
def q_feature_missing_pct(spark, sf):
    return P.feature_missing_pct(feats(spark, sf), FEATURE_SET_16)


@register("candidate_features", with_ctes(
    "SELECT \"column\", pct_missing FROM (" + _missing_sql([c for c in PROFILED if c != "descriptor"], False)
    + ") WHERE pct_missing < 50 ORDER BY pct_missing, \"column\" LIMIT 15"))
def q_candidate_features(spark, sf):
    return P.candidate_features(cases(spark, sf).drop("case_id"), "descriptor")


# ---- A14, A15 ---------------------------------------------------------------
@register("monthly_counts", with_ctes(f"SELECT month, {cnt()} AS n FROM feat WHERE month IS NOT NULL GROUP BY month"))
def q_monthly_counts(spark, sf):
    return P.monthly_counts(feats(spark, sf))


@register("flag_totals", with_ctes(_unpivot_sql(SUPER_FLAGS, lambda c: (
    f"SELECT '{c}' AS flag, CAST(sum({c}) AS BIGINT) AS n FROM feat"))))
def q_flag_totals(spark, sf):
    return P.flag_totals(feats(spark, sf), SUPER_FLAGS)


# ---- A3, F5, O2, O4 ---------------------------------------------------------
def _rate_sql(key: str, min_total: int | None = None, top: int | None = None, order: str = "pct") -> str:
    inner = (f"SELECT {key}, {cnt_if("priority = 'CRITICO'")} AS n_critical, "
             f"{cnt_if("priority = 'NO_CRITICO'")} AS n_non_critical FROM feat "
             f"WHERE {key} IS NOT NULL AND priority IS NOT NULL GROUP BY {key}")
    q = (f"SELECT {key}, n_critical, n_non_critical, n_critical + n_non_critical AS total, "
         f"round_even(n_critical / (n_critical + n_non_critical) * 100, 1) AS pct_critical FROM ({inner})")
    if min_total is not None:
        q = f"SELECT * FROM ({q}) WHERE total >= {min_total}"
    if top:
        ob = f"pct_critical DESC, total DESC, {key}" if order == "pct" else f"total DESC, {key}"
        q = f"SELECT * FROM ({q}) ORDER BY {ob} LIMIT {top}"
    return with_ctes(q)


@register("critical_rate_by_borough", _rate_sql("borough"))
def q_rate_borough(spark, sf):
    return R.critical_rate_by(feats(spark, sf), "borough")


@register("critical_rate_by_location", _rate_sql("location_type", min_total=100, top=10))
def q_rate_location(spark, sf):
    return R.critical_rate_by(feats(spark, sf), "location_type", min_total=100, top=10)


@register("critical_rate_by_agency", _rate_sql("agency"))
def q_rate_agency(spark, sf):
    return R.critical_rate_by(feats(spark, sf), "agency", order="total")


@register("critical_rate_by_season", _rate_sql("season"))
def q_rate_season(spark, sf):
    return R.critical_rate_by(feats(spark, sf), "season")


@register("top8_critical_locations", _rate_sql("location_type", min_total=100, top=8))
def q_top8_locations(spark, sf):
    return R.critical_rate_by(feats(spark, sf), "location_type", min_total=100, top=8)


# ---- A4, J2, O1, O3 ---------------------------------------------------------
_HOUR_COUNTS = (f"SELECT hour, {cnt_if("priority = 'CRITICO'")} AS n_critical, "
                f"{cnt_if("priority = 'NO_CRITICO'")} AS n_non_critical FROM feat "
                "WHERE hour IS NOT NULL AND priority IS NOT NULL GROUP BY hour")
_HOUR_RATE = (f"SELECT hour, n_critical, n_non_critical, n_critical + n_non_critical AS total, "
              "CASE WHEN n_critical = 0 OR n_non_critical = 0 THEN 0.0 "
              f"ELSE n_critical / (n_critical + n_non_critical) * 100 END AS pct_critical FROM ({_HOUR_COUNTS})")


@register("critical_rate_by_hour", with_ctes(_HOUR_RATE))
def q_rate_hour(spark, sf):
    return R.critical_rate_by_hour(feats(spark, sf))


@register("top_critical_hours", with_ctes(f"SELECT * FROM ({_HOUR_RATE}) ORDER BY pct_critical DESC, hour LIMIT 5"))
def q_top_hours(spark, sf):
    return R.top_critical_hours(feats(spark, sf), 5)


@register("hour_comparison", with_ctes(
    f"SELECT coalesce(c.hour, n.hour) AS hour, coalesce(c.n_critical, 0) AS n_critical, "
    f"coalesce(n.n_non_critical, 0) AS n_non_critical FROM "
    f"(SELECT hour, {cnt()} AS n_critical FROM feat WHERE priority = 'CRITICO' AND hour IS NOT NULL GROUP BY hour) c "
    f"FULL OUTER JOIN (SELECT hour, {cnt()} AS n_non_critical FROM feat WHERE priority = 'NO_CRITICO' "
    "AND hour IS NOT NULL GROUP BY hour) n ON c.hour = n.hour"))
def q_hour_comparison(spark, sf):
    f = feats(spark, sf).where(F.col("hour").isNotNull())
    crit = f.where(F.col("priority") == CRITICAL).groupBy("hour").agg(F.count(F.lit(1)).alias("n_critical"))
    non = f.where(F.col("priority") == "NO_CRITICO").groupBy("hour").agg(F.count(F.lit(1)).alias("n_non_critical"))
    return R.outer_combine(crit, non, "hour", 0)


@register("top_critical_locations", with_ctes(
    f"SELECT location_type, {cnt()} AS n FROM feat WHERE priority = 'CRITICO' AND location_type IS NOT NULL "
    "GROUP BY location_type ORDER BY n DESC, location_type LIMIT 3"))
def q_top_crit_locations(spark, sf):
    return R.top_values_in_class(feats(spark, sf), "location_type", k=3)


# ---- A5, A6, A7, A8 ---------------------------------------------------------
@register("resolution_rate_by_class", with_ctes(
    f"SELECT priority, {cnt()} AS total_cases, {cnt_if('closed_ts IS NOT NULL')} AS resolved_cases, "
    "round_even(avg(CAST(closed_ts IS NOT NULL AS DOUBLE)) * 100, 1) AS resolution_rate "
    "FROM feat WHERE priority IS NOT NULL GROUP BY priority"))
def q_resolution_rate(spark, sf):
    return R.resolution_rate_by_class(feats(spark, sf))


@register("resolution_time_describe", with_ctes(
    f"SELECT priority, {cnt('resolution_hours')} AS count, round(avg(resolution_hours), 6) AS mean, "
    "round(stddev_samp(resolution_hours), 6) AS std, quantile_cont(resolution_hours, 0.5) AS p50, "
    "quantile_cont(resolution_hours, 0.75) AS p75, max(resolution_hours) AS max "
    "FROM feat WHERE closed_ts IS NOT NULL AND priority IS NOT NULL GROUP BY priority"))
def q_resolution_time(spark, sf):
    d = R.resolution_time_describe(feats(spark, sf))
    return d.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@register("coordinate_stats_by_class", with_ctes(
    f"SELECT priority, {cnt()} AS n, {cnt_if('latitude IS NOT NULL AND longitude IS NOT NULL')} AS n_with_coords, "
    "round(avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN latitude END), 6) AS lat_mean, "
    "round(stddev_samp(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN latitude END), 6) AS lat_std, "
    "round(avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN longitude END), 6) AS lon_mean, "
    "round(stddev_samp(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN longitude END), 6) AS lon_std, "
    f"{cnt_if('latitude IS NOT NULL AND longitude IS NOT NULL')} / count(*) * 100 AS pct_with_coords "
    "FROM feat WHERE priority IS NOT NULL GROUP BY priority"))
def q_coordinate_stats(spark, sf):
    d = R.coordinate_stats_by_class(feats(spark, sf))
    return d.withColumns({c: F.round(c, 6) for c in ("lat_mean", "lat_std", "lon_mean", "lon_std")})


def _missing_by_class_sql(cols):
    body = _unpivot_sql(cols, lambda c: (
        f"SELECT '{c}' AS column, {cnt_if(f"priority = 'CRITICO' AND {c} IS NULL")} AS critical_missing, "
        f"{cnt_if(f"priority = 'NO_CRITICO' AND {c} IS NULL")} AS non_critical_missing, "
        f"{cnt_if("priority = 'CRITICO'")} AS nc, {cnt_if("priority = 'NO_CRITICO'")} AS nn FROM feat"))
    return ("SELECT \"column\", critical_missing, round_even(critical_missing / nc * 100, 2) AS critical_pct, "
            "non_critical_missing, round_even(non_critical_missing / nn * 100, 2) AS non_critical_pct, "
            "round_even(critical_missing / nc * 100 - non_critical_missing / nn * 100, 2) AS difference "
            f"FROM ({body})")


@register("missing_by_class", with_ctes(_missing_by_class_sql(KEY_MISSING_COLS)))
def q_missing_by_class(spark, sf):
    return R.missing_by_class(feats(spark, sf), KEY_MISSING_COLS)


# ---- F2 ---------------------------------------------------------------------
@register("severity_groups_known", with_ctes(
    f"SELECT severity_group, {cnt()} AS n, {cnt()} * 100 / (SELECT count(*) FROM feat WHERE severity_group <> 'UNKNOWN') "
    "AS pct FROM feat WHERE severity_group <> 'UNKNOWN' GROUP BY severity_group"))
def q_severity_known(spark, sf):
    """drop the UNKNOWN group, then class shares of the remaining rows."""
    f = feats(spark, sf).where(F.col("severity_group") != "UNKNOWN")
    return P.value_counts(f, "severity_group")
