"""Split, rebalancing, weights and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit.operators import encode as E
from casekit.operators import prep as PR
from casekit.operators import sampling as S
from casekit.plans.oracle import with_ctes
from casekit.plans.registry import feats, register

SEED = 42
NUM_FEATURES = ["hour", "day_of_week", "month", "incident_zip", "latitude", "longitude", "resolution_hours"]
CAT_FEATURES = ["borough", "location_type", "agency", "status"]
ANOVA_FEATURES = ["hour", "day_of_week", "month", "quarter", "is_weekend", "is_business_hours", "is_night",
                  "has_coordinates", "has_address", "zip_region", "latitude", "longitude", "is_park", "is_bronx",
                  "is_madrugada", "resolution_hours", "borough_code"]


def _rank_sql(label: str, src: str = "feat") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST(case_id AS VARCHAR) || ':{SEED}'), "
            f"case_id) AS class_rank, count(*) OVER (PARTITION BY {label}) AS class_n "
            f"FROM {src} WHERE {label} IS NOT NULL")


def _split_cte(label: str, name: str = "split", src: str = "feat") -> str:
    return (f"{name} AS (SELECT * EXCLUDE (class_rank, class_n), CASE WHEN class_rank <= floor(class_n * 0.2 + 0.5) "
            f"THEN 'test' ELSE 'train' END AS split FROM ({_rank_sql(label, src)}))")


def _split(spark, sf, label="priority"):
    return S.stratified_split(feats(spark, sf), label, 0.2, SEED)


# ---- B1, B2, B3 -------------------------------------------------------------
@register("stratified_split", with_ctes("SELECT case_id, priority, split FROM split", _split_cte("priority")))
def q_split(spark, sf):
    return _split(spark, sf).select("case_id", "priority", "split")


@register("split_sizes_descriptor", with_ctes(
    "SELECT descriptor, split, CAST(count(*) AS BIGINT) AS n FROM split GROUP BY descriptor, split",
    _split_cte("descriptor")))
def q_split_sizes(spark, sf):
    return (_split(spark, sf, "descriptor").groupBy("descriptor", "split")
            .agg(F.count(F.lit(1)).alias("n")))


@register("stratified_kfold", with_ctes(
    f"SELECT case_id, severity, CAST((class_rank - 1) % 5 AS INTEGER) AS fold FROM ({_rank_sql('severity')})"))
def q_kfold(spark, sf):
    return S.stratified_kfold(feats(spark, sf), "severity", 5, SEED).select("case_id", "severity", "fold")


@register("random_undersample", with_ctes(
    f"SELECT case_id, priority FROM ({_rank_sql('priority')}) "
    "WHERE class_rank <= (SELECT min(c) FROM (SELECT count(*) AS c FROM feat WHERE priority IS NOT NULL "
    "GROUP BY priority))"))
def q_undersample(spark, sf):
    return S.random_undersample(feats(spark, sf), "priority", SEED).select("case_id", "priority")


@register("random_oversample", with_ctes(
    "SELECT case_id, descriptor, CAST(g.copy AS INTEGER) AS copy FROM ("
    f"SELECT *, CAST(floor(m / class_n) + CASE WHEN class_rank <= m % class_n THEN 1 ELSE 0 END AS INTEGER) AS copies "
    f"FROM ({_rank_sql('descriptor')}), (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM feat "
    "WHERE descriptor IS NOT NULL GROUP BY descriptor))) r, LATERAL generate_series(1, r.copies) AS g(copy)"))
def q_oversample(spark, sf):
    return S.random_oversample(feats(spark, sf), "descriptor", SEED).select("case_id", "descriptor", "copy")


# ---- A17, A18, A19 ----------------------------------------------------------
def _weights_sql(label: str, w_expr: str) -> str:
    return with_ctes(
        f"SELECT {label}, n, CAST({w_expr} AS DOUBLE) AS weight FROM (SELECT {label}, CAST(count(*) AS BIGINT) AS n "
        f"FROM split WHERE split = 'train' GROUP BY {label}), "
        f"(SELECT count(*) AS tot, count(DISTINCT {label}) AS k FROM split WHERE split = 'train')",
        _split_cte(label))


def _train(spark, sf, label):
    return _split(spark, sf, label).where(F.col("split") == "train")


@register("class_weights_balanced", _weights_sql("descriptor", "tot / (k * n)"))
def q_weights_balanced(spark, sf):
    return S.class_weights(_train(spark, sf, "descriptor"), "descriptor", "balanced")


@register("class_weights_boosted", _weights_sql(
    "priority", "CASE WHEN priority = 'CRITICO' THEN tot / (k * n) * 2.0 ELSE tot / (k * n) END"))
def q_weights_boosted(spark, sf):
    return S.class_weights(_train(spark, sf, "priority"), "priority", "boosted", factor=2.0)


@register("class_weights_fixed", _weights_sql(
    "priority", "CASE WHEN priority = 'CRITICO' THEN 3.0 WHEN priority = 'NO_CRITICO' THEN 0.8 ELSE 1.0 END"))
def q_weights_fixed(spark, sf):
    return S.class_weights(_train(spark, sf, "priority"), "priority", "fixed", fixed={"CRITICO": 3.0, "NO_CRITICO": 0.8})


# ---- I1, I2, I3, I5 ---------------------------------------------------------
def _union(cols, f):
    return " UNION ALL ".join(f(c) for c in cols)


@register("impute_median_fit", with_ctes(_union(NUM_FEATURES, lambda c: (
    f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS value FROM split WHERE split = 'train'")),
    _split_cte("priority")))
def q_median_fit(spark, sf):
    return PR.fit_median(_train(spark, sf, "priority"), NUM_FEATURES)


@register("impute_mode_fit", with_ctes(_union(CAT_FEATURES, lambda c: (
    f"SELECT '{c}' AS feature, (SELECT {c} FROM split WHERE split = 'train' AND {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS value")), _split_cte("priority")))
def q_mode_fit(spark, sf):
    return PR.fit_mode(_train(spark, sf, "priority"), CAT_FEATURES)


@register("imputed_test_rows", with_ctes(
    "SELECT case_id, " + ", ".join(
        [f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM split "
         f"WHERE split = 'train')) AS {c}" for c in ["incident_zip", "latitude", "longitude", "resolution_hours"]]
        + [f"coalesce({c}, (SELECT {c} FROM split WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} "
           f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in ["borough", "location_type"]])
    + " FROM split WHERE split = 'test'", _split_cte("priority")))
def q_imputed_test(spark, sf):
    s = _split(spark, sf)
    num, cat = ["incident_zip", "latitude", "longitude", "resolution_hours"], ["borough", "location_type"]
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test").select("case_id", *num, *cat)
    test = PR.apply_fill(test, PR.fit_median(train, num))
    return PR.apply_fill(test, PR.fit_mode(train, cat))


@register("impute_constant", with_ctes(
    "SELECT case_id, coalesce(latitude, 0.0) AS latitude, coalesce(longitude, 0.0) AS longitude, "
    "coalesce(resolution_hours, 0.0) AS resolution_hours FROM feat"))
def q_impute_constant(spark, sf):
    return PR.fill_constant(feats(spark, sf).select("case_id", "latitude", "longitude", "resolution_hours"),
                            ["latitude", "longitude", "resolution_hours"], 0.0)


@register("standardize_fit", with_ctes(_union(NUM_FEATURES, lambda c: (
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"round(stddev_pop(CAST({c} AS DOUBLE)), 6) AS std FROM split WHERE split = 'train'")), _split_cte("priority")))
def q_standardize_fit(spark, sf):
    st = PR.fit_standard(_train(spark, sf, "priority"), NUM_FEATURES)
    return st.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("standardized_test_rows", with_ctes(
    "SELECT case_id, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM split WHERE split = 'train')) / "
        f"(SELECT CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END "
        f"FROM split WHERE split = 'train'), 4) AS {c}" for c in ["hour", "month", "latitude"])
    + " FROM split WHERE split = 'test'", _split_cte("priority")))
def q_standardized_test(spark, sf):
    s = _split(spark, sf)
    cols = ["hour", "month", "latitude"]
    st = PR.fit_standard(s.where(F.col("split") == "train"), cols)
    out = PR.apply_standard(s.where(F.col("split") == "test").select("case_id", *cols), st)
    return out.select("case_id", *[F.round(c, 4).alias(c) for c in cols])


# ---- I6 ---------------------------------------------------------------------
@register("one_hot_test_rows", with_ctes(
    "SELECT case_id, "
    "CAST(coalesce(borough = 'BROOKLYN', false) AS INTEGER) AS borough__BROOKLYN, "
    "CAST(coalesce(borough = 'MANHATTAN', false) AS INTEGER) AS borough__MANHATTAN, "
    "CAST(coalesce(borough = 'QUEENS', false) AS INTEGER) AS borough__QUEENS, "
    "CAST(coalesce(borough = 'STATEN ISLAND', false) AS INTEGER) AS borough__STATEN_ISLAND, "
    "CAST(coalesce(location_type = 'Residential Building/House', false) AS INTEGER) "
    "AS location_type__Residential_Building_House, "
    "CAST(coalesce(location_type = 'Store/Commercial', false) AS INTEGER) AS location_type__Store_Commercial, "
    "CAST(coalesce(location_type = 'Street/Sidewalk', false) AS INTEGER) AS location_type__Street_Sidewalk, "
    "CAST(coalesce(location_type = 'Subway Station', false) AS INTEGER) AS location_type__Subway_Station "
    "FROM split WHERE split = 'test'", _split_cte("priority")))
def q_one_hot(spark, sf):
    s = _split(spark, sf)
    vocab = E.fit_one_hot(s.where(F.col("split") == "train"), ["borough", "location_type"])
    return E.one_hot(s.where(F.col("split") == "test").select("case_id", "borough", "location_type"), vocab)


# ---- I9 ---------------------------------------------------------------------
def _anova_src(spark, sf):
    f = E.label_encode(feats(spark, sf), "borough", "borough_code")
    return f


def _anova_sql(top: int | None) -> str:
    medians = "SELECT " + ", ".join(f"median(CAST({c} AS DOUBLE)) AS med_{c}" for c in ANOVA_FEATURES) \
        + " FROM fb WHERE descriptor IS NOT NULL"
    filled = "SELECT descriptor, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), med_{c}) AS x_{c}" for c in ANOVA_FEATURES) \
        + " FROM fb, md WHERE descriptor IS NOT NULL"
    per_class = "SELECT descriptor, count(*) AS n, " + ", ".join(
        f"avg(x_{c}) AS m_{c}, var_pop(x_{c}) AS v_{c}" for c in ANOVA_FEATURES) + " FROM fl GROUP BY descriptor"
    per_feat = _union(ANOVA_FEATURES, lambda c: (
        f"SELECT '{c}' AS feature, sum(n) AS n, count(*) AS k, sum(n * v_{c}) AS ssw, "
        f"sum(n * (m_{c} - (SELECT avg(x_{c}) FROM fl)) ** 2) AS ssb FROM pc"))
    f = ("SELECT feature, CASE WHEN ssw > 0 AND k > 1 THEN round((ssb / (k - 1)) / (ssw / (n - k)), 4) "
         "END AS f_score FROM pf")
    if top:
        f = f"SELECT * FROM ({f}) ORDER BY f_score DESC NULLS LAST, feature LIMIT {top}"
    extra = ("fb AS (SELECT *, CAST(dense_rank() OVER (ORDER BY coalesce(borough, 'nan')) - 1 AS INTEGER) "
             f"AS borough_code FROM feat), md AS ({medians}), fl AS ({filled}), pc AS ({per_class}), pf AS ({per_feat})")
    return with_ctes(f, extra)


@register("anova_f_scores", _anova_sql(None))
def q_anova(spark, sf):
    sc = PR.f_classif(_anova_src(spark, sf), ANOVA_FEATURES, "descriptor")
    return sc.select("feature", F.round("f_score", 4).alias("f_score"))


@register("select_k_best", _anova_sql(12))
def q_kbest(spark, sf):
    sc = PR.f_classif(_anova_src(spark, sf), ANOVA_FEATURES, "descriptor")
    return PR.select_k_best(sc.select("feature", F.round("f_score", 4).alias("f_score")), 12)
