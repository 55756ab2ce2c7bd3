"""Edge cases of SURVEY §1.1 (N1-N20) on literal fixtures."""
import datetime as dt

from pyspark.sql import functions as F

from casekit.functions import labels as L
from casekit.functions import place as G
from casekit.functions import time as T
from casekit.operators import encode as E
from casekit.operators import profile as P
from casekit.operators import risk as R


def test_flags_null_is_zero(spark):  # N1
    df = spark.createDataFrame([(None,), (3,), (23,)], "h INT")
    out = df.select(T.hour_in_range("h", 0, 6).alias("a"), T.hour_is("h", 3).alias("b"),
                    T.hour_in_set("h", [3]).alias("c")).collect()
    assert [tuple(r) for r in out] == [(0, 0, 0), (1, 1, 1), (0, 0, 0)]


def test_night_wrap_and_pandas_between(spark):  # N11
    df = spark.createDataFrame([(h,) for h in range(24)], "h INT")
    wrap = [r[0] for r in df.select(T.hour_in_range("h", 22, 6)).collect()]
    assert wrap == [1] * 7 + [0] * 15 + [1] * 2
    nowrap = [r[0] for r in df.select(T.hour_in_range("h", 22, 6, wrap=False)).collect()]
    assert nowrap == [0] * 24


def test_weekday_monday_zero(spark):  # N5
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5),), (dt.datetime(2024, 1, 7, 5),)], "t TIMESTAMP_NTZ")
    assert [r[0] for r in df.select(T.day_of_week("t")).collect()] == [0, 6]
    assert [r[0] for r in df.select(T.is_weekend(T.day_of_week("t"))).collect()] == [0, 1]


def test_parse_bad_timestamp_is_null(spark):  # N10
    df = spark.createDataFrame([("10/01/2015 03:05:09 PM",), ("garbage",), (None,)], "s STRING")
    got = [r[0] for r in df.select(T.parse_ts("s")).collect()]
    assert got == [dt.datetime(2015, 10, 1, 15, 5, 9), None, None]


def test_resolution_hours_negative_and_null(spark):  # T16
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 7)),
                                (dt.datetime(2024, 1, 1, 10), None)], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    got = [r[0] for r in df.select(T.resolution_hours("a", "b")).collect()]
    assert got == [-3.0, None]


def test_label_maps(spark):  # P1-P4, N12
    df = spark.createDataFrame([("Tortured",), ("In Car",), ("Unknown thing",), (None,)], "d STRING")
    out = df.select(L.binary_priority("d"), L.severity("d"), L.severity_group("d")).collect()
    assert [tuple(r) for r in out] == [("CRITICO", "SEVERO", "SEVERO"), ("NO_CRITICO", "LEVE", "LEVE"),
                                       (None, None, "UNKNOWN"), (None, None, "UNKNOWN")]
    m = spark.createDataFrame([(12,), (3,), (9,), (None,)], "m INT")
    assert [r[0] for r in m.select(L.season("m")).collect()] == ["Invierno", "Primavera", "Otoño", None]


def test_half_even_rounding_in_reports(spark):  # N6
    # 49 of 400 -> 12.25 % -> 12.2 (half-even), not 12.3
    rows = [("A", "CRITICO")] * 49 + [("A", "NO_CRITICO")] * 351
    df = spark.createDataFrame(rows, "k STRING, priority STRING")
    r = R.critical_rate_by(df, "k").collect()[0]
    assert (r.n_critical, r.total, r.pct_critical) == (49, 400, 12.2)


def test_value_counts_denominators(spark):  # N2, N3
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c STRING")
    all_ = {r.c: r.pct for r in P.value_counts(df, "c").collect()}
    nn = {r.c: r.pct for r in P.value_counts(df, "c", denom="non_null").collect()}
    assert all_ == {"a": 50.0, "b": 25.0}
    assert abs(nn["a"] - 200 / 3) < 1e-12 and None not in nn


def test_hour_ratio_reference_mode(spark):  # N13
    rows = [(1, "CRITICO")] * 3 + [(2, "CRITICO"), (2, "NO_CRITICO")]
    df = spark.createDataFrame(rows, "hour INT, priority STRING")
    ref = {r.hour: r.pct_critical for r in R.critical_rate_by_hour(df).collect()}
    true = {r.hour: r.pct_critical for r in R.critical_rate_by_hour(df, mode="true").collect()}
    assert ref == {1: 0.0, 2: 50.0} and true == {1: 100.0, 2: 50.0}


def test_top_k_ties_keep_smaller_key(spark):  # N18
    rows = [(h, "CRITICO") for h in (5, 3)] + [(h, "NO_CRITICO") for h in (5, 3, 7)] + [(7, "CRITICO")]
    df = spark.createDataFrame(rows, "hour INT, priority STRING")
    assert [r.hour for r in R.top_critical_hours(df, 2).collect()] == [3, 5]


def test_having_is_inclusive(spark):  # N16
    rows = [("P", "CRITICO")] * 100 + [("Q", "CRITICO")] * 99
    df = spark.createDataFrame(rows, "k STRING, priority STRING")
    assert [r.k for r in R.critical_rate_by(df, "k", min_total=100).collect()] == ["P"]


def test_frequency_encoding_null_modes(spark):  # N14, J1
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id INT, c STRING")
    keep_null = {r.id: r.c_freq for r in E.frequency_encode(df, "c").collect()}
    zero = {r.id: r.c_freq for r in E.frequency_encode(df, "c", null_value=0).collect()}
    assert keep_null == {1: 2, 2: 2, 3: None} and zero == {1: 2, 2: 2, 3: 0}


def test_label_encode_nan_string(spark):  # P5
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id INT, c STRING")
    got = {r.id: r.c_code for r in E.label_encode(df, "c").collect()}
    assert got == {3: 0, 1: 1, 2: 2}  # 'a' < 'b' < 'nan'


def test_zip_region_fill(spark):  # N15, G3, G4
    df = spark.createDataFrame([(11201.0,), (None,)], "z DOUBLE")
    out = df.select(G.zip_region("z", 0), G.zip_region("z", 11000), G.zip_district("z", 11000)).collect()
    assert [tuple(r) for r in out] == [(112, 112, 1120), (0, 110, 1100)]


def test_describe_exact_quartiles_and_sample_std(spark):  # N7, N9
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "x DOUBLE")
    r = P.describe_numeric(df, ["x"]).collect()[0]
    assert (r.p25, r.p50, r.p75) == (1.75, 2.5, 3.25)
    assert abs(r["std"] - 1.2909944487358056) < 1e-12


def test_missing_profile_only_positive(spark):  # A9, F6
    df = spark.createDataFrame([(1, None), (2, "x")], "a INT, b STRING")
    rows = P.missing_profile(df).collect()
    assert [(r.column, r.n_missing, r.pct_missing) for r in rows] == [("b", 1, 50.0)]


def test_imbalance_ratio(spark):  # A2
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [(None,)], "c STRING")
    r = P.imbalance_ratio(df, "c").collect()[0]
    assert (r.n_max, r.n_min, r.ratio, r.imbalanced) == (7, 2, 3.5, 1)
