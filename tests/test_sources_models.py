"""CSV source and sink (S1, S4), the case view, and a model sweep on a planted signal."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from casekit.operators import models as M
from casekit.operators import sampling as S
from casekit.plans.features import case_features
from casekit.sources.cases import CSV_HEADER, case_table, load_cases, write_table

from conftest import SF_SMALL


def test_csv_round_trip_with_bad_timestamp(spark):
    d = tempfile.mkdtemp(prefix="casekit-csv-")
    header = ",".join(f'"{h}"' for h in CSV_HEADER)
    row1 = ['10/01/2015 03:05:09 PM', '10/02/2015 01:00:00 AM', 'NYPD', 'Tortured', 'Park/Playground', '11201',
            '', 'MAIN ST', '', '', 'BRONX', '40.7', '-73.9', 'Closed', 'done', '01 BRONX']
    row2 = ['not a date', '', 'NYPD', 'Chained', '', 'nan', '', '', '', '', '', '', '', 'Open', '', '']
    with open(os.path.join(d, "cases.csv"), "w") as fh:
        fh.write(header + "\n" + ",".join(f'"{v}"' for v in row1) + "\n" + ",".join(f'"{v}"' for v in row2) + "\n")
    df = load_cases(spark, d)
    rows = df.orderBy(F.desc("descriptor")).collect()
    assert rows[0].created_ts.hour == 15 and rows[0].incident_zip == 11201.0
    assert rows[1].created_ts is None and rows[1].incident_zip is None  # N10, N20
    out = os.path.join(d, "out")
    write_table(df, out)
    assert spark.read.parquet(out).count() == 2


def test_csv_columns_by_name_quotes_and_stable_keys(spark):
    d = tempfile.mkdtemp(prefix="casekit-csv-")
    names = list(CSV_HEADER)
    header = ["Unique Key", *reversed(names[1:])]  # one more, another order, the first column absent
    text = ",".join(f'"{h}"' for h in header) + "\n"
    for i in range(50):
        values = [str(i // 2), *[f'say ""{h}"", {i // 2}' for h in header[1:]]]
        text += ",".join(f'"{v}"' for v in values) + "\n"
    with open(os.path.join(d, "cases.csv"), "w") as fh:
        fh.write(text)
    df = load_cases(spark, d)
    rows = df.collect()
    absent = CSV_HEADER[names[0]]
    assert all(r[absent] is None for r in rows)
    assert {r["descriptor"] for r in rows} == {f'say "{k}", {i}' for k, c in CSV_HEADER.items() if c == "descriptor"
                                               for i in range(25)}
    assert len({r["case_id"] for r in rows}) == 50  # every row stands there twice
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        assert {r["case_id"] for r in load_cases(spark, d).collect()} == {r["case_id"] for r in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_weights_and_tree_settings_reach_the_learner():
    def estimator(kind, n_classes=3, **params):
        return M.make_estimator(M.ModelSpec(kind, kind, params), n_classes, 10.0, "weight")[0]

    for kind in ("gbt", "extra_trees"):
        assert estimator(kind).getWeightCol() == "weight"
    assert estimator("svm", C=0.5).getStages()[1].getClassifier().getRegParam() == 0.2
    assert estimator("gbt", min_samples_leaf=5, learning_rate=0.2).settings["min_rows"] == 5
    gbt = estimator("gbt", 2, min_samples_leaf=5, max_features="sqrt")
    assert (gbt.getMinInstancesPerNode(), gbt.getFeatureSubsetStrategy()) == (5, "sqrt")
    assert estimator("logreg", C=0.5).getRegParam() == 0.2
    with pytest.warns(UserWarning, match="max_depth=35"):
        assert estimator("rf", max_depth=35).getMaxDepth() == 30


def test_case_view_shape(spark):
    c = case_table(spark, SF_SMALL)
    assert len(c.columns) == 17 and c.count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    sub = case_table(spark, SF_SMALL, ["case_id", "descriptor"])
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan  # no lineitem scan without closed_ts


def test_model_learns_planted_signal(spark):
    f = case_features(case_table(spark, SF_SMALL))
    # plant a signal (FIXTURES §2): parks at night are critical
    f = f.withColumn("priority", F.when((F.col("is_park") == 1) & (F.col("hour") <= 6), "CRITICO")
                     .otherwise(F.col("priority")))
    feats = ["hour", "is_park", "is_bronx", "month"]
    data = f.select("case_id", "priority", *feats).where(F.col("priority").isNotNull())
    s = S.stratified_split(data, "priority", 0.2, 42)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    spec = M.ModelSpec("rf", "rf", {"n_estimators": 20, "max_depth": 6})
    fitted, preds, errors = M.model_sweep([spec, M.ModelSpec("bad", "nope")], train, test, "priority",
                                          M.Preprocessor(feats, numeric_impute="constant"))
    assert [e[0] for e in errors] == ["bad"]  # a failing model does not stop the sweep
    m = M.sweep_metrics(preds, ["CRITICO", "NO_CRITICO"]).collect()[0]
    majority = test.where(F.col("priority") == "NO_CRITICO").count() / test.count()
    assert m.accuracy > majority and m.precision_critical > 0.9
    planted = (preds.join(test.select("case_id", "hour", "is_park"), "case_id")
               .where((F.col("is_park") == 1) & (F.col("hour") <= 6)))
    assert planted.where(F.col("prediction") == "CRITICO").count() >= 0.9 * planted.count()
    imp = fitted[0].feature_importance(spark).collect()
    assert imp[0].feature in ("hour", "is_park")
    probs = fitted[0].predict(test).select("score").collect()
    assert all(0.0 <= r.score <= 1.0 for r in probs)
