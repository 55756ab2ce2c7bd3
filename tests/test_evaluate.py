"""Evaluation operators (E1-E18) against hand-computed values."""
import numpy as np
from pyspark.sql import functions as F

from casekit.operators import evaluate as EV

BIN = ["CRITICO", "NO_CRITICO"]


def _preds(spark):
    # 12 rows, tied scores (FIXTURES §4 predictions)
    rows = [
        (1, "CRITICO", "CRITICO", 0.9), (2, "CRITICO", "NO_CRITICO", 0.4), (3, "CRITICO", "CRITICO", 0.7),
        (4, "CRITICO", "NO_CRITICO", 0.4), (5, "NO_CRITICO", "CRITICO", 0.7), (6, "NO_CRITICO", "NO_CRITICO", 0.1),
        (7, "NO_CRITICO", "NO_CRITICO", 0.4), (8, "NO_CRITICO", "NO_CRITICO", 0.2), (9, "NO_CRITICO", "CRITICO", 0.9),
        (10, "NO_CRITICO", "NO_CRITICO", 0.1), (11, "NO_CRITICO", "NO_CRITICO", 0.3), (12, "NO_CRITICO", "NO_CRITICO", 0.2),
    ]
    return spark.createDataFrame(rows, "case_id LONG, label STRING, prediction STRING, score DOUBLE") \
        .withColumn("model", F.lit("m")).withColumn("ordinal", F.lit(0))


def test_confusion_and_per_class(spark):
    p = _preds(spark)
    cm = {(r.label, r.prediction): r.n for r in EV.confusion_matrix(p, BIN).collect()}
    assert cm == {("CRITICO", "CRITICO"): 2, ("CRITICO", "NO_CRITICO"): 2, ("NO_CRITICO", "CRITICO"): 2,
                  ("NO_CRITICO", "NO_CRITICO"): 6}
    pc = {r["class"]: r for r in EV.per_class_metrics(p, BIN).collect()}
    assert (pc["CRITICO"].precision, pc["CRITICO"].recall, pc["CRITICO"].f1) == (0.5, 0.5, 0.5)
    assert pc["NO_CRITICO"].precision == 0.75 and pc["NO_CRITICO"].recall == 0.75
    s = EV.summary_metrics(p, BIN).collect()[0]
    assert abs(s.accuracy - 8 / 12) < 1e-12
    assert abs(s.f1_weighted - (0.5 * 4 + 0.75 * 8) / 12) < 1e-12
    assert abs(s.f1_macro - 0.625) < 1e-12 and s.recall_critical == 0.5


def test_zero_division_is_zero(spark):
    p = spark.createDataFrame([("m", "NO_CRITICO", "NO_CRITICO")], "model STRING, label STRING, prediction STRING")
    pc = {r["class"]: r for r in EV.per_class_metrics(p, BIN).collect()}
    assert (pc["CRITICO"].precision, pc["CRITICO"].recall, pc["CRITICO"].f1) == (0.0, 0.0, 0.0)


def test_confusion_pct_and_detection(spark):
    p = _preds(spark)
    pct = {(r.label, r.prediction): r.pct for r in EV.confusion_matrix_pct(p, BIN).collect()}
    assert pct[("CRITICO", "CRITICO")] == 50.0 and pct[("NO_CRITICO", "NO_CRITICO")] == 75.0
    d = EV.detection_summary(p).collect()[0]
    assert (d.critical_total, d.detected, d.missed, d.false_alarms) == (4, 2, 2, 2)
    assert d.detection_pct == 50.0 and d.false_alarm_pct == 25.0


def test_auc_matches_pairwise_count(spark):
    p = _preds(spark)
    rows = p.collect()
    pos = [r.score for r in rows if r.label == "CRITICO"]
    neg = [r.score for r in rows if r.label != "CRITICO"]
    u = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    got = EV.roc_auc(p).collect()[0].auc
    assert abs(got - u / (len(pos) * len(neg))) < 1e-12


def test_auc_random_ties_many_bins(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(3000), 2)
    y = rng.random(3000) < s
    rows = [("m", "CRITICO" if b else "NO_CRITICO", "x", float(v)) for v, b in zip(s, y)]
    p = spark.createDataFrame(rows, "model STRING, label STRING, prediction STRING, score DOUBLE")
    pos, neg = s[y], s[~y]
    u = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(EV.roc_auc(p).collect()[0].auc - u) < 1e-12
    roc = EV.roc_curve(p).orderBy(F.desc("threshold")).collect()
    assert roc[-1].fpr == 1.0 and roc[-1].tpr == 1.0
    assert (roc[0].threshold, roc[0].fpr, roc[0].tpr) == (float("inf"), 0.0, 0.0)


def test_histogram_top_edge_in_last_bin(spark):
    p = _preds(spark)
    h = {(r.label, r.bin): r.n for r in EV.probability_histogram(p, bins=20).collect()}
    assert h[("CRITICO", 20)] == 1 and h[("CRITICO", 1)] == 2  # 0.9 is the top edge; two at the min 0.4
    assert sum(v for (lab, _), v in h.items() if lab == "NO_CRITICO") == 8


def test_classification_report_rows(spark):
    rep = {r.row: r for r in EV.classification_report(_preds(spark), BIN).collect()}
    assert set(rep) == {"CRITICO", "NO_CRITICO", "accuracy", "macro avg", "weighted avg"}
    assert rep["macro avg"].support == 12 and abs(rep["accuracy"].f1 - 8 / 12) < 1e-12


def test_select_best_ties_first_model(spark):  # N19, E14
    m = spark.createDataFrame([("m1", 0, 0.7, 0.6, 0.2, 0.3), ("m2", 1, 0.7, 0.6, 0.2, 0.3),
                               ("m3", 2, 0.55, 0.5, 0.9, 0.4)],
                              "model STRING, ordinal INT, accuracy DOUBLE, f1_weighted DOUBLE, "
                              "recall_critical DOUBLE, f1_critical DOUBLE")
    best = {r.rule: r.model for r in EV.select_best(m).collect()}
    assert best["a"] == "m1" and best["b"] == "m3"
    assert best["d"] == "m1"  # m3 is under the 0.6 accuracy floor
    assert best["g"] == "m3"


def test_tiers_and_stability(spark):
    df = spark.createDataFrame([(0.35, 0.75, 1200, 0.80, 0.82)], "rec DOUBLE, acc DOUBLE, det INT, cv DOUBLE, te DOUBLE")
    r = df.select(EV.tier_recall(F.col("rec")).alias("a"), EV.tier_balance(F.col("acc"), F.col("rec")).alias("b"),
                  EV.tier_detected(F.col("det")).alias("c"), EV.stability(F.col("cv"), F.col("te"))[1].alias("d")
                  ).collect()[0]
    assert tuple(r) == ("excellent", "excellent", "incredible", "stable")
