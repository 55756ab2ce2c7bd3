"""Evaluation queries (E1-E19) over rule-based predictions on the test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit.functions.labels import CRITICAL
from casekit.operators import evaluate as EV
from casekit.operators import sampling as S
from casekit.plans.oracle import with_ctes
from casekit.plans.q_prep import SEED, _split_cte
from casekit.plans.registry import feats, register
from casekit.plans.rules import (binary_predictions, binary_predictions_sql, severity_predictions,
                                 severity_predictions_sql)

BIN = ["CRITICO", "NO_CRITICO"]
SEV = ["SEVERO", "MODERADO", "LEVE"]


# ---- Spark side ------------------------------------------------------------
def _preds(spark, sf):
    s = S.stratified_split(feats(spark, sf), "priority", 0.2, SEED)
    return binary_predictions(s.where(F.col("split") == "test"))


def _sev_preds(spark, sf):
    s = S.stratified_split(feats(spark, sf), "severity", 0.2, SEED)
    return severity_predictions(s.where(F.col("split") == "test"))


def _metrics(spark, sf):
    m = EV.summary_metrics(_preds(spark, sf), BIN)
    return m.join(_preds(spark, sf).select("model", "ordinal").distinct(), "model")


def _r6(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- SQL side --------------------------------------------------------------
_PRED_CTES = (_split_cte("priority") + ",\npreds AS (" + binary_predictions_sql("split WHERE split = 'test'") + ")")
_SEV_CTES = (_split_cte("severity", name="ssplit") + ",\nspreds AS ("
             + severity_predictions_sql("ssplit WHERE split = 'test'") + ")")


def _per_class_sql(rel: str, labels: list[str], keys: str = "model") -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS class, count_if(label = '{c}' AND prediction = '{c}') AS tp, "
        f"count_if(prediction = '{c}') AS pp, count_if(label = '{c}') AS sp FROM {rel} GROUP BY {keys}"
        for c in labels)
    base = (f"SELECT {keys}, class, tp, pp - tp AS fp, sp - tp AS fn, sp AS support, "
            "CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS precision, "
            f"CASE WHEN sp = 0 THEN 0.0 ELSE tp / sp END AS recall FROM ({parts})")
    return (f"SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) "
            f"END AS f1 FROM ({base})")


def _summary_sql(rel: str, labels: list[str], keys: str = "model", positive: bool = True) -> str:
    crit = (", max(CASE WHEN class = 'CRITICO' THEN recall END) AS recall_critical, "
            "max(CASE WHEN class = 'CRITICO' THEN precision END) AS precision_critical, "
            "max(CASE WHEN class = 'CRITICO' THEN f1 END) AS f1_critical") if positive else ""
    return (f"SELECT {keys}, CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy, "
            "avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted, "
            "sum(precision * support) / sum(support) AS precision_weighted, "
            f"sum(recall * support) / sum(support) AS recall_weighted{crit} "
            f"FROM ({_per_class_sql(rel, labels, keys)}) GROUP BY {keys}")


_SUMMARY_COLS = ["accuracy", "f1_macro", "f1_weighted", "precision_weighted", "recall_weighted", "recall_critical",
                 "precision_critical", "f1_critical"]


def _round_sql(cols, rel, keep):
    return f"SELECT {keep}, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + f" FROM ({rel})"


# ---- E1 ---------------------------------------------------------------------
@register("eval_accuracy", with_ctes(
    "SELECT model, CAST(count(*) AS BIGINT) AS n, avg(CAST(label = prediction AS DOUBLE)) AS accuracy "
    "FROM preds GROUP BY model", _PRED_CTES))
def q_accuracy(spark, sf):
    return EV.accuracy(_preds(spark, sf))


# ---- E2, E3 -------------------------------------------------------------------
def _cm_sql(rel, labels):
    return " UNION ALL ".join(
        f"SELECT model, '{a}' AS label, '{b}' AS prediction, count_if(label = '{a}' AND prediction = '{b}') AS n "
        f"FROM {rel} GROUP BY model" for a in labels for b in labels)


@register("eval_confusion_matrix", with_ctes(_cm_sql("preds", BIN), _PRED_CTES))
def q_cm(spark, sf):
    return EV.confusion_matrix(_preds(spark, sf), BIN)


@register("eval_confusion_matrix_severity", with_ctes(_cm_sql("spreds", SEV), _SEV_CTES))
def q_cm_sev(spark, sf):
    return EV.confusion_matrix(_sev_preds(spark, sf), SEV)


@register("eval_confusion_matrix_pct", with_ctes(
    "SELECT *, CASE WHEN sum(n) OVER (PARTITION BY model, label) = 0 THEN 0.0 "
    f"ELSE n * 100 / sum(n) OVER (PARTITION BY model, label) END AS pct FROM ({_cm_sql('preds', BIN)})", _PRED_CTES))
def q_cm_pct(spark, sf):
    return EV.confusion_matrix_pct(_preds(spark, sf), BIN)


# ---- E4, E5, E6, E7 ---------------------------------------------------------
@register("eval_per_class_severity", with_ctes(_per_class_sql("spreds", SEV), _SEV_CTES))
def q_per_class(spark, sf):
    return EV.per_class_metrics(_sev_preds(spark, sf), SEV)


@register("eval_summary", with_ctes(_round_sql(_SUMMARY_COLS, _summary_sql("preds", BIN), "model, n"), _PRED_CTES))
def q_summary(spark, sf):
    return _r6(EV.summary_metrics(_preds(spark, sf), BIN), _SUMMARY_COLS)


@register("eval_critical_metrics", with_ctes(
    "SELECT model, precision AS precision_critical, recall AS recall_critical, f1 AS f1_critical, support "
    f"FROM ({_per_class_sql('preds', BIN)}) WHERE class = 'CRITICO'", _PRED_CTES))
def q_critical(spark, sf):
    pc = EV.per_class_metrics(_preds(spark, sf), BIN)
    return pc.where(F.col("class") == CRITICAL).select(
        "model", F.col("precision").alias("precision_critical"), F.col("recall").alias("recall_critical"),
        F.col("f1").alias("f1_critical"), "support")


_REPORT_CTES = (f"pc AS ({_per_class_sql('spreds', SEV)}),\nsm AS ({_summary_sql('spreds', SEV, positive=False)})")
_REPORT_SQL = (
    "SELECT model, class AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM pc UNION ALL "
    "SELECT model, 'accuracy', NULL, NULL, round(accuracy, 6), n FROM sm UNION ALL "
    "SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), "
    "CAST(sum(support) AS BIGINT) FROM pc GROUP BY model UNION ALL "
    "SELECT model, 'weighted avg', round(precision_weighted, 6), round(recall_weighted, 6), round(f1_weighted, 6), n "
    "FROM sm")


@register("eval_classification_report", with_ctes(_REPORT_SQL, _SEV_CTES + ",\n" + _REPORT_CTES))
def q_report(spark, sf):
    return _r6(EV.classification_report(_sev_preds(spark, sf), SEV), ["precision", "recall", "f1"])


# ---- E8 ---------------------------------------------------------------------
_DETECT_SQL = (
    "SELECT model, critical_total, detected, missed, false_alarms, non_critical_total, "
    "CASE WHEN critical_total = 0 THEN 0.0 ELSE detected * 100 / critical_total END AS detection_pct, "
    "CASE WHEN non_critical_total = 0 THEN 0.0 ELSE false_alarms * 100 / non_critical_total END AS false_alarm_pct "
    "FROM (SELECT model, count_if(label = 'CRITICO') AS critical_total, "
    "count_if(label = 'CRITICO' AND prediction = 'CRITICO') AS detected, "
    "count_if(label = 'CRITICO' AND prediction <> 'CRITICO') AS missed, "
    "count_if(label <> 'CRITICO' AND prediction = 'CRITICO') AS false_alarms, "
    "count_if(label <> 'CRITICO') AS non_critical_total FROM preds GROUP BY model)")


@register("eval_detection_summary", with_ctes(_DETECT_SQL, _PRED_CTES))
def q_detection(spark, sf):
    return EV.detection_summary(_preds(spark, sf))


# ---- E9, E10, E11 -------------------------------------------------------------
_SCORE_GROUPS = ("SELECT model, score, count_if(label = 'CRITICO') AS pos, count_if(label <> 'CRITICO') AS neg "
                 "FROM preds GROUP BY model, score")


@register("eval_roc_auc", with_ctes(
    "SELECT model, CASE WHEN sum(pos) * sum(neg) = 0 THEN 0.0 ELSE "
    "sum(pos * neg_below + pos * neg * 0.5) / (sum(pos) * sum(neg)) END AS auc FROM ("
    "SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING "
    f"AND 1 PRECEDING), 0) AS neg_below FROM ({_SCORE_GROUPS})) GROUP BY model", _PRED_CTES))
def q_auc(spark, sf):
    return EV.roc_auc(_preds(spark, sf))


@register("eval_roc_curve", with_ctes(
    "SELECT model, score AS threshold, "
    "CASE WHEN N = 0 THEN 0.0 ELSE neg_at / N END AS fpr, CASE WHEN P = 0 THEN 0.0 ELSE pos_at / P END AS tpr FROM ("
    "SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_at, "
    "sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_at, "
    "sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N "
    f"FROM ({_SCORE_GROUPS})) UNION ALL SELECT DISTINCT model, CAST('infinity' AS DOUBLE), 0.0, 0.0 "
    f"FROM ({_SCORE_GROUPS})", _PRED_CTES))
def q_roc(spark, sf):
    return EV.roc_curve(_preds(spark, sf))


@register("eval_probability_histogram", with_ctes(
    "SELECT model, label, CAST(CASE WHEN hi - lo = 0 THEN 1 ELSE least(floor((score - lo) / (hi - lo) * 20) + 1, 20) "
    "END AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT p.*, r.lo, r.hi FROM preds p JOIN "
    "(SELECT model, label, min(score) AS lo, max(score) AS hi FROM preds GROUP BY model, label) r "
    "USING (model, label)) GROUP BY ALL", _PRED_CTES))
def q_hist(spark, sf):
    return EV.probability_histogram(_preds(spark, sf), bins=20)


# ---- E12, E13 -----------------------------------------------------------------
@register("eval_actual_vs_predicted", with_ctes(
    "SELECT coalesce(a.model, p.model) AS model, coalesce(a.class, p.class) AS class, "
    "coalesce(a.actual, 0) AS actual, coalesce(p.predicted, 0) AS predicted FROM "
    "(SELECT model, label AS class, CAST(count(*) AS BIGINT) AS actual FROM spreds GROUP BY ALL) a FULL OUTER JOIN "
    "(SELECT model, prediction AS class, CAST(count(*) AS BIGINT) AS predicted FROM spreds GROUP BY ALL) p "
    "ON a.model = p.model AND a.class = p.class", _SEV_CTES))
def q_actual_vs_predicted(spark, sf):
    return EV.actual_vs_predicted(_sev_preds(spark, sf))


@register("eval_errors_by_class", with_ctes(
    "SELECT model, label, CAST(count(*) AS BIGINT) AS errors FROM spreds WHERE label <> prediction GROUP BY ALL",
    _SEV_CTES))
def q_errors(spark, sf):
    return EV.errors_by_class(_sev_preds(spark, sf))


# ---- E14, E15, E16, E17, E18, E19 -----------------------------------------------
_METRICS_CTE = (f"metrics AS (SELECT s.*, o.ordinal FROM ({_summary_sql('preds', BIN)}) s JOIN "
                "(SELECT DISTINCT model, ordinal FROM preds) o USING (model))")
_RULES_SQL = {
    "a": "f1_weighted", "b": "recall_critical", "c": "0.6 * accuracy + 0.4 * recall_critical",
    "d": "CASE WHEN accuracy < 0.6 THEN 0.0 ELSE 0.7 * accuracy + 0.3 * recall_critical END",
    "e": "CASE WHEN accuracy < 0.6 THEN 0.0 ELSE 0.6 * accuracy + 0.4 * recall_critical END",
    "f": "0.5 * accuracy + 0.4 * recall_critical + 0.1 * f1_critical",
    "g": "CASE WHEN accuracy < 0.5 THEN 0.0 ELSE 0.5 * accuracy + 0.5 * recall_critical END",
}


@register("eval_select_best", with_ctes(
    "SELECT rule, model, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY "
    "score DESC, ordinal) AS rn FROM (" + " UNION ALL ".join(
        f"SELECT '{r}' AS rule, model, ordinal, {e} AS score FROM metrics" for r, e in _RULES_SQL.items())
    + ")) WHERE rn = 1", _PRED_CTES + ",\n" + _METRICS_CTE))
def q_select_best(spark, sf):
    return EV.select_best(_metrics(spark, sf)).withColumn("score", F.round("score", 6))


def _fold_cte() -> str:
    return ("folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY priority ORDER BY "
            f"md5(CAST(case_id AS VARCHAR) || ':{SEED}'), case_id) - 1) % 5 AS INTEGER) AS fold "
            "FROM split WHERE split = 'train'),\nfpreds AS (SELECT p.*, f.fold FROM ("
            + binary_predictions_sql("folds") + ") p JOIN folds f USING (case_id))")


@register("eval_stability", with_ctes(
    "SELECT model, round(cv_mean, 6) AS cv_mean, round(test_f1, 6) AS test_f1, round(abs(cv_mean - test_f1), 6) "
    "AS diff, CASE WHEN abs(cv_mean - test_f1) < 0.05 THEN 'stable' WHEN abs(cv_mean - test_f1) < 0.1 "
    "THEN 'moderate' ELSE 'overfit' END AS verdict FROM "
    f"(SELECT model, avg(f1_weighted) AS cv_mean FROM ({_summary_sql('fpreds', BIN, 'model, fold', False)}) "
    f"GROUP BY model) JOIN (SELECT model, f1_weighted AS test_f1 FROM ({_summary_sql('preds', BIN)})) USING (model)",
    _PRED_CTES + ",\n" + _fold_cte()))
def q_stability(spark, sf):
    f = feats(spark, sf)
    s = S.stratified_split(f, "priority", 0.2, SEED)
    train = s.where(F.col("split") == "train").drop("split")
    folds = S.stratified_kfold(train, "priority", 5, SEED)
    fp = binary_predictions(folds).join(folds.select("case_id", "fold"), "case_id")
    cv = (EV.summary_metrics(fp, BIN, model=["model", "fold"], positive=None)
          .groupBy("model").agg(F.avg("f1_weighted").alias("cv_mean")))
    test = EV.summary_metrics(binary_predictions(s.where(F.col("split") == "test")), BIN) \
        .select("model", F.col("f1_weighted").alias("test_f1"))
    j = cv.join(test, "model")
    d, v = EV.stability(F.col("cv_mean"), F.col("test_f1"))
    return j.select("model", F.round("cv_mean", 6).alias("cv_mean"), F.round("test_f1", 6).alias("test_f1"),
                    F.round(d, 6).alias("diff"), v.alias("verdict"))


@register("eval_improvement", with_ctes(
    "SELECT model, round((accuracy - 0.5652) / 0.5652 * 100, 6) AS accuracy_gain_pct, "
    "round((f1_weighted - 0.5057) / 0.5057 * 100, 6) AS f1_gain_pct FROM metrics",
    _PRED_CTES + ",\n" + _METRICS_CTE))
def q_improvement(spark, sf):
    m = _metrics(spark, sf)
    return m.select("model", F.round(EV.improvement(F.col("accuracy"), F.lit(0.5652)), 6).alias("accuracy_gain_pct"),
                    F.round(EV.improvement(F.col("f1_weighted"), F.lit(0.5057)), 6).alias("f1_gain_pct"))


@register("eval_evolution_table", with_ctes(
    "SELECT * FROM (VALUES (0, 'Original (7 classes)', 0.5652, 0.5057, 0.0), "
    "(1, 'Severity (3 classes)', 0.5591, 0.4478, NULL), (2, 'Simple binary', 0.8246, 0.7501, 0.01), "
    "(3, 'Balanced binary', 0.8071, 0.7516, 0.0465)) t(step, stage, accuracy, f1_weighted, recall_critical) "
    "UNION ALL SELECT CAST(4 + ordinal AS INTEGER), model, round(accuracy, 6), round(f1_weighted, 6), "
    "round(recall_critical, 6) FROM metrics", _PRED_CTES + ",\n" + _METRICS_CTE))
def q_evolution(spark, sf):
    m = _r6(_metrics(spark, sf), ["accuracy", "f1_weighted", "recall_critical"])
    return EV.evolution_table(spark, m)


@register("eval_quality_tier", with_ctes(
    "SELECT model, CASE WHEN recall_critical > 0.3 THEN 'excellent' WHEN recall_critical > 0.1 THEN 'good' "
    "ELSE 'improvable' END AS tier_recall, CASE WHEN accuracy > 0.7 AND recall_critical > 0.1 THEN 'excellent' "
    "WHEN accuracy > 0.6 AND recall_critical > 0.05 THEN 'good' ELSE 'none' END AS tier_balance, "
    "CASE WHEN detected > 1000 THEN 'incredible' WHEN detected > 500 THEN 'excellent' WHEN detected > 200 "
    "THEN 'very good' ELSE 'progress' END AS tier_detected, CASE WHEN recall_critical > 0.1 THEN 'excellent' "
    "WHEN recall_critical > 0.05 THEN 'good' ELSE 'none' END AS tier_useful, CASE WHEN accuracy > 0.7 AND "
    "recall_critical > 0.1 THEN 'excellent' WHEN accuracy > 0.6 THEN 'good' ELSE 'none' END AS tier_accuracy, "
    "CASE WHEN detected > 500 THEN 'incredible' WHEN detected > 200 THEN 'excellent' WHEN detected > 100 "
    "THEN 'good' ELSE 'none' END AS tier_found FROM metrics JOIN (SELECT model, "
    "count_if(label = 'CRITICO' AND prediction = 'CRITICO') AS detected FROM preds GROUP BY model) USING (model)",
    _PRED_CTES + ",\n" + _METRICS_CTE))
def q_tier(spark, sf):
    m = _metrics(spark, sf).join(EV.detection_summary(_preds(spark, sf)).select("model", "detected"), "model")
    return m.select("model", EV.tier_recall(F.col("recall_critical")).alias("tier_recall"),
                    EV.tier_balance(F.col("accuracy"), F.col("recall_critical")).alias("tier_balance"),
                    EV.tier_detected(F.col("detected")).alias("tier_detected"),
                    EV.tier_useful(F.col("recall_critical")).alias("tier_useful"),
                    EV.tier_accuracy(F.col("accuracy"), F.col("recall_critical")).alias("tier_accuracy"),
                    EV.tier_found(F.col("detected")).alias("tier_found"))


@register("eval_model_comparison", with_ctes(
    "SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT metrics ON accuracy, f1_weighted, "
    "recall_critical, f1_critical INTO NAME metric VALUE value)", _PRED_CTES + ",\n" + _METRICS_CTE))
def q_comparison(spark, sf):
    m = _metrics(spark, sf)
    return (m.unpivot("model", ["accuracy", "f1_weighted", "recall_critical", "f1_critical"], "metric", "value")
            .withColumn("value", F.round("value", 6)))
