"""Evaluation (E1-E19) over a predictions table.

Input: ``predictions(case_id, model, label, prediction[, score])`` -- one row
per case and model. Every metric is one grouped aggregate over *all* models at
once: per model, the k x k confusion counts are conditional counts of a single
pass (k = number of classes, a fixed small list), then unpivoted. No metric
collects rows; only per-model aggregates leave the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit.functions.labels import CRITICAL, NON_CRITICAL
from casekit.operators.encode import bounded_broadcast

BINARY = [CRITICAL, NON_CRITICAL]


def _keys(model) -> list[str]:
    return [model] if isinstance(model, str) else list(model)


def _safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (sklearn's zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def accuracy(pred: DataFrame, model: str = "model") -> DataFrame:
    """E1."""
    return pred.groupBy(model).agg(F.count(F.lit(1)).alias("n"),
                                   F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion_matrix(pred: DataFrame, labels: list[str], model: str = "model") -> DataFrame:
    """(model, label, prediction, n) for every pair of the fixed label list, zeros kept."""
    aggs, parts = [], []
    for i, a in enumerate(labels):
        for j, b in enumerate(labels):
            aggs.append(F.count_if((F.col("label") == a) & (F.col("prediction") == b)).alias(f"c{i}_{j}"))
            parts.append(F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"),
                                  F.col(f"c{i}_{j}").alias("n")))
    return pred.groupBy(model).agg(*aggs).select(model, F.inline(F.array(*parts)))


def confusion_matrix_pct(pred: DataFrame, labels: list[str], model: str = "model") -> DataFrame:
    """Confusion counts as % of their true-label row (0 for an empty row)."""
    cm = confusion_matrix(pred, labels, model)
    # window over the k x k rows of one model and true label: bounded by k
    row_total = F.sum("n").over(Window.partitionBy(model, "label"))
    return cm.withColumn("pct", _safe_div(F.col("n") * 100, row_total))


def per_class_metrics(pred: DataFrame, labels: list[str], model: str = "model") -> DataFrame:
    """Tp, fp, fn, support, precision, recall, F1 per model and class (0 on empty denominators)."""
    aggs, parts = [], []
    lab, prd = F.col("label"), F.col("prediction")
    for i, c in enumerate(labels):
        aggs += [F.count_if((lab == c) & (prd == c)).alias(f"tp{i}"),
                 F.count_if(prd == c).alias(f"pp{i}"),
                 F.count_if(lab == c).alias(f"sp{i}")]
        parts.append(F.struct(F.lit(c).alias("class"), F.col(f"tp{i}").alias("tp"),
                              (F.col(f"pp{i}") - F.col(f"tp{i}")).alias("fp"),
                              (F.col(f"sp{i}") - F.col(f"tp{i}")).alias("fn"), F.col(f"sp{i}").alias("support")))
    out = pred.groupBy(*_keys(model)).agg(*aggs).select(*_keys(model), F.inline(F.array(*parts)))
    p = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall")))


def summary_metrics(pred: DataFrame, labels: list[str], model: str = "model",
                    positive: str | None = CRITICAL) -> DataFrame:
    """E1 + E5 + E6: accuracy, macro/weighted F1 (and P, R), and the positive class's P/R/F1."""
    pc = per_class_metrics(pred, labels, model)
    tot = F.sum("support")
    agg = pc.groupBy(*_keys(model)).agg(
        tot.alias("n"),
        (F.sum("tp") / tot).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_weighted"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall_weighted"),
        *([F.max(F.when(F.col("class") == positive, F.col("recall"))).alias("recall_critical"),
           F.max(F.when(F.col("class") == positive, F.col("precision"))).alias("precision_critical"),
           F.max(F.when(F.col("class") == positive, F.col("f1"))).alias("f1_critical")] if positive else []))
    return agg


def classification_report(pred: DataFrame, labels: list[str], model: str = "model") -> DataFrame:
    """Per-class rows, then 'accuracy', 'macro avg' and 'weighted avg' rows."""
    pc = per_class_metrics(pred, labels, model)
    rows = pc.select(model, F.col("class").alias("row"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    s = summary_metrics(pred, labels, model, positive=None)
    macro = pc.groupBy(model).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                  F.avg("f1").alias("f1"), F.sum("support").cast("long").alias("support"))
    acc = s.select(model, F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
                   F.col("n").cast("long").alias("support"))
    weighted = s.select(model, F.lit("weighted avg").alias("row"), F.col("precision_weighted").alias("precision"),
                        F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1"),
                        F.col("n").cast("long").alias("support"))
    return (rows.unionByName(acc)
            .unionByName(macro.select(model, F.lit("macro avg").alias("row"), "precision", "recall", "f1", "support"))
            .unionByName(weighted))


def detection_summary(pred: DataFrame, model: str = "model", positive: str = CRITICAL) -> DataFrame:
    """Critical cases, detected, missed, false alarms, detection % and false-alarm %."""
    pos, hit = F.col("label") == positive, F.col("prediction") == positive
    out = pred.groupBy(model).agg(F.count_if(pos).alias("critical_total"), F.count_if(pos & hit).alias("detected"),
                                  F.count_if(pos & ~hit).alias("missed"), F.count_if(~pos & hit).alias("false_alarms"),
                                  F.count_if(~pos).alias("non_critical_total"))
    return out.withColumns({
        "detection_pct": _safe_div(F.col("detected") * 100, F.col("critical_total")),
        "false_alarm_pct": _safe_div(F.col("false_alarms") * 100, F.col("non_critical_total")),
    })


def _score_groups(pred: DataFrame, score: str, model: str, positive: str, hex_bins: int = 1024) -> DataFrame:
    """(model, score) -> positives/negatives at that score, plus the counts of
    positives and negatives strictly *above* it.

    Running sums over all distinct scores of one model would be one task per
    model. Instead: distinct scores fold map-side; they are cut into
    ``hex_bins`` monotone bins at approximate quantiles (balanced whatever the
    score distribution); bin totals (small) give each bin's offset; a window
    per (model, bin) over distinct scores gives the rest.
    """
    pos = F.col("label") == positive
    g = pred.groupBy(model, score).agg(F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    # monotone, balanced bins: cut points are approximate quantiles of the model's distinct scores
    cuts = g.groupBy(model).agg(F.array_sort(F.array_distinct(
        F.percentile_approx(score, [i / hex_bins for i in range(1, hex_bins)], 10000))).alias("__cuts"))
    cuts, _ = bounded_broadcast(cuts, 1 << 16)
    g = g.join(cuts, model).withColumn("__b", F.size(F.filter(F.col("__cuts"), lambda b: b <= F.col(score)))) \
        .drop("__cuts")
    bins = g.groupBy(model, "__b").agg(F.sum("pos").alias("__bp"), F.sum("neg").alias("__bn"))
    wb = Window.partitionBy(model).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(model, "__b", F.coalesce(F.sum("__bp").over(wb), F.lit(0)).alias("__op"),
                       F.coalesce(F.sum("__bn").over(wb), F.lit(0)).alias("__on"))
    bins, _ = bounded_broadcast(bins, 1 << 22)
    wi = Window.partitionBy(model, "__b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumns({"__ip": F.coalesce(F.sum("pos").over(wi), F.lit(0)),
                       "__in": F.coalesce(F.sum("neg").over(wi), F.lit(0))})
    g = g.join(bins, [model, "__b"])
    return g.select(model, score, "pos", "neg", (F.col("__op") + F.col("__ip")).alias("pos_above"),
                    (F.col("__on") + F.col("__in")).alias("neg_above"))


def roc_auc(pred: DataFrame, score: str = "score", model: str = "model", positive: str = CRITICAL) -> DataFrame:
    """Exact area under the ROC curve (Mann-Whitney form, ties count one half)."""
    g = _score_groups(pred, score, model, positive)
    # a positive beats every negative scored below it: neg_total - neg_above - neg_here
    tot = g.groupBy(model).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    g = g.join(tot, model)
    below = F.col("N") - F.col("neg_above") - F.col("neg")
    return (g.groupBy(model, "P", "N")
            .agg(F.sum(F.col("pos") * below + F.col("pos") * F.col("neg") * 0.5).alias("__u"))
            .select(model, _safe_div(F.col("__u"), F.col("P") * F.col("N")).alias("auc")))


def roc_curve(pred: DataFrame, score: str = "score", model: str = "model", positive: str = CRITICAL) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, predicted positive if score >= threshold, and the
    start point (infinity, 0, 0) of every model."""
    g = _score_groups(pred, score, model, positive)
    tot = g.groupBy(model).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    points = g.join(tot, model).select(model, F.col(score).alias("threshold"),
                                       _safe_div(F.col("neg_above") + F.col("neg"), F.col("N")).alias("fpr"),
                                       _safe_div(F.col("pos_above") + F.col("pos"), F.col("P")).alias("tpr"))
    return points.union(tot.select(model, F.lit(float("inf")), F.lit(0.0), F.lit(0.0)))


def probability_histogram(pred: DataFrame, score: str = "score", bins: int = 20, model: str = "model") -> DataFrame:
    """Per model and true class, counts in ``bins`` equal bins of that class's own min-max range
    (the top edge falls in the last bin)."""
    rng = pred.groupBy(model, "label").agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    rng, _ = bounded_broadcast(rng, 1 << 16)
    j = pred.join(rng, [model, "label"])
    width = F.col("__hi") - F.col("__lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(score) - F.col("__lo")) / width * bins) + 1, F.lit(bins))).cast("int")
    return j.withColumn("bin", b).groupBy(model, "label", "bin").agg(F.count(F.lit(1)).alias("n"))


def actual_vs_predicted(pred: DataFrame, model: str = "model") -> DataFrame:
    """E12 (J3): per model and class, actual and predicted counts (missing side -> 0)."""
    a = pred.groupBy(model, F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("actual"))
    p = pred.groupBy(model, F.col("prediction").alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    return a.join(p, [model, "class"], "full_outer").fillna(0, subset=["actual", "predicted"])


def errors_by_class(pred: DataFrame, model: str = "model") -> DataFrame:
    """E13 (+F9): wrong predictions per model and true class."""
    return (pred.where(F.col("label") != F.col("prediction")).groupBy(model, "label")
            .agg(F.count(F.lit(1)).alias("errors")))


# ---- selection rules over a metrics table (E14) -----------------------------
def _rule_score(rule: str) -> Column:
    acc, rec = F.col("accuracy"), F.col("recall_critical")
    rules = {
        "a": F.col("f1_weighted"),
        "b": rec,
        "c": 0.6 * acc + 0.4 * rec,
        "d": F.when(acc < 0.6, F.lit(0.0)).otherwise(0.7 * acc + 0.3 * rec),
        "e": F.when(acc < 0.6, F.lit(0.0)).otherwise(0.6 * acc + 0.4 * rec),
        "f": 0.5 * acc + 0.4 * rec + 0.1 * F.col("f1_critical"),
        "g": F.when(acc < 0.5, F.lit(0.0)).otherwise(0.5 * acc + 0.5 * rec),
    }
    return rules[rule]


SELECTION_RULES = ["a", "b", "c", "d", "e", "f", "g"]


def rule_scores(metrics: DataFrame, rules: list[str] = SELECTION_RULES, model: str = "model") -> DataFrame:
    """Every model's score under every rule (a)-(g)."""
    parts = [F.struct(F.lit(r).alias("rule"), _rule_score(r).alias("score")) for r in rules]
    return metrics.select(model, "ordinal", F.inline(F.array(*parts)))


def select_best(metrics: DataFrame, rules: list[str] = SELECTION_RULES, model: str = "model") -> DataFrame:
    """Best model per rule; ties keep the first-listed model (lowest ``ordinal``, N19)."""
    s = rule_scores(metrics, rules, model)
    w = Window.partitionBy("rule").orderBy(F.desc("score"), F.asc("ordinal"))
    # rows = rules x models (a few dozen): the window is bounded by the model list
    return s.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r", "ordinal")


def stability(cv_mean: Column, test: Column) -> tuple[Column, Column]:
    """|cv - test| and its verdict."""
    d = F.abs(cv_mean - test)
    v = F.when(d < 0.05, "stable").when(d < 0.1, "moderate").otherwise("overfit")
    return d, v


def improvement(new: Column, old: Column) -> Column:
    """(new - old) / old * 100 (NULL when old is 0)."""
    return F.when(old != 0, (new - old) / old * 100)


PUBLISHED_STAGES = [
    # stage, accuracy, f1_weighted, recall_critical
    ("Original (7 classes)", 0.5652, 0.5057, 0.0),
    ("Severity (3 classes)", 0.5591, 0.4478, None),
    ("Simple binary", 0.8246, 0.7501, 0.01),
    ("Balanced binary", 0.8071, 0.7516, 0.0465),
]
# --- end of fixed values ---


def evolution_table(spark, metrics: DataFrame, model: str = "model") -> DataFrame:
    """The published stages followed by the evaluated models."""
    base = spark.createDataFrame(
        [(i, s, a, f, r) for i, (s, a, f, r) in enumerate(PUBLISHED_STAGES)],
        "step INT, stage STRING, accuracy DOUBLE, f1_weighted DOUBLE, recall_critical DOUBLE")
    cur = metrics.select((F.lit(len(PUBLISHED_STAGES)) + F.col("ordinal")).cast("int").alias("step"),
                         F.col(model).alias("stage"), "accuracy", "f1_weighted", "recall_critical")
    return base.unionByName(cur)


# ---- tier rules (E18): fixed thresholds of the reference's verdicts ----------
def tier_recall(rec: Column) -> Column:
    return F.when(rec > 0.3, "excellent").when(rec > 0.1, "good").otherwise("improvable")


def tier_balance(acc: Column, rec: Column) -> Column:
    return (F.when((acc > 0.7) & (rec > 0.1), "excellent").when((acc > 0.6) & (rec > 0.05), "good")
            .otherwise("none"))


def tier_detected(n: Column) -> Column:
    return (F.when(n > 1000, "incredible").when(n > 500, "excellent").when(n > 200, "very good")
            .otherwise("progress"))


def tier_useful(rec: Column) -> Column:
    return F.when(rec > 0.1, "excellent").when(rec > 0.05, "good").otherwise("none")


def tier_accuracy(acc: Column, rec: Column) -> Column:
    return F.when((acc > 0.7) & (rec > 0.1), "excellent").when(acc > 0.6, "good").otherwise("none")


def tier_found(n: Column) -> Column:
    return F.when(n > 500, "incredible").when(n > 200, "excellent").when(n > 100, "good").otherwise("none")
