"""Rule-based scorers: deterministic "models" whose predictions make every
evaluation operator exactly checkable without training (SURVEY §5.2).

score = weighted sum of 0/1 flags / sum of weights; CRITICO when score >= threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.functions.labels import CRITICAL, NON_CRITICAL

RULE_MODELS = [
    # name, {flag: integer weight}, threshold
    ("rule_location", {"is_park": 3, "is_subway": 2, "is_street": 2, "is_store": 1}, 0.3),
    ("rule_time", {"is_madrugada": 2, "is_hour_2": 1, "is_hour_5": 1, "is_hour_0": 1, "is_high_risk_season": 1}, 0.3),
    ("rule_combined", {"is_park": 3, "is_bronx": 2, "is_madrugada": 2, "bronx_park": 2, "park_madrugada": 2,
                       "is_high_risk_borough": 1}, 0.25),
]


def score_expr(weights: dict[str, int]):
    num = None
    for c, w in weights.items():
        term = F.col(c) * F.lit(int(w))
        num = term if num is None else num + term
    return num / F.lit(int(sum(weights.values())))


def score_sql(weights: dict[str, int]) -> str:
    return "(" + " + ".join(f"{c} * {int(w)}" for c, w in weights.items()) + f") / {int(sum(weights.values()))}"


def binary_predictions(df: DataFrame, label: str = "priority", models=RULE_MODELS) -> DataFrame:
    """One row per case and model: (case_id, model, ordinal, label, prediction, score).

    The models are unrolled with ``inline`` in one pass over ``df`` (no union of re-scans).
    """
    parts = []
    for i, (name, w, thr) in enumerate(models):
        s = score_expr(w)
        parts.append(F.struct(F.lit(name).alias("model"), F.lit(i).alias("ordinal"), s.alias("score"),
                              F.when(s >= thr, F.lit(CRITICAL)).otherwise(F.lit(NON_CRITICAL)).alias("prediction")))
    return df.select("case_id", F.col(label).alias("label"), F.inline(F.array(*parts))) \
        .select("case_id", "model", "ordinal", "label", "prediction", "score")


def binary_predictions_sql(src: str, label: str = "priority", models=RULE_MODELS) -> str:
    sels = []
    for i, (name, w, thr) in enumerate(models):
        s = score_sql(w)
        sels.append(f"SELECT case_id, '{name}' AS model, {i} AS ordinal, {label} AS label, "
                    f"CASE WHEN {s} >= {thr} THEN '{CRITICAL}' ELSE '{NON_CRITICAL}' END AS prediction, "
                    f"{s} AS score FROM {src}")
    return " UNION ALL ".join(sels)


SEVERITY_WEIGHTS = RULE_MODELS[2][1]


def severity_predictions(df: DataFrame, label: str = "severity") -> DataFrame:
    """A three-class rule: SEVERO on a high score, MODERADO for residential or unresolved cases, else LEVE."""
    s = score_expr(SEVERITY_WEIGHTS)
    pred = (F.when(s >= 0.25, "SEVERO").when((F.col("is_residential") == 1) | (F.col("has_resolution") == 0), "MODERADO")
            .otherwise("LEVE"))
    return df.select("case_id", F.lit("rule_severity").alias("model"), F.lit(0).alias("ordinal"),
                     F.col(label).alias("label"), pred.alias("prediction"), s.alias("score"))


def severity_predictions_sql(src: str, label: str = "severity") -> str:
    s = score_sql(SEVERITY_WEIGHTS)
    return (f"SELECT case_id, 'rule_severity' AS model, 0 AS ordinal, {label} AS label, "
            f"CASE WHEN {s} >= 0.25 THEN 'SEVERO' WHEN is_residential = 1 OR has_resolution = 0 THEN 'MODERADO' "
            f"ELSE 'LEVE' END AS prediction, {s} AS score FROM {src}")
