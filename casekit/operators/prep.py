"""Fit-on-train / apply-to-test preprocessing.

Every ``fit_*`` returns a small statistics DataFrame (one row per feature, or
one row per feature and class) computed by a single aggregate over the train
rows; ``apply_*`` adds them back as literals. Nothing row-sized reaches the
driver: only per-column statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return "`" + c + "`"


def _stack(row: DataFrame, cols: list[str], fields: dict[str, str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}{i}").alias(name) for p, name in fields.items()])
             for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*parts)))


def fit_median(train: DataFrame, cols: list[str]) -> DataFrame:
    """Exact median per column (linear interpolation between the middle values).

    All columns are narrowed together (``column_quantiles``); no column is gathered in one task.
    """
    from casekit.operators.quantiles import column_quantiles
    med = column_quantiles(train, cols, [0.5]).select("feature", F.col("q0").alias("value"))
    names = train.sparkSession.createDataFrame([(c,) for c in cols], "feature STRING")
    return names.join(med, "feature", "left")  # all-NULL columns keep a NULL median


def fit_mode(train: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-NULL value per column; ties -> smallest value.

    One (column, value) count table for all columns -- map-side partial
    counts, then a ``max_by`` over (count desc, value asc) per column.
    """
    pairs = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(_q(c)).cast("string").alias("v")) for c in cols])).alias("p"))
    counts = (pairs.select("p.feature", "p.v").where(F.col("v").isNotNull())
              .groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")))
    # order key: higher n first, then smaller value
    best = counts.groupBy("feature").agg(
        F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v").alias("vv"))).alias("value"))
    return best


def apply_fill(df: DataFrame, stats: DataFrame) -> DataFrame:
    """I1/I2 transform: fill NULLs with the fitted per-column values."""
    values = {r.feature: r.value for r in stats.collect()}  # one row per feature
    types = dict(df.dtypes)
    cols = {}
    for c, v in values.items():
        if v is None:
            continue
        lit = F.lit(v).cast(types[c]) if types[c] != "string" else F.lit(str(v))
        cols[c] = F.coalesce(F.col(_q(c)), lit)
    return df.withColumns(cols)


def fill_constant(df: DataFrame, cols: list[str], value=0) -> DataFrame:
    """Constant fill."""
    return df.fillna(value, subset=cols)


def fit_standard(train: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per column."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(_q(c)).cast("double")
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}")]
    return _stack(train.agg(*aggs), cols, {"a": "mean", "s": "std"})


def apply_standard(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - mean) / std; a zero-variance column scales by 1, giving 0."""
    cols = {}
    for r in stats.collect():  # one row per feature
        scale = r["std"] if r["std"] not in (None, 0.0) else 1.0
        mean = r["mean"] if r["mean"] is not None else 0.0
        cols[r.feature] = (F.col(_q(r.feature)).cast("double") - F.lit(mean)) / F.lit(scale)
    return df.withColumns(cols)


def f_classif(train: DataFrame, cols: list[str], label: str) -> DataFrame:
    """One-way ANOVA F statistic of each numeric feature against the class.

    NULLs take the feature's median over the labelled rows, as in training. Then one
    pass: per class count, mean and variance of every feature, and per feature
    F = (SSB / (k - 1)) / (SSW / (n - k)). Means and variances, unlike sums of
    squares, do not cancel. A feature without any value scores NULL.
    """
    rows = train.where(F.col(label).isNotNull())
    median = {r.feature: r.value for r in fit_median(rows, cols).collect()}  # one row per feature
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = F.coalesce(F.col(_q(c)).cast("double"), F.lit(median[c]).cast("double"))
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per_class = rows.groupBy(label).agg(*aggs)
    long = per_class.select("n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(cols)])))
    g = long.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.collect_list(F.struct("n", "m")).alias("means"))  # one per class
    mean = F.aggregate("means", F.lit(0.0), lambda a, x: a + x["n"] * x["m"]) / F.col("n")
    g = g.withColumn("mean", mean)
    ssb = F.aggregate("means", F.lit(0.0), lambda a, x: a + x["n"] * (x["m"] - F.col("mean")) * (x["m"] - F.col("mean")))
    f = (ssb / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return g.select("feature", F.when((F.col("ssw") > 0) & (F.col("k") > 1), f).alias("f_score"))


def select_k_best(scores: DataFrame, k: int = 12) -> DataFrame:
    """Top ``k`` features by F (NULL scores last, ties by name)."""
    return scores.orderBy(F.desc_nulls_last("f_score"), "feature").limit(k)
