"""Critical-rate reports.

Each report is one conditional aggregation: per key, CRITICO and NO_CRITICO
counts come out of the same pass (no pivot value discovery, no per-class
re-scan). Grouping keys are low-cardinality and the aggregates are algebraic,
so a hot key (a third of all rows) is folded map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.functions.labels import CRITICAL, NON_CRITICAL


def _class_counts(df: DataFrame, key: str, label: str) -> DataFrame:
    lab = F.col(label)
    return (df.where(F.col(key).isNotNull() & lab.isNotNull())
            .groupBy(key)
            .agg(F.count_if(lab == CRITICAL).alias("n_critical"),
                 F.count_if(lab == NON_CRITICAL).alias("n_non_critical")))


def critical_rate_by(df: DataFrame, key: str, label: str = "priority", min_total: int | None = None,
                     top: int | None = None, order: str = "pct") -> DataFrame:
    """A3 (+F5, O2, O4): counts per class, total, % critical rounded half-even to 1 decimal.

    ``min_total`` keeps groups with total >= n (N16); ``top`` keeps the first
    rows by % (ties: larger total, then key).
    """
    out = (_class_counts(df, key, label)
           .withColumn("total", F.col("n_critical") + F.col("n_non_critical"))
           .withColumn("pct_critical", F.bround(F.col("n_critical") / F.col("total") * 100, 1)))
    if min_total is not None:
        out = out.where(F.col("total") >= min_total)
    if order == "pct":
        out = out.orderBy(F.desc("pct_critical"), F.desc("total"), F.asc(key))
    else:
        out = out.orderBy(F.desc("total"), F.asc(key))
    return out.limit(top) if top else out


def critical_rate_by_hour(df: DataFrame, hour: str = "hour", label: str = "priority",
                          mode: str = "reference") -> DataFrame:
    """Per-hour counts and % critical (unrounded).

    ``mode='reference'`` reproduces the index-aligned combine: an hour without
    one of the two classes gets ratio 0 (N13). ``mode='true'`` gives the real
    share.
    """
    c = _class_counts(df, hour, label).withColumn("total", F.col("n_critical") + F.col("n_non_critical"))
    ratio = F.col("n_critical") / F.col("total") * 100
    if mode == "reference":
        ratio = F.when((F.col("n_critical") == 0) | (F.col("n_non_critical") == 0), F.lit(0.0)).otherwise(ratio)
    elif mode != "true":
        raise ValueError(mode)
    return c.withColumn("pct_critical", ratio).orderBy(hour)


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """O1: ``nlargest``: highest ``by`` first; ties keep the smaller ``tie`` key."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def top_critical_hours(df: DataFrame, k: int = 5, hour: str = "hour", label: str = "priority") -> DataFrame:
    """O1 over A4."""
    return top_k(critical_rate_by_hour(df, hour, label), "pct_critical", k, hour)


def top_values_in_class(df: DataFrame, key: str, label: str = "priority", cls: str = CRITICAL,
                        k: int = 3) -> DataFrame:
    """O3: most frequent values of ``key`` among rows of one class."""
    return (df.where((F.col(label) == cls) & F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k))


def resolution_rate_by_class(df: DataFrame, label: str = "priority", closed: str = "closed_ts") -> DataFrame:
    """A5: cases, resolved cases and resolution rate (%, half-even 1 decimal) per class."""
    resolved = F.col(closed).isNotNull()
    return (df.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("total_cases"), F.count_if(resolved).alias("resolved_cases"),
                 F.avg(resolved.cast("double")).alias("_rate"))
            .withColumn("resolution_rate", F.bround(F.col("_rate") * 100, 1)).drop("_rate"))


def resolution_time_describe(df: DataFrame, label: str = "priority", hours: str = "resolution_hours",
                             closed: str = "closed_ts") -> DataFrame:
    """A6 (+F8): describe() of resolution hours per class over resolved cases.

    Median and p75 are exact, from the distributed ``exact_quantiles`` (no
    class is gathered in one task).
    """
    from casekit.operators.quantiles import exact_quantiles
    x = F.col(hours)
    resolved = df.where(F.col(closed).isNotNull() & F.col(label).isNotNull())
    stats = (resolved.groupBy(label)
             .agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.max(x).alias("max")))
    q = exact_quantiles(resolved, hours, [0.5, 0.75], keys=[label]) \
        .select(label, F.col("q0").alias("p50"), F.col("q1").alias("p75"))
    return stats.join(q, label, "left").select(label, "count", "mean", "std", "p50", "p75", "max")


def coordinate_stats_by_class(df: DataFrame, label: str = "priority", lat: str = "latitude",
                              lon: str = "longitude") -> DataFrame:
    """A7 (+F3, F4): rows with both coordinates per class, their share, mean and sample std."""
    both = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    la = F.when(both, F.col(lat))
    lo = F.when(both, F.col(lon))
    return (df.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("n_with_coords"),
                 F.avg(la).alias("lat_mean"), F.stddev_samp(la).alias("lat_std"),
                 F.avg(lo).alias("lon_mean"), F.stddev_samp(lo).alias("lon_std"))
            .withColumn("pct_with_coords", F.col("n_with_coords") / F.col("n") * 100))


def missing_by_class(df: DataFrame, cols: list[str], label: str = "priority") -> DataFrame:
    """Per column, missing count and % among critical and non-critical rows, and the gap.

    One pass: both classes and all columns are conditional counts of the same
    aggregate; the one-row result is unpivoted.
    """
    crit, non = F.col(label) == CRITICAL, F.col(label) == NON_CRITICAL
    aggs = [F.count_if(crit).alias("nc"), F.count_if(non).alias("nn")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(crit & F.col(c).isNull()).alias(f"a{i}"),
                 F.count_if(non & F.col(c).isNull()).alias(f"b{i}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("critical_missing"),
                      F.col(f"b{i}").alias("non_critical_missing"), F.col("nc"), F.col("nn"))
             for i, c in enumerate(cols)]
    out = row.select(F.inline(F.array(*parts)))
    cp = F.col("critical_missing") / F.col("nc") * 100
    npct = F.col("non_critical_missing") / F.col("nn") * 100
    return out.select("column", "critical_missing", F.bround(cp, 2).alias("critical_pct"),
                      "non_critical_missing", F.bround(npct, 2).alias("non_critical_pct"),
                      F.bround(cp - npct, 2).alias("difference"))


def outer_combine(left: DataFrame, right: DataFrame, key: str, fill=0) -> DataFrame:
    """Index-aligned combine of two keyed count tables, missing side -> ``fill``.

    Both inputs are per-key aggregates (one row per key), so the full outer
    join is bounded by the number of keys.
    """
    j = left.join(right, on=key, how="full_outer")
    other = [c for c in j.columns if c != key]
    return j.fillna(fill, subset=other)
