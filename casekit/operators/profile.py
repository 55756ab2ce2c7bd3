"""Table profiles: shape, value counts, missing values, describe (S2, S3, A1,
A2, A9-A16, A20, F6, F7, F10, O7).

Every profile is one aggregate over the input (partial aggregation on the map
side, one small shuffle). Totals used as denominators come from a scalar
subquery over the already-grouped result, which AQE serves from the same
shuffle instead of rescanning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quote(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def column_kind(dt: T.DataType) -> str:
    """Reference type test: text -> categorical, timestamps -> datetime, else numeric."""
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "numeric"


def split_columns_by_type(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature lists from the schema; no data is read."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if column_kind(types[c]) == "numeric"]
    cat = [c for c in cols if column_kind(types[c]) == "categorical"]
    return num, cat


def table_shape(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def preview(df: DataFrame, n: int = 5, key: str = "case_id") -> DataFrame:
    """S3: first ``n`` rows by key (a top-k: the limit is the feature)."""
    return df.orderBy(key).limit(n)


def value_counts(df: DataFrame, col: str, denom: str = "all", n_name: str = "n",
                 pct_name: str = "pct") -> DataFrame:
    """A1: rows per non-NULL value and their percentage.

    ``denom='all'`` divides by every row, NULL keys included (pandas
    ``count / len(df)``); ``denom='non_null'`` divides by the counted rows.
    """
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias(n_name))
    if denom == "all":
        total = g.agg(F.sum(n_name)).scalar()
    elif denom == "non_null":
        total = g.where(F.col(col).isNotNull()).agg(F.sum(n_name)).scalar()
    else:
        raise ValueError(f"unknown denom {denom!r}")
    return (g.where(F.col(col).isNotNull())
            .withColumn(pct_name, F.col(n_name) * 100 / total))


def imbalance_ratio(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """A2: largest class / smallest class, and whether it exceeds ``threshold``."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return (g.agg(F.max("n").alias("n_max"), F.min("n").alias("n_min"),
                  F.count(F.lit(1)).alias("n_classes"))
            .withColumn("ratio", F.col("n_max") / F.col("n_min"))
            .withColumn("imbalanced", (F.col("ratio") > threshold).cast("int")))


def _null_counts_row(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count_if(F.col(_quote(c)).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]
    return df.agg(*aggs)


def _unpivot_row(row_df: DataFrame, names: list[str], prefixes: list[str], keep: list[str]) -> DataFrame:
    """One wide row -> one row per name (stack), columns ``column`` + one per prefix."""
    pieces = []
    for i, c in enumerate(names):
        pieces.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(p) for p in prefixes],
                               *[F.col(k) for k in keep]))
    return row_df.select(F.inline(F.array(*pieces)))


def missing_profile(df: DataFrame, cols: list[str] | None = None, only_missing: bool = True) -> DataFrame:
    """A9 (+F6): missing count and % per column, highest first, only > 0."""
    cols = cols or df.columns
    out = (_unpivot_row(_null_counts_row(df, cols), cols, ["m"], ["__n"])
           .select("column", F.col("m").alias("n_missing"),
                   (F.col("m") * 100 / F.col("__n")).alias("pct_missing")))
    if only_missing:
        out = out.where(F.col("n_missing") > 0)
    return out.orderBy(F.desc("n_missing"), "column")


def non_null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Non-NULL values per column (``DataFrame.count()`` per column)."""
    cols = cols or df.columns
    row = df.agg(*[F.count(F.col(_quote(c))).alias(f"c{i}") for i, c in enumerate(cols)])
    return _unpivot_row(row, cols, ["c"], []).select("column", F.col("c").alias("n_non_null"))


def column_profile(df: DataFrame, cols: list[str] | None = None, top: int | None = 10) -> DataFrame:
    """A10 (+O7): per column missing n and %, kind and distinct values; top by % missing.

    The distinct counts are exact: the pairs (column, digest of the value) are folded once for all columns, on the map side
    first, and counted after one exchange. Digests are 128 bits wide.
    """
    cols = cols or df.columns
    kinds = {f.name: column_kind(f.dataType) for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(_quote(c)).isNull()).alias(f"m{i}"))
    pairs = df.select(F.explode(F.filter(F.array(*[
        F.when(F.col(_quote(c)).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(_quote(c)).alias("x"),
                                                      F.xxhash64(F.lit(11), F.col(_quote(c))).alias("y")))
        for i, c in enumerate(cols)]), lambda s: s.isNotNull())).alias("s")).select("s.*")
    distinct = pairs.distinct().groupBy().agg(
        *[F.count_if(F.col("i") == i).alias(f"d{i}") for i in range(len(cols))])
    row = df.agg(*aggs).crossJoin(distinct)  # one row each
    out = (_unpivot_row(row, cols, ["m", "d"], ["__n"])
           .select("column", F.col("m").alias("n_missing"), (F.col("m") * 100 / F.col("__n")).alias("pct_missing"),
                   F.col("d").alias("n_distinct")))
    kind = None
    for c in cols:
        kind = (F.when(F.col("column") == c, kinds[c]) if kind is None
                else kind.when(F.col("column") == c, kinds[c]))
    out = out.withColumn("kind", kind)
    out = out.orderBy(F.desc("pct_missing"), "column")
    return out.limit(top) if top else out


def text_field_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct values and % missing for the named fields that exist."""
    present = [c for c in fields if c in df.columns]
    return column_profile(df, present, top=None).select("column", "n_distinct", "pct_missing")


def feature_missing_pct(df: DataFrame, features: list[str]) -> DataFrame:
    """% missing of each selected feature (all of them, zeros included)."""
    present = [c for c in features if c in df.columns]
    return missing_profile(df, present, only_missing=False).select("column", "n_missing", "pct_missing")


def candidate_features(df: DataFrame, target: str, max_missing_pct: float = 50.0, top: int = 15) -> DataFrame:
    """columns other than the target with < 50 % missing, fewest missing first, top 15."""
    cols = [c for c in df.columns if c != target]
    prof = missing_profile(df, cols, only_missing=False)
    return (prof.where(F.col("pct_missing") < max_missing_pct)
            .orderBy("pct_missing", "column").limit(top)
            .select("column", "pct_missing"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                     accuracy: int = 100000) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max.

    Quartiles are exact by default, narrowed for all columns at once
    (``column_quantiles``); ``approx=True`` uses ``percentile_approx`` instead.
    """
    from casekit.operators.quantiles import column_quantiles
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(_quote(c)).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        if approx:
            aggs += [F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"pq{i}")]
    row = df.agg(*aggs)
    if approx:
        row = row.select("*", *[F.col(f"pq{i}")[j].alias(f"{n}{i}") for i in range(len(cols))
                                for j, n in enumerate(["p25", "p50", "p75"])])
        return _unpivot_row(row, cols, ["n", "mean", "std", "min", "p25", "p50", "p75", "max"], []) \
            .withColumnRenamed("n", "count")
    stats = _unpivot_row(row, cols, ["n", "mean", "std", "min", "max"], []).withColumnRenamed("n", "count")
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        F.col("feature").alias("column"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return stats.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def monthly_counts(df: DataFrame, month_col: str = "month") -> DataFrame:
    """Cases per month, ordered by month."""
    return (df.where(F.col(month_col).isNotNull()).groupBy(month_col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(month_col))


def flag_totals(df: DataFrame, flags: list[str]) -> DataFrame:
    """Number of rows with each 0/1 flag set."""
    row = df.agg(*[F.sum(F.col(c)).cast("long").alias(f"s{i}") for i, c in enumerate(flags)])
    return _unpivot_row(row, flags, ["s"], []).select(F.col("column").alias("flag"), F.col("s").alias("n"))


def distinct_classes(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct non-NULL labels with their ordinal and the class count."""
    d = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n_classes = d.agg(F.count(F.lit(1))).scalar()
    return d.select(label, F.lit(n_classes).alias("n_classes"))


def minority_classes(df: DataFrame, label: str, max_share: float = 0.01) -> DataFrame:
    """classes holding fewer than ``max_share`` of the rows."""
    vc = value_counts(df, label, denom="all")
    return vc.where(F.col("pct") < max_share * 100)
