"""Category encodings and feature projection.

Vocabularies and per-category counts are aggregates whose size is the number
of distinct categories, not the number of rows. They are broadcast only after
their rows and bytes have been measured (``bounded_broadcast``); above the bound the
join stays a shuffle join, where AQE splits a hot category. No encoding limits the number of categories.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.session import cut_lineage

DEFAULT_MAX_BROADCAST_ROWS = 1 << 20
MAX_BROADCAST_BYTES = 64 << 20
#: Categories up to which ``fit_one_hot`` makes a column of each; larger vocabularies go to sparse vectors.
MAX_DENSE_CATEGORIES = 10_000


def _bytes_of(col: Column, kind: T.DataType) -> Column:
    """Bytes of a value, nested ones included."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            inner = F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType))
        else:
            inner = F.size(col).cast("long") * 8
        return F.coalesce(inner, F.lit(0).cast("long")) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(col[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.MapType):
        return (_bytes_of(F.map_keys(col), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(col), T.ArrayType(kind.valueType)))
    return F.lit(8).cast("long")


def bounded_broadcast(small: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast ``small`` only if it has at most ``max_rows`` rows and ``max_bytes`` bytes, strings and arrays measured.

    The side is persisted first, so the count and the later join read it once.
    Returns the (possibly hinted) frame and whether it was hinted.
    """
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in small.schema.fields), F.lit(16).cast("long"))
    n, size = small.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    if n <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(small), True
    return small, False


def frequency_encode(df: DataFrame, col: str, out: str | None = None, null_value=None,
                     fit_df: DataFrame | None = None, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Number of rows with the same category, joined back.

    NULL categories get ``null_value`` (NULL by default, 0 for the
    ``fillna(0)`` variant, N14). ``fit_df`` counts on another frame (e.g. the
    train split, N17); default counts on ``df`` itself.
    """
    out = out or f"{col}_freq"
    counts = ((fit_df or df).where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(out)))
    counts, _ = bounded_broadcast(counts, max_broadcast_rows)
    j = df.join(counts, on=col, how="left")
    if null_value is not None:
        j = j.fillna({out: null_value})
    return j


def dense_rank(values: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct ``values(col)`` with their 0-based position in order: range partitions are ranked on their own
    and shifted by the sizes of those before, so no task sees the whole vocabulary."""
    p = cut_lineage(values.repartitionByRange(col).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shift = p.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select(
        "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(col)) - 1
    return p.withColumn("__own", own).join(F.broadcast(shift), "__p").select(*values.columns, (F.col("__own") + F.col("__shift")).alias(out))


def vocabulary(df: DataFrame, col: str, out: str, null_value: str | None = None) -> DataFrame:
    """``(__v, out)``: the sorted distinct values of ``col`` as text -> 0..k-1; NULL counts as ``null_value`` if given."""
    v = F.col(f"`{col}`").cast("string")
    v = F.coalesce(v, F.lit(null_value)) if null_value is not None else v
    return dense_rank(df.select(v.alias("__v")).where(F.col("__v").isNotNull()).distinct(), "__v", out)


def label_encode(df: DataFrame, col: str, out: str | None = None, fit_df: DataFrame | None = None,
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """P5: sorted distinct values -> 0..k-1; NULL is the text ``nan`` (``astype(str)``).

    Any number of categories: the vocabulary is ranked by range partitions and joined by a shuffle where it is
    too large to broadcast. Values unseen in ``fit_df`` get NULL."""
    out = out or f"{col}_code"
    ranked = vocabulary(fit_df if fit_df is not None else df, col, out, "nan").withColumn(out, F.col(out).cast("int"))
    ranked, _ = bounded_broadcast(ranked, max_broadcast_rows)
    key = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("nan"))
    return df.withColumn("__v", key).join(ranked, "__v", "left").drop("__v")


def _safe(v: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", str(v)).strip("_")


def fit_one_hot(df: DataFrame, cols: list[str], max_vocab: int = MAX_DENSE_CATEGORIES) -> dict[str, list[str]]:
    """I6 fit for one column per category: sorted categories per column. Larger vocabularies are for ``fit_one_hot_sparse``."""
    vocab = {}
    for c in cols:
        vals = (df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
                .orderBy("v").limit(max_vocab + 1).collect())
        if len(vals) > max_vocab:
            raise ValueError(f"one_hot: {c!r} has more than {max_vocab} categories; use fit_one_hot_sparse")
        vocab[c] = [r.v for r in vals]
    return vocab


@dataclass
class SparseOneHot:
    """I6 fit without a limit: per column the vocabulary as a table ``(__v, __code)`` and its size."""

    tables: dict[str, DataFrame]
    sizes: dict[str, int]

    @property
    def width(self) -> int:
        """Entries of all vectors together (the first category of each column is dropped)."""
        return sum(max(n - 1, 0) for n in self.sizes.values())


def fit_one_hot_sparse(df: DataFrame, cols: list[str]) -> SparseOneHot:
    tables = {c: cut_lineage(vocabulary(df, c, "__code")) for c in cols}
    return SparseOneHot(tables, {c: t.count() for c, t in tables.items()})


def one_hot_sparse(df: DataFrame, fitted: SparseOneHot, suffix: str = "_onehot", drop_first: bool = True) -> DataFrame:
    """I6 transform: per column a sparse 0/1 vector ``<col><suffix>`` whose entries are the sorted categories, the first one
    dropped; NULL and unseen categories are all zeros. Any number of categories: codes are joined, entries not columns."""
    out, made = df, []
    for c, table in fitted.tables.items():
        first = 1 if drop_first else 0
        width = fitted.sizes[c] - first
        codes, _ = bounded_broadcast(table.select("__v", (F.col("__code") - first).alias("__code")))
        out = out.withColumn("__v", F.col(f"`{c}`").cast("string")).join(codes, "__v", "left").drop("__v")
        # entries 0..width-1 are categories; the last index, which the encoder drops, is everything else
        other = F.lit(float(max(width, 1)))
        out = out.withColumn(f"__i_{c}", F.when(F.col("__code") >= 0, F.col("__code").cast("double")).otherwise(other)).drop("__code")
        made.append((c, max(width, 1) + 1))
    if not made:
        return out
    for c, size in made:
        encoder = OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"{c}{suffix}", dropLast=True)
        out = encoder.fit(out.sparkSession.createDataFrame([(float(size - 1),)], f"`__i_{c}` double")).transform(out).drop(f"__i_{c}")
    return out


def one_hot(df: DataFrame, vocab: dict[str, list[str]], drop_first: bool = True, keep_source: bool = False) -> DataFrame:
    """I6 transform: one 0/1 column per category; the alphabetically first is
    dropped; a category unseen at fit time gives all zeros."""
    cols = {}
    for c, values in vocab.items():
        for v in (values[1:] if drop_first else values):
            cols[f"{c}__{_safe(v)}"] = F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).cast("int")
    out = df.withColumns(cols)
    return out if keep_source else out.drop(*vocab.keys())


def select_features(df: DataFrame, candidates: list[str], target: str, keys: tuple[str, ...] = ("case_id",),
                    drop_null_target: bool = True) -> DataFrame:
    """G12 (+F1): keep the candidate features that exist, the target and keys;
    drop rows without a target."""
    feats = [c for c in candidates if c in df.columns]
    out = df.select(*[k for k in keys if k in df.columns], *feats, target)
    return out.where(F.col(target).isNotNull()) if drop_null_target else out
