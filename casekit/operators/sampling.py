"""Exact, reproducible class-aware sampling: stratified split and k-fold (B1,
B2), random over/under-sampling (B3) and class weights (A17-A19).

Randomness is a hash of the row key and the seed (``md5``), so every engine and
every re-run (including a re-run task after an executor loss) draws the same
rows; ``rand()`` is never used.

Per-class exact ranks without a per-class sort
----------------------------------------------
``class_rank`` gives each row its 1-based position in its class, ordered by
(hash, key). A window partitioned by the label alone would put a whole class
-- possibly a third of the table -- in one task. Instead the hash's first hex
digits pick one of ``buckets`` sub-ranges:

1. rows per (label, bucket) -- an algebraic aggregate, partial on the map side;
2. a running sum over that small table gives each bucket's offset in its class;
3. a window partitioned by (label, bucket) ranks rows inside their bucket.

Hash buckets are uniform, so step 3 spreads every class evenly over all
tasks; the offset table (classes x buckets rows) is broadcast after a size
check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit.functions.labels import CRITICAL
from casekit.operators.encode import bounded_broadcast
from casekit.session import cut_lineage


def row_hash(key: str = "case_id", seed: int = 42) -> Column:
    """Hex md5 of '<key>:<seed>' -- identical in Spark and DuckDB."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def class_rank(df: DataFrame, label: str, key: str = "case_id", seed: int = 42, hex_digits: int = 3,
               rank_col: str = "class_rank", size_col: str = "class_n") -> DataFrame:
    """Adds ``class_rank`` (1..n_c, by hash then key) and ``class_n`` (class size)."""
    h = row_hash(key, seed)
    base = df.withColumns({"__h": h, "__b": F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("int")})
    counts = base.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    w = Window.partitionBy(label).orderBy("__b")
    offsets = (counts
               .withColumn("__off", F.coalesce(F.sum("__bn").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)))
               .withColumn(size_col, F.sum("__bn").over(Window.partitionBy(label)))
               .drop("__bn"))
    offsets, _ = bounded_broadcast(offsets, max_rows=1 << 20)
    inner = Window.partitionBy(label, "__b").orderBy("__h", key)
    ranked = base.withColumn("__r", F.row_number().over(inner))
    # null-safe key match: a NULL label is a class of its own here
    cond = [ranked[label].eqNullSafe(offsets[label]), ranked["__b"] == offsets["__b"]]
    out = ranked.join(offsets, cond, "inner").drop(offsets[label]).drop(offsets["__b"])
    return (out.withColumn(rank_col, (F.col("__off") + F.col("__r")).cast("long"))
            .drop("__h", "__b", "__r", "__off"))


def class_cut(df: DataFrame, label: str, quota, key: str = "case_id", seed: int = 42, hex_digits: int = 3,
              out: str = "picked", size_col: str = "class_n") -> DataFrame:
    """Adds ``picked``: is the row among the first ``quota`` of its class by (hash, key), and ``class_n``.

    ``quota`` makes a column of ``class_n`` and the greatest and least class size ``n_max`` and ``n_min``. Rows are not
    moved: counts per (class, hash bucket) say in which bucket a class's last picked row lies, only that bucket's
    rows are ranked, and every row is then decided by comparing it with its class's last row. Rows that share a key are decided
    together. A NULL label is a class of its own.
    """
    h = row_hash(key, seed)
    bucket = F.conv(F.substring("h", 1, hex_digits), 16, 10).cast("int")
    small = df.select(F.col(label).alias("y"), F.col(key).alias("k"), h.alias("h")).withColumn("b", bucket)
    counts = cut_lineage(small.groupBy("y", "b").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("y").agg(F.sum("n").alias(size_col))  # a row per class
    whole = sizes.agg(F.max(size_col), F.min(size_col)).first()
    sizes = sizes.withColumns({"n_max": F.lit(whole[0]), "n_min": F.lit(whole[1])})
    sizes = sizes.withColumn("quota", F.least(quota(F.col(size_col), F.col("n_max"), F.col("n_min")).cast("long"), size_col))
    w = Window.partitionBy("y").orderBy("b")
    upto = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = sizes.withColumnRenamed("y", "sy")
    last = upto.join(F.broadcast(s), upto["y"].eqNullSafe(s["sy"])).where("upto >= quota AND upto - n < quota")
    last = cut_lineage(last.select("sy", F.col("b").alias("sb"), (F.col("quota") - F.col("upto") + F.col("n")).alias("need")))
    edge = small.join(F.broadcast(last), small["y"].eqNullSafe(last["sy"]) & (small["b"] == last["sb"]))
    edge = edge.withColumn("r", F.row_number().over(Window.partitionBy("sy").orderBy("h", "k"))).where("r = need")
    edge = edge.select(F.col("sy").alias("ey"), F.col("h").alias("__eh"), F.col("k").alias("__ek"))
    cuts = sizes.join(edge, sizes["y"].eqNullSafe(edge["ey"]), "left").select(F.col("y").alias("__y"), size_col, "n_max", "n_min", "__eh", "__ek")
    cuts, _ = bounded_broadcast(cut_lineage(cuts), 1 << 16)
    first = (h < F.col("__eh")) | ((h == F.col("__eh")) & (F.col(key) <= F.col("__ek")))
    return (df.join(cuts, df[label].eqNullSafe(cuts["__y"])).withColumn(out, F.coalesce(first, F.lit(False)))
            .drop("__y", "__eh", "__ek"))


def test_count(n: Column, test_size: float) -> Column:
    """Test rows of a class of size n: n * test_size rounded half up."""
    return F.floor(n * F.lit(float(test_size)) + F.lit(0.5)).cast("long")


def stratified_split(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42, key: str = "case_id",
                     split_col: str = "split") -> DataFrame:
    """B1: exact per-class test share; adds ``split`` in {'train', 'test'}.

    Rows without a label are dropped first (the reference drops NULL targets
    before splitting). No row moves (``class_cut``).
    """
    r = class_cut(df.where(F.col(label).isNotNull()), label, lambda n, most, least: test_count(n, test_size), key, seed)
    return (r.withColumn(split_col, F.when(F.col("picked"), "test").otherwise("train"))
            .drop("picked", "class_n", "n_max", "n_min"))


def train_test(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42, key: str = "case_id"):
    s = stratified_split(df, label, test_size, seed, key)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def stratified_kfold(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "case_id",
                     fold_col: str = "fold") -> DataFrame:
    """B2: fold id 0..k-1; each class is dealt round-robin in hash order, so
    fold sizes per class differ by at most one."""
    r = class_rank(df.where(F.col(label).isNotNull()), label, key, seed)
    return r.withColumn(fold_col, F.pmod(F.col("class_rank") - 1, F.lit(k)).cast("int")).drop("class_rank", "class_n")


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def random_undersample(df: DataFrame, label: str, seed: int = 42, key: str = "case_id") -> DataFrame:
    """Every class cut to the smallest class size (hash order)."""
    d = df.where(F.col(label).isNotNull())
    r = class_cut(d, label, lambda n, most, least: least, key, seed)
    return r.where("picked").drop("picked", "class_n", "n_max", "n_min")


def random_oversample(df: DataFrame, label: str, seed: int = 42, key: str = "case_id",
                      copy_col: str = "copy") -> DataFrame:
    """Every class grown to the largest class size.

    A class of size n_c gets ``n_max div n_c`` full copies plus the first
    ``n_max mod n_c`` rows in hash order once more (sampling with replacement
    made exact and reproducible). Copies are generated per row with
    ``explode(sequence)``, so the work stays with the row's task.
    """
    d = df.where(F.col(label).isNotNull())
    r = class_cut(d, label, lambda n, most, least: F.pmod(most, n), key, seed)
    copies = (F.floor(F.col("n_max") / F.col("class_n")) + F.col("picked").cast("int")).cast("int")
    return (r.withColumn(copy_col, F.explode(F.sequence(F.lit(1), copies)))
            .drop("picked", "class_n", "n_max", "n_min"))


def class_weights(df: DataFrame, label: str, mode: str = "balanced", factor: float = 2.0,
                  positive: str = CRITICAL, fixed: dict | None = None) -> DataFrame:
    """One row per class with its weight.

    * ``balanced``: n / (k * n_c)
    * ``boosted``: balanced, times ``factor`` for the ``positive`` class
    * ``fixed``: hand-set weights, classes not listed get 1.0
    """
    sizes = _class_sizes(df, label)
    totals = sizes.agg(F.sum("n").alias("__tot"), F.count(F.lit(1)).alias("__k"))
    tot, k = totals.select("__tot").scalar(), totals.select("__k").scalar()
    balanced = tot / (k * F.col("n"))
    if mode == "balanced":
        w = balanced
    elif mode == "boosted":
        w = F.when(F.col(label) == positive, balanced * factor).otherwise(balanced)
    elif mode == "fixed":
        w = F.lit(1.0)
        for c, v in (fixed or {}).items():
            w = F.when(F.col(label) == c, F.lit(float(v))).otherwise(w)
    else:
        raise ValueError(mode)
    return sizes.withColumn("weight", w.cast("double"))


def with_weights(df: DataFrame, weights: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach a per-row weight from a class-weight table (one row per class, broadcast after a size check)."""
    w, _ = bounded_broadcast(weights.select(label, F.col("weight").alias(weight_col)), 1 << 16)
    return df.join(w, label, "left")
