"""Vocabularies without a limit: ranks, joins and sparse one-hot vectors."""
import numpy as np
from pyspark.sql import functions as F

from casekit.operators import encode as E
from casekit.operators import profile as P
from casekit.operators import sampling as S


def test_two_million_categories(spark):
    n = 2_000_000
    df = spark.range(n).select(F.concat(F.lit("c"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(n)).cast("string"), 7, "0")).alias("c"), "id")
    coded = E.label_encode(df, "c", "code", max_broadcast_rows=1000)
    bad = coded.where(F.col("code") != F.substring("c", 2, 7).cast("int"))
    assert (bad.count(), coded.count()) == (0, n)
    fitted = E.fit_one_hot_sparse(df, ["c"])
    assert fitted.sizes == {"c": n} and fitted.width == n - 1
    rows = E.one_hot_sparse(df.where("id < 3").union(spark.createDataFrame([(None, -1), ("unseen", -2)], "c string, id long")), fitted).collect()
    for r in rows:
        v = r.c_onehot
        want = [int(r.c[1:]) - 1] if r.c and r.c[0] == "c" and r.c != "c0000000" else []
        assert v.size == n - 1 and v.indices.tolist() == want


def test_label_codes_of_nulls_and_unseen_values(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("z",), ("a",)], "c string")
    got = {r.c: r.c_code for r in E.label_encode(df, "c").collect()}
    assert got == {"a": 0, "b": 1, None: 2, "z": 3}
    fit = spark.createDataFrame([("a",), ("b",)], "c string")
    assert {r.c: r.c_code for r in E.label_encode(df, "c", fit_df=fit).collect()} == {"a": 0, "b": 1, None: None, "z": None}


def test_sparse_equals_dense(spark):
    df = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate(zip("abcab", ["x", None, "x", "y", "x"]))], "id int, c string, d string")
    dense = E.one_hot(df, E.fit_one_hot(df, ["c", "d"])).orderBy("id").collect()
    sparse = E.one_hot_sparse(df, E.fit_one_hot_sparse(df, ["c", "d"])).orderBy("id").collect()
    for a, b in zip(dense, sparse):
        assert [a.c__b, a.c__c, a.d__y] == [*b.c_onehot.toArray(), *b.d_onehot.toArray()]


def test_broadcast_is_bounded_by_bytes(spark):
    wide = spark.range(100).select("id", F.array_repeat(F.rpad(F.lit("x"), 1000, "x"), 10).alias("a"))
    assert E.bounded_broadcast(wide, 1000, 1 << 20)[1] is True
    assert E.bounded_broadcast(wide, 1000, 900_000)[1] is False
    assert E.bounded_broadcast(wide, 99)[1] is False


def test_split_moves_no_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("case_id"), F.when(F.col("id") % 7 == 0, "x").when(F.col("id") % 7 < 5, "y").alias("label"))
    for out in (S.stratified_split(df, "label"), S.random_undersample(df, "label"), S.random_oversample(df, "label")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    ranked = S.class_rank(df.where("label IS NOT NULL"), "label")
    for m in (0, 1, 700, 10_000):
        picked = S.class_cut(df.where("label IS NOT NULL"), "label", lambda n, a, b, m=m: F.lit(m)).where("picked")
        want = ranked.where(F.col("class_rank") <= m)
        assert picked.select("case_id").exceptAll(want.select("case_id")).isEmpty() and picked.count() == want.count()


def test_distinct_profile_has_one_exchange_of_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), float(b), None if c else "t") for a, b, c in zip(rng.integers(0, 9, 400), np.round(rng.normal(size=400), 1), rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    got = {r.column: r.n_distinct for r in P.column_profile(df).collect()}
    assert got == {"a": 9, "b": len({r[1] for r in rows}), "c": 1}
    plan = P.column_profile(df, top=None)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
