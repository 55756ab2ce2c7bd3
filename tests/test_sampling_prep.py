"""Exact splits, folds, resampling, weights and preprocessing."""
from pyspark.sql import functions as F

from casekit.operators import prep as PR
from casekit.operators import sampling as S


def _labelled(spark, n_a=1000, n_b=170):
    rows = [(i, "A") for i in range(n_a)] + [(10_000 + i, "B") for i in range(n_b)]
    return spark.createDataFrame(rows, "case_id LONG, y STRING")


def test_class_rank_is_a_permutation(spark):
    r = S.class_rank(_labelled(spark), "y").groupBy("y").agg(
        F.min("class_rank").alias("lo"), F.max("class_rank").alias("hi"),
        F.count_distinct("class_rank").alias("d"), F.first("class_n").alias("n")).orderBy("y").collect()
    assert [(x.lo, x.hi, x.d, x.n) for x in r] == [(1, 1000, 1000, 1000), (1, 170, 170, 170)]


def test_stratified_split_exact_and_stable(spark):
    df = _labelled(spark)
    s1 = S.stratified_split(df, "y", 0.2, 42)
    sizes = {(r.y, r.split): r["count"] for r in s1.groupBy("y", "split").count().collect()}
    assert sizes == {("A", "test"): 200, ("A", "train"): 800, ("B", "test"): 34, ("B", "train"): 136}
    s2 = S.stratified_split(df, "y", 0.2, 42)
    assert s1.exceptAll(s2).count() == 0
    s3 = S.stratified_split(df, "y", 0.2, 7)
    assert s1.join(s3, ["case_id", "y", "split"]).count() < 1170  # another seed draws other rows


def test_split_drops_null_label_and_is_complete(spark):
    df = _labelled(spark).unionByName(spark.createDataFrame([(99_999, None)], "case_id LONG, y STRING"))
    s = S.stratified_split(df, "y")
    assert s.count() == 1170 and s.select("case_id").distinct().count() == 1170


def test_kfold_balanced(spark):
    f = S.stratified_kfold(_labelled(spark), "y", 5)
    sizes = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert all(v == 200 for (y, _), v in sizes.items() if y == "A")
    assert all(v == 34 for (y, _), v in sizes.items() if y == "B")


def test_over_and_under_sampling_sizes(spark):
    df = _labelled(spark)
    over = {r.y: r["count"] for r in S.random_oversample(df, "y").groupBy("y").count().collect()}
    under = {r.y: r["count"] for r in S.random_undersample(df, "y").groupBy("y").count().collect()}
    assert over == {"A": 1000, "B": 1000} and under == {"A": 170, "B": 170}


def test_class_weights(spark):
    df = spark.createDataFrame([(i, "CRITICO" if i < 25 else "NO_CRITICO") for i in range(100)], "case_id LONG, y STRING")
    bal = {r.y: r.weight for r in S.class_weights(df, "y").collect()}
    assert bal == {"CRITICO": 2.0, "NO_CRITICO": 100 / 150}
    boost = {r.y: r.weight for r in S.class_weights(df, "y", "boosted", factor=2.0).collect()}
    assert boost["CRITICO"] == 4.0
    fixed = {r.y: r.weight for r in S.class_weights(df, "y", "fixed", fixed={"CRITICO": 3}).collect()}
    assert fixed == {"CRITICO": 3.0, "NO_CRITICO": 1.0}


def test_median_mode_fill_and_standardize(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (None, "b"), (10.0, None)], "x DOUBLE, c STRING")
    med = {r.feature: r.value for r in PR.fit_median(df, ["x"]).collect()}
    mode = {r.feature: r.value for r in PR.fit_mode(df, ["c"]).collect()}
    assert med == {"x": 2.0} and mode == {"c": "b"}
    filled = PR.apply_fill(PR.apply_fill(df, PR.fit_median(df, ["x"])), PR.fit_mode(df, ["c"]))
    assert filled.where(F.col("x").isNull() | F.col("c").isNull()).count() == 0
    const = spark.createDataFrame([(5.0,), (5.0,)], "x DOUBLE")
    z = PR.apply_standard(const, PR.fit_standard(const, ["x"])).collect()
    assert [r.x for r in z] == [0.0, 0.0]  # N8: zero variance -> 0


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c STRING")
    assert PR.fit_mode(df, ["c"]).collect()[0].value == "a"


def test_f_classif_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=300) + y * 0.5
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x DOUBLE, y INT")
    f = PR.f_classif(df, ["x"], "y").collect()[0].f_score
    groups = [x[y == k] for k in range(3)]
    grand = x.mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    expect = (ssb / 2) / (ssw / (300 - 3))
    assert abs(f - expect) / expect < 1e-9


def test_f_classif_fills_nulls_with_the_median(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 200)
    x = np.round(rng.normal(size=200), 3) - 74.0
    gone = rng.random(200) < 0.2
    df = spark.createDataFrame([(None if g else float(a), int(b)) for a, b, g in zip(x, y, gone)], "x DOUBLE, y INT")
    f = PR.f_classif(df, ["x"], "y").collect()[0].f_score
    x = np.where(gone, np.median(x[~gone]), x)
    ssb = sum((y == k).sum() * (x[y == k].mean() - x.mean()) ** 2 for k in range(3))
    ssw = sum(((x[y == k] - x[y == k].mean()) ** 2).sum() for k in range(3))
    assert abs(f - (ssb / 2) / (ssw / 197)) < 1e-6 * f
