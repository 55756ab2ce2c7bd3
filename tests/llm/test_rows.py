"""Row identity of the filtering stages, cluster resolution of the near-duplicate join, byte-true broadcasts."""
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.llm import common, decontaminate, lines, neardup, quality

DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web") for i, t in rows], DOCS)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) for _ in range(n))


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_keep_one_tells_rows_without_an_id_apart(spark):
    a, b, c, d = (prose(60, i) for i in range(4))
    rows = [(None, a), (4, a), (None, b), (7, c), (7, d), (None, None), (9, ""), (7, c)]
    kept = neardup.keep_one(frame(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert plain(kept) == sorted([(4, a), (None, b), (7, c), (7, d), (None, None), (9, "")], key=str)
    same = [(7, c), (7, c + " more"), (None, c)]  # near copies under one id and none
    assert plain(neardup.keep_one(frame(spark, same))) in ([(7, c)], [(7, c + " more")])


def test_keep_clean_and_keep_good_tell_rows_apart(spark):
    item = prose(20, 50)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    dirty = f"{prose(20, 51)} {item} {prose(20, 52)}"
    rows = [(None, dirty), (None, prose(50, 53)), (5, dirty), (5, prose(50, 54)), (6, prose(50, 55)), (None, None)]
    assert plain(decontaminate.keep_clean(frame(spark, rows), bench)) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    good = [(i, prose(80, 100 + i)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    junk = "#@!% 0101 %%%% ^^&& 9999 ((( ]]] 7777 @@@@ 0000 !!!! " * 30
    mixed = good + [(None, junk), (None, good[3][1]), (300, junk), (300, good[4][1])]
    kept = plain(quality.keep_good(frame(spark, mixed), labels))
    assert [r for r in mixed[60:] if r not in kept] == [(None, junk), (300, junk)]


def test_broadcast_sizes_are_measured(spark):
    df = spark.range(200).select("id", F.array_repeat(F.rpad(F.lit("x"), 1000, "x"), 10).alias("shingles")).cache()
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(common.maybe_broadcast(df, 4 << 20)) and not hinted(common.maybe_broadcast(df, 1 << 20))


def pairs_brute(texts, percent):
    sets = [neardup.shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if len(sets[i]) and len(sets[j]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), i), i)
    return [least[find(i)] for i in range(len(texts))]


@pytest.mark.parametrize("bounds", [{}, {"NODE_ROWS": 20}, {"CLUSTER_ROWS": 15}, {"CLUSTER_SHINGLES": 900, "NODE_ROWS": 40}])
def test_a_large_group_of_near_copies(spark, monkeypatch, bounds):
    """Many variants of one text, some linked and some not: every path gives the components of all pairs."""
    for name, value in bounds.items():
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(8)
    base = prose(120, 9).split()
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = prose(1, rng.random())
        texts.append(" ".join(w))
    texts += [prose(100, 1000 + i) for i in range(30)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    want = pairs_brute(texts, 85)
    assert len(set(want)) < 100
    assert [got[i] for i in range(len(texts))] == want


# ---- connected components ----------------------------------------------------------
@pytest.mark.parametrize("piece", [1 << 18, 200])
def test_components_of_chains_and_stars(spark, monkeypatch, piece):
    monkeypatch.setattr(common, "PIECE_EDGES", piece)
    r = random.Random(4)
    ids = r.sample(range(-5000, 5000), 900)
    edges = list(zip(ids[:300], ids[1:300])) + [(ids[300], i) for i in ids[300:600]]
    edges += [(r.choice(ids[600:]), r.choice(ids[600:])) for _ in range(250)]
    root = {i: i for e in edges if e[0] != e[1] for i in e}
    for a, b in edges:
        if a != b:
            x, y = root[a], root[b]
            root = {i: min(x, y) if c in (x, y) else c for i, c in root.items()}
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == len(root) and {x.id: x.component for x in got} == root


def test_components_of_few_edges_take_few_files(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    edges = spark.range(2000).selectExpr("id AS a", "id + 1 AS b").repartition(7)
    common.components(edges).collect()
    assert len(set(os.listdir(folder)) - before) <= 2  # 12 before pieces were contracted


# ---- 4 fuzzy lines ---------------------------------------------------------------------
def odd_lines():
    r = random.Random(1)
    kinds = ["abcd efgh", "abc dé漢\U0001f600ÿxyz"]
    return ["".join(r.choice(kinds[k % 2]) for _ in range(r.randint(1, 60))) for k in range(120)] + ["a", "é", "\U0001f600" * 3, "abcdefgh"]


def grams(x):
    return {x[j: j + 8] for j in range(len(x) - 7)} if len(x) >= 8 else {x}


def test_line_signatures_are_those_of_every_shingle(spark):
    df = spark.createDataFrame(list(enumerate(odd_lines())), "id long, line string")
    got = {x.id: x for x in lines.signatures(df).collect()}
    cut = lambda i: F.hash(F.substring("line", i, F.lit(8)))
    for x in df.select("id", F.transform(lines._starts(F.col("line")), cut).alias("h")).collect():
        assert [got[x.id][f"m{i}"] for i in range(16)] == [min(h ^ c for h in x.h) for c in lines._constants(16)]


@pytest.mark.parametrize("more", [[], ["".join(chr(300 + i) for i in range(300))]])
def test_line_sets_are_exact(more):  # with few and with many characters
    texts = odd_lines() + more
    sets, want = lines.line_sets(texts), [grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


@pytest.mark.parametrize("rows, shingles", [(1 << 13, 1 << 23), (20, 1 << 23), (1 << 13, 1500), (1, 1)])
def test_line_clusters_whatever_the_bounds(spark, monkeypatch, rows, shingles):
    """Many variants of one line, some linked and some not: whole clusters, nodes and pairs give the same components."""
    monkeypatch.setattr(lines, "CLUSTER_ROWS", rows)
    monkeypatch.setattr(lines, "CLUSTER_SHINGLES", shingles)
    r = random.Random(8)
    base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz\U0001f600\U0001f680") for _ in range(90))
    texts = [base]
    for _ in range(70):
        t = list(r.choice(texts))
        t[r.randrange(len(t))] = r.choice("ABC#0123")
        texts.append("".join(t).lower())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            s, t = grams(texts[a]), grams(texts[b])
            if len(s & t) >= 0.8 * len(s | t):
                x, y = sorted((root[a], root[b]))
                root = [x if c == y else c for c in root]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id: x.rep_doc_id for x in got.collect()} == dict(enumerate(root))


def test_lines_that_meet_are_not_paired(spark):
    """Lines below the threshold that share buckets: the plan has no join of pairs, whose rows grew with a group's square."""
    r = random.Random(2)
    base = "".join(r.choice("abcdefgh") for _ in range(120))
    texts = [base[:r.randrange(60, 110)] + "".join(r.choice("xyz0123") for _ in range(40)) for _ in range(30)]
    asked = []
    whole = lines.similar
    lines.similar = lambda *a: asked.append(a) or whole(*a)
    try:
        lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        lines.similar = whole
    assert not asked
