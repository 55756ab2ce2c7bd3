"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from casekit.llm import hamming, queries, runs
from casekit.llm import whitening as whiten

DOCS = "doc_id long, text string, lang string, source string, fp string, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "x", 1) for i, t in rows], DOCS)


def save(spark, df, tmp_path, name="documents"):
    df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- 11: periodic runs ----------------------------------------------------------
def all_runs(w):
    """Every period, every stretch."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i: j + q]
            if len(s) >= max(6, 4 * q) and not any(s[e:] == s[:-e] for e in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def random_texts(n, seed, longest=60):
    rng = random.Random(seed)
    for _ in range(n):
        w = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.randrange(longest))]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 9)
            for i in range(a, min(len(w), a + rng.randrange(4 * p, 7 * p))):
                w[i] = w[a + (i - a) % p]
        yield w


def test_runs_against_brute_force():
    texts = list(random_texts(3000, 3))
    got = []
    for i in range(0, len(texts), 250):
        got += runs.word_runs([[x.encode() for x in w] for w in texts[i: i + 250]])
    assert got == [all_runs(w) for w in texts]
    assert sum(map(len, got)) > 1000


def test_runs_of_long_texts():
    n = 200_000
    assert runs.word_runs([[b"a"] * n, [b"x", b"y", b"z"] * n, [str(i).encode() for i in range(n)]]) == [
        [(0, n, 1)], [(0, 3 * n, 3)], []]
    shout = []  # one phrase, each time after another word: a node of as many classes as places
    for i in range(5000):
        shout += [str(i).encode(), b"p", b"q", b"r", b"s", b"t", b"u"]
    assert runs.word_runs([shout]) == [[]]


def test_op11_query_against_brute_force(spark, tmp_path):
    texts = [" ".join(w) for w in random_texts(300, 5, 90)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[7]), (None, "a a a a a a b"), (900, None), (901, ""),
            (902, " \t\r\n"), (903, "é é é é é é é"), (904, "a\x0ba\x0ca a a a\xa0a"), (905, "w " * 30_000)]
    rows += rows[:3]
    sf = save(spark, frame(spark, rows), tmp_path)
    got = queries.QUERIES["op11_periodic_runs"](spark, sf).collect()
    want = []
    for i, t in rows:
        w = planted(i, t) if i is not None else words_of(t)
        rs = all_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        drop = {k for s, n, q in rs for k in range(s + q, s + n)}
        best = max(rs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(rs), *((best[0], best[2], best[1], 1000 * best[1] // best[2]) if best else [None] * 4),
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in rs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert not queries.QUERIES["op11_periodic_runs"](spark, save(spark, frame(spark, []), tmp_path / "e")).collect()


# ---- 12: whitening ----------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string")


def reference(x):
    """Eigenvectors of the covariance of the distinct integer vectors by a dense solver."""
    x = np.unique(np.array(x), axis=0)
    c = (x * len(x) - x.sum(0)) / len(x)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    return x, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("d,n,decay", [(8, 40, 0.0), (48, 300, 0.0), (90, 400, 0.15), (64, 20, 0.0)])
def test_whitening_against_dense(spark, d, n, decay):
    rng = np.random.default_rng(d)
    data = rng.standard_normal((n, d)) * np.exp(-decay * np.arange(d)) * 3
    rows = [(i, v.tolist(), 1, "y") for i, v in enumerate(data)]
    rows += [(n + i, rows[i % 3][1], 1, "y") for i in range(50)]
    rows += [(2000, None, 1, "y"), (2001, [1.0, None] * (d // 2), 1, "y"), (2002, [float("inf")] * d, 1, "y"), (None, rows[4][1], 1, "y"),
             (2003, [float("nan")] * d, 1, "y"), (2004, [1.0], 1, "y"), (2005, [], 1, "y"), (2006, [1e30] * d, 1, "y")]
    out = whiten.whitened(whiten.lattice(vectors(spark, rows), "embedding")).toPandas()
    grid = np.floor(64 * np.float32(data).astype(float)).astype(np.int64) + 1_000_000
    x, e, v = reference(grid)
    k = min(16, d, n - 1)
    assert len(out) == k * (n + 51) and (out.n == len(x)).all() and out.vec_id.isna().sum() == k
    assert out.identity_error.max() < 1e-9
    for i in (0, n - 1):
        own = out[out.vec_id == i].sort_values("component")
        exact = sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(grid[i], x.sum(0)))
        assert (own.deviation == exact).all()
        assert np.allclose(own.explained, e[:k] / e.sum(), rtol=1e-9)
        white = ((len(x) * grid[i] - x.sum(0)) / len(x)) @ v[:, :k] / np.sqrt(e[:k])
        assert np.allclose(np.abs(own.whitened), np.abs(white), atol=1e-6)


def test_whitening_without_components(spark):
    for rows in ([], [(1, [1.0, 2.0], 1, "y")] * 3, [(1, [], 1, "y"), (2, [], 1, "y")], [(1, None, 1, "y")]):
        assert whiten.whitened(whiten.lattice(vectors(spark, rows), "embedding")).count() == 0


def test_whitening_of_large_entries(spark):
    far = float(1 << 44)
    rows = [(i, [far * (i % 3), float(i)], 1, "y") for i in range(30)]
    out = whiten.whitened(whiten.lattice(vectors(spark, rows), "embedding")).toPandas()
    assert set(out.component) == {1} and out.deviation.isna().any()  # beyond a long


# ---- 13: SimHash -------------------------------------------------------------------
def simhash(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i: i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, radius=4):
    """Component (a set) of each value by comparing all pairs."""
    values = np.array(sorted(set(values)), np.uint64)
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for v in values:
        for o in values[np.bitwise_count(values ^ v) <= radius]:
            root[find(int(o))] = find(int(v))
    return {v: find(v) for v in root}


def near_fingerprints(seed, groups, size, flips):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(size):
            out.append(base ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, flips + 1))}))
    return out


@pytest.mark.parametrize("radius,most", [(4, 1 << 13), (4, 40), (4, 1), (2, 5), (0, 1), (5, 20)])
def test_hamming_components(spark, radius, most):
    """With few rows allowed a node, everything goes through centres and deeper tables."""
    values = sorted({*near_fingerprints(1, 3, 150, 4), *near_fingerprints(2, 40, 4, 3), *near_fingerprints(3, 200, 1, 0)})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = hamming.hamming_components(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), radius, most)
    got = {} if found is None else {int(np.int64(r.id).view(np.uint64)): r.component for r in found.collect()}
    want = defaultdict(set)
    for v, c in linked(values, radius).items():
        want[c].add(v)
    parts = defaultdict(set)
    for v, c in got.items():
        parts[c].add(v)
    assert sorted(map(sorted, parts.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_op13_query_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ÀB", "Zz"]
    rows = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 4, 5, 30, 300]))
        rows.append((i, " ".join(w)))
        for j in range(3):
            c = list(w)
            for _ in range(j):
                if c:
                    c[rng.randrange(len(c))] = rng.choice(vocabulary)
            rows.append((1000 * (j + 1) - i, "\t".join(c).upper() if j == 0 and "É" not in c and "ÀB" not in c else "\n".join(c)))
    rows += [(None, rows[9][1]), (None, "never seen at all here"), (77_777, None), (77_778, " \n"), (77_779, "ab " * 20_000)] + rows[:2]
    got = queries.QUERIES["op13_simhash_index"](spark, save(spark, frame(spark, rows), tmp_path)).collect()
    prints = [simhash(t) for _, t in rows]
    part, low = linked(prints), defaultdict(list)
    for (i, _), f in zip(rows, prints):
        low[part[f]] += [i] if i is not None else []
    want = [(i, f"{f:016x}", min(low[part[f]], default=None)) for (i, _), f in zip(rows, prints)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert not queries.QUERIES["op13_simhash_index"](spark, save(spark, frame(spark, []), tmp_path / "e")).collect()
