"""Operator 10: near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Equal sets are one class. Classes
walk down independent random trees: a node's members are divided by the token that a
selected minwise coordinate gives them (on average 1/SIMILARITY coordinates per
node, so that a similar pair stays together at about the rate at which paths branch).
Small nodes (up to ``NODE_ROWS``) are compared exhaustively: in one task, by all coordinates, of which a spanning forest of the
pairs that may be links leaves the task. The components of these are candidate clusters; every link lies
inside one. A cluster of bounded size gets its full sets once and is resolved exactly in one task, member by member of
a component against those that are in none yet; of a larger cluster, the members of each node are. Larger nodes are compared
with a pivot and divided again, pair by pair (``link_components``). Every link is confirmed on the full sets.

A minwise coordinate is min(h XOR c) over the set's hashes h for a random constant c.

Defined results: null, empty and wordless texts have an empty set, n_shingles 0, and
are linked with nothing; fewer than five words are one shingle, the whole sequence.
Rows with a null id take part, but a null id names no component: theirs is
null unless a row with an id is reachable, and they are kept only if the component is
null. Repeated rows get equal results; an empty table gives no rows. Columns
other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import components, least_equal, link_components, maybe_broadcast, release_caches, small_batches
from casekit.session import cut_lineage

WORDS = 5
#: Link from this similarity in per cent on.
PERCENT = 85
TREES = 10
COORDINATES = 64
#: Sets from this size on are compared by their coordinates before the full sets (``least_equal``).
ESTIMATE_FROM = 64

#: Members of a node that are compared in one task.
NODE_ROWS = 1 << 12
#: Members, and shingles of all members, of a cluster that is resolved in one task.
CLUSTER_ROWS, CLUSTER_SHINGLES = 1 << 13, 1 << 23

_RNG = np.random.default_rng(10)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_XOR = _RNG.integers(0, 1 << 64, COORDINATES, np.uint64)
_P, _MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(32)
_WORD = np.array([not (c == 0x20 or 9 <= c <= 13) for c in range(256)])
_POWERS = np.ones(1, np.uint64)
_NO_ID = 1 << 62


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    global _POWERS
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    buf = np.frombuffer(data, np.uint8)
    word = _WORD[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(buf)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    place[~word] = 0
    if (longest := int(place.max())) >= len(_POWERS):
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest * 2, _P)]))
    value = _BYTE[buf] * _POWERS[place]
    value[~word] = 0
    w = _mix(np.add.reduceat(value, starts))
    n = len(w) - WORDS + 1
    if n < 1:
        return _mix((w * _PLACE[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    h = w[:n] * _PLACE[0]
    for i in range(1, WORDS):
        h += w[i: n + i] * _PLACE[i]
    return np.unique(_mix(h))


def minwise(s: np.ndarray) -> np.ndarray:
    """The tokens (32 bits) of all coordinates of a nonempty set."""
    low = None
    for i in range(0, len(s), 8192):
        part = (s[None, i: i + 8192] ^ _XOR[:, None]).min(1)
        low = part if low is None else np.minimum(low, part)
    return (low ^ _XOR).astype(np.uint32).view(np.int32)


def _row_key() -> tuple[Column, Column]:
    """A row's id, or for null ids a number far above all ids from its text, and a digest that tells texts of one id apart."""
    other = F.lit(_NO_ID) + F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(_NO_ID))
    return F.coalesce(F.col("doc_id").cast("long"), other), F.xxhash64("text")


def _with_key(docs: DataFrame) -> DataFrame:
    """``id, th`` (see ``_row_key``) and ``text``."""
    id_, th = _row_key()
    return docs.select(id_.alias("id"), th.alias("th"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """``id, th, n, sid, sig``: size, digest and coordinates of every document's set."""

    def task(batches):
        release_caches()
        for b in batches:
            n, sid, sig = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                sid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(minwise(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
                 pa.array(sig, pa.list_(pa.int32()))], names=["id", "th", "n", "sid", "sig"])

    return _with_key(docs).mapInArrow(task, "id long, th long, n long, sid binary, sig array<int>")


def confirm(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``(a, b, ta, tb)`` the pairs whose full sets are alike."""

    def task(batches):
        last, s = None, None
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if last is None or ta != last:
                    last, s = ta, shingle_set(ta)
                t = shingle_set(tb)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return texts.select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def _whole(batches, key: str):
    """Groups of Arrow rows with one value of ``key`` from batches sorted by it, many small groups at a time:
    ``(table, first rows of the groups)``."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(key)[-1]
        if held[0].column(key)[0] == last:
            continue  # one group so far
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        end = int(np.searchsorted(keys, last.as_py()))
        yield table.slice(0, end), np.flatnonzero(np.append(True, keys[1:end] != keys[: end - 1]))
        held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def _edges(a: list, b: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _forest(size: int, near) -> list[tuple[int, np.ndarray]]:
    """A spanning forest of 0..size-1 under ``near(v, others)``: which of ``others`` are linked with v."""
    edges, free = [], np.arange(size)
    while len(free) > 1:
        todo, free = [int(free[0])], free[1:]
        while todo and len(free):
            v = todo.pop()
            hit = near(v, free)
            if hit.any():
                edges.append((v, free[hit]))
                todo += free[hit].tolist()
                free = free[~hit]
    return edges


def _may_link(n: np.ndarray, sig: np.ndarray, percent: int):
    """By sizes and coordinates: can these sets be links? No link is passed over (but for ``least_equal``'s five sigma)."""
    least = least_equal(percent / 100, COORDINATES)

    def near(v, others):
        small, large = np.minimum(n[others], n[v]), np.maximum(n[others], n[v])
        ok = 100 * small >= percent * large
        ok[ok] &= (small[ok] < ESTIMATE_FROM) | ((sig[others[ok]] == sig[v]).sum(1) >= least)
        return ok

    return near


def candidate_links(rows: DataFrame, percent: int) -> DataFrame:
    """Of ``rows(node, id, n, sig)`` a spanning forest ``a, b`` of each node's possible links."""

    def task(batches):
        for table, starts in _whole(batches, "node"):
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            a, b = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                for v, others in _forest(e - s, _may_link(n[s:e], sig[s:e], percent)):
                    a.append(np.repeat(ids[s + v], len(others)))
                    b.append(ids[s + others])
            yield _edges(a, b)

    dealt = rows.select("node", "id", "n", "sig").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(task, "a long, b long").distinct()


class _Holders:
    """Which of a cluster's sets hold each shingle, so that one set's intersections with all others are one count."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets])
        _, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = held[number] > 1  # a shingle that one set holds is in no intersection
        owner = np.repeat(np.arange(len(sets)), self.n)[several]
        number = number[several]
        self.owner = owner[np.argsort(number, kind="stable")].astype(np.int32)
        self.ends = np.cumsum(held * (held > 1))
        self.own = np.split(number, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])

    def intersections(self, v: int) -> np.ndarray:
        ends = self.ends
        parts = [self.owner[ends[t - 1] if t else 0: ends[t]] for t in self.own[v].tolist()]
        return np.bincount(np.concatenate(parts), minlength=len(self.n)) if parts else np.zeros(len(self.n), np.int64)


def cluster_links(rows: DataFrame, percent: float, sets: Callable[[list[str]], list[np.ndarray]] | None = None) -> DataFrame:
    """Of ``rows(cluster, id, text)`` a spanning forest ``a, b`` of each cluster's links, on full sets. ``sets`` makes
    the sets of a cluster's texts, as numbers that tell the cluster's shingles apart (default: ``shingle_set`` of each)."""

    def task(batches):
        for table, starts in _whole(batches, "cluster"):
            ids, texts = table.column("id").to_numpy(), table.column("text")
            a, b = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                own = [texts[i].as_py() for i in range(s, e)]
                holders = _Holders(sets(own) if sets else [shingle_set(t) for t in own])

                def near(v, others, h=holders):
                    both = h.intersections(v)[others]
                    return 100 * both >= percent * (h.n[v] + h.n[others] - both)

                for v, others in _forest(e - s, near):
                    a.append(np.repeat(ids[s + v], len(others)))
                    b.append(ids[s + others])
            yield _edges(a, b)

    dealt = rows.select("cluster", "id", "text").repartition("cluster").sortWithinPartitions("cluster")
    return dealt.mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, trees: int = TREES, small: int = 32) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    d = _resolved(docs, percent, trees, small)
    own = F.when(F.col("id") < _NO_ID, F.col("id"))
    component = F.when(F.col("component") < _NO_ID, F.col("component"))
    return d.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                    own.eqNullSafe(component).alias("kept"))


def _resolved(docs: DataFrame, percent: int, trees: int, small: int) -> DataFrame:
    """``id, th, n`` of every row (see ``_with_key``), and the smallest ``(id, th)`` reachable: ``component, first``."""
    d = cut_lineage(sketches(small_batches(docs)))
    groups = cut_lineage(d.where("n > 0").groupBy("sid").agg(
        F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.count("*").alias("copies")))
    # a class is named by its smallest id; where texts of other classes share that id, by a key above all ids
    shared = groups.groupBy(F.col("rep.id").alias("id")).agg(F.count("*").alias("c"), F.min("rep.th").alias("first"))
    shared = cut_lineage(shared.where("c > 1").drop("c"))
    classes = groups.select(F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), "sid", "n", "sig", "copies")
    classes = classes.join(maybe_broadcast(shared), "id", "left").withColumn("k", F.when(
        F.col("first") < F.col("th"), F.lit(_NO_ID) + F.pmod(F.xxhash64("id", "th"), F.lit(_NO_ID))).otherwise(F.col("id")))
    if not shared.isEmpty():
        classes = cut_lineage(classes)
    def children(rows, level):
        # the roots choose one coordinate a child, deeper nodes two at once; a node has 1 / (chance that a pair
        # at the threshold shares a child) children on average: one, and a second in ``extra`` of 100 nodes
        width = 1 if level == 0 else 2
        extra = round(100 / (percent / 100) ** width - 100)
        pick = lambda salt: F.pmod(F.xxhash64(F.lit(level), F.lit(salt), "node"), F.lit(COORDINATES)).cast("int")
        child = lambda c: F.xxhash64(F.lit(c), "node", *[F.get("sig", pick(2 * c + w)) for w in range(width)])
        two = F.pmod(F.xxhash64(F.lit(level), F.lit(-1), "node"), F.lit(100)) < extra
        nodes = F.when(two, F.array(child(0), child(1))).otherwise(F.array(child(0)))
        return rows.select(F.explode(nodes).alias("node"), "id", F.col("n").alias("size"))

    sets = classes.select(F.col("k").alias("id"), "n", "sig")
    roots = sets.select("id", "n", "sig", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    rows = children(roots.select(F.xxhash64(F.lit("tree"), "tree").alias("node"), "id", "n", "sig"), 0)

    def verify(pairs):
        p = (pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
             .join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b"))
        equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        p = cut_lineage(p.where((F.least("na", "nb") < ESTIMATE_FROM) | (equal >= least_equal(percent / 100, COORDINATES))).select("a", "b"))
        if p.isEmpty():
            return p
        need = cut_lineage(p.select(F.col("a").alias("k")).union(p.select("b")).distinct()
                           .join(classes.select("k", "id", "th"), "k"))
        text = cut_lineage(_with_key(docs).join(maybe_broadcast(need), ["id", "th"]).select("k", "text")
                           .dropDuplicates(["k"]))
        p = (p.join(text.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")
             .join(text.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a"))
        return confirm(p, percent)

    def with_text(ids):
        """``id, text`` of classes."""
        need = cut_lineage(ids.select(F.col("id").alias("k")).join(classes.select("k", "id", "th"), "k"))
        return cut_lineage(_with_key(docs).join(maybe_broadcast(need), ["id", "th"]).select(F.col("k").alias("id"), "text")
                           .dropDuplicates(["id"]))

    nodes = cut_lineage(rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"))
    met = cut_lineage(rows.join(maybe_broadcast(nodes), "node").select("node", "id", "size", (F.col("m") > NODE_ROWS).alias("hot")))
    edges = cut_lineage(candidate_links(met.where("NOT hot").select("node", "id").join(sets, "id"), percent))
    labels = None
    if not edges.isEmpty():
        clusters = cut_lineage(components(edges).join(sets.select("id", "n"), "id").withColumnRenamed("component", "cluster"))
        size = clusters.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
        large = cut_lineage(size.where((F.col("m") > CLUSTER_ROWS) | (F.col("w") > CLUSTER_SHINGLES)).select("cluster"))
        some = cut_lineage(clusters.join(maybe_broadcast(large), "cluster", "left_anti").select("id", "cluster"))
        # members of a larger cluster are resolved node by node: a link's ends share a node
        parts = met.where("NOT hot").join(maybe_broadcast(cut_lineage(clusters.join(maybe_broadcast(large), "cluster", "left_semi"))), "id")
        parts = cut_lineage(parts.withColumn("part", F.xxhash64("node", "cluster")).select("node", "part", "id", "n", "size"))
        bulk = parts.groupBy("part").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1")
        bulk = cut_lineage(bulk.select("part", (F.col("w") > CLUSTER_SHINGLES).alias("heavy")))
        parts = cut_lineage(parts.join(maybe_broadcast(bulk), "part"))
        few = some.select("id", "cluster").unionByName(parts.where("NOT heavy").select("id", F.col("part").alias("cluster")))
        texts = with_text(few.select("id").distinct())
        links = cut_lineage(cluster_links(few.join(texts, "id"), percent).distinct())
        if not links.isEmpty():
            labels = cut_lineage(components(links))
        met = met.select("node", "id", "size", "hot").unionByName(parts.where("heavy").select("node", "id", "size", F.lit(True).alias("hot")))
    hot = met.where("hot").select("node", "id", "size")
    if not hot.isEmpty():
        more = link_components(hot, lambda r, level: children(r.join(sets.select("id", "n", "sig"), "id"), level),
                               verify, small, percent / 100)
        if more is not None:
            labels = more if labels is None else cut_lineage(components(more.union(labels).toDF("a", "b")))
    other = cut_lineage(classes.where("copies > 1 OR k <> id").select(
        "sid", "k", F.col("id").alias("rep"), F.col("th").alias("rep_th")))
    d = d.join(maybe_broadcast(other), "sid", "left").select(
        "id", "th", "n", F.coalesce("k", "id").alias("k"), F.coalesce("rep", "id").alias("component"), F.coalesce("rep_th", "th").alias("first"))
    if labels is not None:  # a component is named by the smallest id of its classes
        named = labels.withColumnRenamed("id", "k").join(classes.select("k", "id", "th"), "k")
        names = named.groupBy("component").agg(F.min(F.struct("id", "th")).alias("name"))
        named = cut_lineage(named.select("k", "component").join(names, "component").select("k", "name"))
        d = d.join(maybe_broadcast(named), "k", "left").withColumns({
            "component": F.coalesce("name.id", "component"), "first": F.coalesce("name.th", "first")})
    return d.select("id", "th", "n", "component", "first")


def keep_one(docs: DataFrame, percent: int = PERCENT, trees: int = TREES, small: int = 32) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id, then text digest.

    Rows are told apart by id and text, those without an id by 126 bits of their text: different texts under one id, or under
    none, are documents of their own. Of rows equal in both one stays."""
    r = cut_lineage(_resolved(docs, percent, trees, small))
    gone = cut_lineage(r.where("id <> component OR th <> first").select(F.col("id").alias("_gid"), F.col("th").alias("_gth")).distinct())
    out = docs.withColumns(dict(zip(("_id", "_th"), _row_key())))
    out = out.join(maybe_broadcast(gone), (out["_id"] == gone["_gid"]) & (out["_th"] == gone["_gth"]), "left_anti")
    twice = cut_lineage(r.groupBy("id", "th").agg(F.count("*").alias("m")).where("m > 1").select(F.col("id").alias("_gid"), F.col("th").alias("_gth")))
    if not twice.isEmpty():
        same = (out["_id"] == twice["_gid"]) & (out["_th"] == twice["_gth"])
        again = out.join(maybe_broadcast(twice), same, "left_semi").dropDuplicates(["_id", "_th"])
        out = out.join(maybe_broadcast(twice), same, "left_anti").unionByName(again)
    return out.select(*docs.columns)
