"""Operator 4: fuzzy line dedup by MinHash over character shingles.

Equal normalized lines are one line by their hash. A line's signature has 16 minwise
values, min(h XOR c) over the hashes h of all its eight-character shingles, for random constants c. Bands are lines of the affine plane over
the field of four elements: any two of the 16 values share at most one
band, so the 16 bands of four overlap as little as possible. Lines that share a band meet in a node, which gives a star of
its lines; the components of all stars are clusters, and every pair that meets lies inside one. A cluster of bounded size gets its
texts once and is resolved in one task by the exact Jaccard similarity of the same shingles, line by line against those that are in
no component yet; of a larger cluster, each node is. Only nodes too large for that are compared with a pivot and divided
(``link_components``). The first line of each component stays. Shingles are compared as texts, in large nodes by
64-bit hashes where the counts are far from the threshold.

Recall of the bands at similarity 0.8 / 0.85 / 0.9: 0.989 / 0.997 / 0.9995 (simulated). Large nodes are
divided several ways at once (``child_nodes``): after five levels of division 0.986 / 0.995 are left.

Defined results: lines end at a line feed; lines are compared lower-cased and trimmed; null texts have no
lines, empty texts one blank line, and blank lines always stay; a line shorter than a shingle
is one shingle; a repeated document id holds the same places again, so the rows of
one place are kept or dropped together; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import components, link_components, maybe_broadcast, release_caches
from casekit.llm.neardup import cluster_links
from casekit.session import cut_lineage

SIMILARITY = 0.8
SHINGLE = 8
#: Shingles are cut from pieces of so many starts, since finding a place in a text takes time by its distance.
PIECE = 64
_PIECES = rf"(?s)(?=(.{{{SHINGLE},{PIECE + SHINGLE - 1}}})).{{1,{PIECE}}}"
#: Children of a large node.
FIRST, NEXT = 4, 2
#: Lines, and characters of all lines, of a cluster or node that is resolved in one task.
CLUSTER_ROWS, CLUSTER_SHINGLES = 1 << 13, 1 << 23
#: Distance from the threshold, in shingles, up to which shingles are compared as texts.
NEAR = 3
#: What ``\\s`` means in a regular expression.
BLANK = " \t\n\u000b\f\r"


def _constants(n: int) -> list[int]:
    r = random.Random(4)
    return [r.randrange(-(1 << 31), 1 << 31) for _ in range(n)]


def _times(a: int, b: int) -> int:
    """Product in the field of four elements."""
    p = (a if b & 1 else 0) ^ (a << 1 if b & 2 else 0)
    return p ^ 7 if p & 4 else p


def bands(slopes: int = 3) -> list[list[int]]:
    """Lines of the affine plane of 16 points: the columns, and those of the first ``slopes`` slopes."""
    upright = [[x * 4 + y for y in range(4)] for x in range(4)]
    return upright + [[x * 4 + (_times(m, x) ^ c) for x in range(4)] for m in range(slopes) for c in range(4)]


def child_nodes(node: Column, values: Column, level: int) -> list[Column]:
    """The children of a large node for a line with these ``values``, each by another coordinate: with FIRST
    children at the first level and NEXT below, a similar pair is divided about as seldom as it misses all bands."""
    first = F.pmod(F.xxhash64(F.lit(level), node), F.lit(16)).cast("int")
    pick = lambda c: F.pmod(first + F.lit(5 * c), F.lit(16))
    return [F.xxhash64(F.lit(c), node, F.get(values, pick(c))) for c in range(FIRST if level == 1 else NEXT)]


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no`` (from 0), ``line`` (normalized), ``id`` (its hash; null for blank lines)."""
    # outer: else a filter on the lines' number is put below, which splits every text twice
    x = docs.select(F.col("doc_id").cast("long"),
                    F.posexplode_outer(F.split(F.lower("text"), "\n", -1)).alias("line_no", "raw"))
    x = x.where("line_no IS NOT NULL").select("doc_id", "line_no", F.trim("raw").alias("line"))
    return x.withColumn("id", F.when(F.btrim("line", F.lit(BLANK)) != "", F.xxhash64("line")))


def _pieces(line: Column) -> Column:
    return F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(
        F.regexp_extract_all(line, F.lit(_PIECES), F.lit(1)))


def _starts(piece: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.char_length(piece) - (SHINGLE - 1), F.lit(1)))


def hash_set(line: Column) -> Column:
    """Distinct 64-bit hashes of a line's shingles."""
    return F.array_distinct(F.flatten(F.transform(_pieces(line), lambda p: F.transform(
        _starts(p), lambda i: F.xxhash64(F.substring(p, i, F.lit(SHINGLE)))))))


def exact_set(line: Column) -> Column:
    """A line's distinct shingles, of whole characters (a regular expression would also start within a surrogate pair)."""
    return F.array_distinct(F.flatten(F.transform(_pieces(line), lambda p: F.transform(
        _starts(p), lambda i: F.substring(p, i, F.lit(SHINGLE))))))


def exact_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two lines' shingle sets; the lambda holds the sets, so each is made once."""
    sets = F.array(F.struct(exact_set(x).alias("x"), exact_set(y).alias("y")))
    counts = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"),
                                                  (F.size(s["x"]) + F.size(s["y"])).alias("all")))
    return F.element_at(F.transform(counts, lambda c: c["both"] / (c["all"] - c["both"])), 1)


def similar(x: Column, y: Column, similarity: float) -> Column:
    """Whether two lines have this Jaccard similarity."""
    sets = F.array(F.struct(hash_set(x).alias("x"), hash_set(y).alias("y")))
    counts = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"),
                                                  (F.size(s["x"]) + F.size(s["y"])).alias("all")))
    over = F.transform(counts, lambda c: c["both"] - similarity * (c["all"] - c["both"]))
    return F.element_at(F.transform(over, lambda o: F.when(
        F.abs(o) <= NEAR, exact_similarity(x, y) >= similarity - 1e-9).otherwise(o > 0)), 1)


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)


def _joined(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = h ^ k
    return (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)


def _hashes(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``F.hash`` of the strings of ``size`` bytes from the places ``first`` of ``buf`` on, which ends with 32 more bytes."""
    word = buf[:-3].astype(np.uint32)
    for i in range(1, 4):
        word |= buf[i: len(buf) - 3 + i].astype(np.uint32) << np.uint32(8 * i)
    word = _mixed(word)
    if len(first) and size.min() == size.max() == SHINGLE:  # no characters but ASCII
        h = _joined(_joined(np.uint32(42), word[first]), word[first + 4])
    else:
        h = np.full(len(first), 42, np.uint32)
        for i in range(0, int(size.max(initial=0)) - 3, 4):
            h = np.where(size >= i + 4, _joined(h, word[first + i]), h)
        tail = first + (size & ~3)
        for i in range(3):
            k = _mixed(buf[tail + i].view(np.int8).astype(np.int32).view(np.uint32))
            h = np.where((size & 3) > i, _joined(h, k), h)
    h = h ^ size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def minwise(texts: list[bytes]) -> np.ndarray:
    """The 16 minwise values of nonempty lines, a row each, over the shingles that ``exact_set`` holds."""
    buf = np.frombuffer(b"".join(texts) + bytes(32), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    at = np.flatnonzero((buf[: ends[-1]] & 0xC0) != 0x80)  # where characters begin
    stop = np.searchsorted(at, ends)  # of each line, in characters
    start = np.append(0, stop[:-1])
    count = np.maximum(stop - start - (SHINGLE - 1), 1)
    shift = np.cumsum(count) - count
    char = np.arange(int(count.sum())) + np.repeat(start - shift, count)
    first, after = at[char], np.append(at, ends[-1])
    h = _hashes(buf, first, after[np.minimum(char + SHINGLE, np.repeat(stop, count))] - first)
    return np.stack([np.minimum.reduceat(h ^ np.int32(c), shift) for c in _constants(16)], 1)


def line_sets(texts: list[str]) -> list[np.ndarray]:
    """Every line's ``exact_set`` as numbers; equal numbers are equal shingles of these lines, and only those."""
    size = np.array([len(t) for t in texts])
    pad = "\0" * (SHINGLE - 1)  # told from a character 0 by its rank
    chars = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    last = np.cumsum(size + SHINGLE - 1)
    first = last - size - (SHINGLE - 1)
    chars[(last[:, None] - 1 - np.arange(SHINGLE - 1)).ravel()] = 0
    width, rank = 1, np.unique(chars, return_inverse=True)[1]
    if rank.max() < 256:
        value = rank[: len(rank) - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            value |= rank[i: len(rank) - SHINGLE + 1 + i] << 8 * i
    else:  # numbers of 1, 2, 4 and 8 characters
        value = rank
        while width < SHINGLE:
            value = np.unique(value[:-width] * (int(value.max()) + 1) + value[width:], return_inverse=True)[1]
            width *= 2
    count = np.maximum(size - (SHINGLE - 1), 1)
    return [np.unique(value[f: f + c]) for f, c in zip(first.tolist(), count.tolist())]


def signatures(lines: DataFrame) -> DataFrame:
    """``id, m0 .. m15`` of every row with an id: minwise values over the shingles that ``exact_set`` holds."""

    def pieces(line: pa.Array):
        """Rows of lines with and without characters beyond ASCII, in runs of some 64 KB."""
        plain = pc.string_is_ascii(line).to_numpy(zero_copy_only=False)
        for rows in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            run = np.cumsum(pc.binary_length(line).to_numpy()[rows]) >> 16
            if len(rows):
                yield from np.split(rows, np.flatnonzero(np.diff(run)) + 1)

    def task(batches):
        release_caches()
        for b in batches:
            ids, rows = np.unique(b.column("id").to_numpy(), return_index=True)
            line, sig = b.column("line").take(pa.array(rows)), np.empty((len(rows), 16), np.int32)
            for p in pieces(line):
                sig[p] = minwise(line.take(pa.array(p)).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.ascontiguousarray(c)) for c in sig.T]],
                                             names=["id", *[f"m{i}" for i in range(16)]])

    return lines.where("id IS NOT NULL").select("id", "line").mapInArrow(
        task, "id long, " + ", ".join(f"m{i} int" for i in range(16)))


def meetings(rows: DataFrame) -> DataFrame:
    """Of ``rows(node, id)`` a star in each node: ``node, a, b`` with the node's smallest id and another one. Sorted rows
    pass through a task, which holds no node."""

    def task(batches):
        node, low, last = None, None, None
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            nodes, ids = batch.column("node").to_numpy(), batch.column("id").to_numpy()
            new = np.append(node is None or nodes[0] != node, nodes[1:] != nodes[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            lows = np.where(first < 0, low if low is not None else 0, ids[first])
            before = np.append(last if last is not None else 0, ids[:-1])
            keep = ~new & (ids != lows) & (ids != before)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (nodes, lows, ids)], names=["node", "a", "b"])
            node, low, last = nodes[-1], lows[-1], ids[-1]

    dealt = rows.repartition("node").sortWithinPartitions("node", "id")
    return dealt.mapInArrow(task, "node long, a long, b long")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, small: int = 32) -> DataFrame:
    """One row per line: ``doc_id, line_no``, the place of the first line of its component
    (``rep_doc_id, rep_line_no``) and ``kept``."""
    lines = line_table(docs)
    keys = [F.xxhash64(F.lit(i), *[F.col(f"m{j}") for j in band]) for i, band in enumerate(bands())]
    met = cut_lineage(meetings(signatures(lines).select("id", F.explode(F.array(*keys)).alias("node"))))
    clusters = cut_lineage(components(met.select("a", "b")).withColumnRenamed("component", "cluster"))
    # a line without an id meets nothing: its own key keeps such lines out of one task
    key = F.coalesce("id", F.xxhash64("doc_id", "line_no"))
    need = clusters.select(F.col("id").alias("key"), F.lit(True).alias("needed"))
    place = cut_lineage(lines.withColumn("key", key).join(maybe_broadcast(need), "key", "left").select(
        "key", "doc_id", "line_no", "id", F.when(F.col("id").isNotNull() & F.col("needed"), F.col("line")).alias("line")))
    text = cut_lineage(place.where("line IS NOT NULL").groupBy("id").agg(F.first("line").alias("line")))
    place = place.drop("line")
    labels = _line_links(met, clusters, text, similarity, small)
    place = place.withColumn("comp", F.col("key"))
    if labels is not None:
        labels = labels.select(F.col("id").alias("key"), F.col("component").alias("c"))
        place = place.join(maybe_broadcast(labels), "key", "left").withColumn("comp", F.coalesce("c", "key"))
    first = (place.where("id IS NOT NULL").groupBy("comp").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("rep")).where("n > 1").drop("n"))
    place = place.join(maybe_broadcast(cut_lineage(first)), "comp", "left")
    place = place.withColumn("rep", F.when(F.col("id").isNotNull(), F.col("rep")))
    own = F.struct("doc_id", "line_no")
    rep = F.coalesce("rep", own)
    return place.select("doc_id", "line_no", rep["doc_id"].alias("rep_doc_id"), rep["line_no"].alias("rep_line_no"),
                        (F.col("rep").isNull() | rep.eqNullSafe(own)).alias("kept"))


def _line_links(met: DataFrame, clusters: DataFrame, text: DataFrame, similarity: float, small: int) -> DataFrame | None:
    """``id, component`` of the lines that links unite: clusters of lines that meet are resolved in a task each, the nodes of larger
    clusters likewise, and only nodes too large for that by ``link_components``."""
    percent = 100 * similarity - 1e-7
    sized = cut_lineage(clusters.join(text.select("id", F.char_length("line").alias("w")), "id"))
    bulk = F.count("*").alias("m"), F.sum("w").alias("w")
    over = (F.col("m") > CLUSTER_ROWS) | (F.col("w") > CLUSTER_SHINGLES)
    large = cut_lineage(sized.groupBy("cluster").agg(*bulk).where(over).select("cluster"))
    few, rows = sized, None
    if not large.isEmpty():
        few = sized.join(maybe_broadcast(large), "cluster", "left_anti")
        inside = sized.join(maybe_broadcast(large), "cluster", "left_semi").select("id", "w")
        stars = met.join(maybe_broadcast(cut_lineage(inside)), met["a"] == F.col("id"), "left_semi")
        parts = stars.select("node", F.col("b").alias("id")).union(stars.select("node", F.col("a").alias("id")).distinct())
        parts = parts.join(sized.select("id", "w"), "id")
        nodes = cut_lineage(parts.groupBy("node").agg(*bulk).select("node", over.alias("hot")))
        parts = cut_lineage(parts.join(maybe_broadcast(nodes), "node"))
        few = few.select("id", "cluster").union(parts.where("NOT hot").select("id", F.col("node").alias("cluster")))
        rows = parts.where("hot").select("node", "id", F.lit(0).alias("size"))
    few = few.join(text.withColumnRenamed("line", "text"), "id")
    links = cut_lineage(cluster_links(few, percent, line_sets))
    labels = None if links.isEmpty() else components(links)
    if rows is None or rows.isEmpty():
        return labels
    sig = cut_lineage(signatures(text.join(rows.select("id").distinct(), "id")))
    values = F.array(*[F.col(f"m{j}") for j in range(16)])

    def children(r, level):
        nodes = F.explode(F.array(*child_nodes(F.col("node"), values, level)))
        return r.join(sig, "id").select(nodes.alias("node"), "id", "size")

    def verify(pairs):
        p = (pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
             .join(text.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))
        return p.where(similar(F.col("x"), F.col("y"), similarity)).select("a", "b")

    more = link_components(rows, children, verify, small)
    if more is None or labels is None:
        return labels if more is None else more
    return cut_lineage(components(more.union(labels).toDF("a", "b")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text`` with the dropped lines taken out."""
    gone = dedup_lines(docs, **options).where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    docs, gone = docs.select("doc_id", "text"), gone.withColumnRenamed("doc_id", "gone_id")
    d = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left")
    stay = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    return d.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"))
