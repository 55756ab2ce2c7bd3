"""Operator 13: near-duplicate documents by SimHash and multi-index hashing.

A text's words (A-Z lower-cased) give four-word shingles, repeats included; a fingerprint bit
is set if it is set in over half of their XXH64 values. Fingerprints link at ``RADIUS`` or fewer
differing bits, and documents are classed by the links' components.

Multi-index hashing: the 64 bits are cut into ``SEGMENTS`` segments. Two fingerprints within the radius
are within 1, 1 or 0 bits in the first, second or third segment (pigeonhole: else they differ in
2 + 2 + 1 bits). So every distinct fingerprint enters the tables of its segments under the values of a
small Hamming ball, and those that meet under a value are compared over all 64 bits. Only the
upper half of a ball is enumerated (zero bits set, never one bits cleared): two segment values
within r bits both reach their bitwise OR in r steps.

Links are needed only up to components, so a group of near copies is not expanded into pairs. The members of
a table entry (node) of at most ``NODE_ROWS`` are compared in one task, each new member of a component with those
that are in none yet, and a spanning forest leaves the task. Of larger nodes, those with all members in one
component are done; else every member is compared with the one nearest the node's bitwise majority, and the
members enter segment tables of their remaining bits, where this repeats. At the last level, with over
50 bits fixed, nodes are compared whatever their size. No link is lost to a limit.

Defined results: null, empty and wordless texts have fingerprint zero, linked like any other;
fewer than four words are one shingle. Rows with a null id take part, but name no component: a
component without any id is null. Repeated rows get equal results; an empty table gives no
rows. Columns other than the id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import components, maybe_broadcast, small_batches
from casekit.session import cut_lineage

WORDS = 4
SEED = 42
RADIUS = 4
SEGMENTS = 3
#: Members of a node above which it is divided again.
NODE_ROWS = 1 << 13
#: Shingle hashes whose bits are counted at once in a task.
_BLOCK = 1 << 15


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of every shingle of the text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only
    line = b" ".join(words)
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(line, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-WORDS]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, (ends[WORDS - 1:] - 1).tolist())]


def bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        h = np.array(hashes[i: i + _BLOCK], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32)
    return total


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as an unsigned 64-bit integer."""
    hashes = shingle_hashes(text)
    over = np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row, fp being the fingerprint as a signed long."""

    def task(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, fp long")


def _bits(level: int, segment: int) -> list[int]:
    """Bits of a level's segment as signed longs: those whose index has the digit ``segment`` at ``level``."""
    bits = [1 << i for i in range(64) if i // SEGMENTS ** level % SEGMENTS == segment]
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def _levels() -> int:
    return next(k for k in range(64) if SEGMENTS ** k >= 64)


def _reach(radius: int) -> list[int]:
    """Radius within each segment; -1 where a segment need not be searched."""
    base, more = divmod(radius, SEGMENTS)
    return [base if j <= more else base - 1 for j in range(SEGMENTS)]


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _enter(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """The table entries ``node, used, fp`` of ``rows(node, used, fp)``: one for every value in the upper
    half of the ball within each segment of the bits that are not ``used``."""
    fp, used = F.col("fp"), F.col("used")
    entries = []
    for j, reach in enumerate(_reach(radius)):
        if reach < 0:
            continue
        bits = _bits(level, j)
        mask = F.lit(sum(bits)).cast("long")
        free = F.filter(F.array(*[F.lit(b).cast("long") for b in bits]),
                        lambda b: b.bitwiseAND(used.bitwiseOR(fp)) == 0)
        values = F.array(fp.bitwiseAND(mask).bitwiseAND(F.bitwise_not(used)))
        for _ in range(reach):
            values = F.array_distinct(F.flatten(F.transform(values, lambda v: F.concat(
                F.array(v), F.transform(free, lambda b: v.bitwiseOR(b))))))
        place, taken = F.xxhash64(F.lit(level), F.lit(j), "node"), used.bitwiseOR(mask)
        entries.append(F.transform(values, lambda v: F.struct(
            F.xxhash64(place, v).alias("node"), taken.alias("used"))))  # noqa: B023 (called at once)
    return rows.select(F.inline(F.flatten(F.array(*entries))), "fp")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    edges, free = [], fps
    while len(free) > 1:
        todo, free = [free[:1]], free[1:]
        while todo and len(free):
            for v in todo.pop():
                near = np.bitwise_count(free ^ v) <= radius
                if near.any():
                    edges.append((np.repeat(v, near.sum()), free[near]))
                    todo.append(free[near])
                    free = free[~near]
    return edges


def _node_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` that connect the members of each node of ``rows(node, fp)`` as all their links do."""

    def link(node, fp):
        """Of whole nodes in order: pairs next to each other at once, larger nodes one by one."""
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(starts, len(node)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        edges = [(fp[two], fp[two + 1])]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            edges += _forest(fp[s: s + n], radius)
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*edges))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def task(batches):
        kept = []  # the node that the batches so far end in
        for batch in batches:
            node, fp = batch.column("node").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(node):
                continue
            if kept and node[-1] == kept[0][0][0]:
                kept.append((node, fp))
                continue
            kept.append((node, fp))
            node, fp = (np.concatenate(x) for x in zip(*kept))
            whole = int(np.searchsorted(node, node[-1]))
            if whole:
                yield link(node[:whole], fp[:whole])
            kept = [(node[whole:], fp[whole:])]
        if kept:
            yield link(*(np.concatenate(x) for x in zip(*kept)))

    dealt = rows.select("node", "fp").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(task, "a long, b long").distinct()


def hamming_components(fps: DataFrame, radius: int = RADIUS, most: int = NODE_ROWS) -> DataFrame | None:
    """Components of distinct 64-bit ``fps(fp)`` under links of at most ``radius`` differing bits.

    Returns ``(id, component)`` for linked fingerprints, the component named by one of them; None without links.
    """
    labels = None

    def join(links):
        nonlocal labels
        links = cut_lineage(links)
        if not links.isEmpty():
            labels = cut_lineage(components(links if labels is None else links.union(labels.select("id", "component"))))

    rows = _enter(fps.select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("used"), "fp"), 0, radius)
    for level in range(_levels()):
        if level + 1 == _levels():
            join(_node_links(rows, radius))
            break
        hot = cut_lineage(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most).select("node"))
        join(_node_links(rows.join(maybe_broadcast(hot), "node", "left_anti"), radius))
        if hot.isEmpty():
            break
        many = cut_lineage(rows.join(maybe_broadcast(hot), "node", "left_semi"))
        many_c = _divided(many, labels)
        near = (F.col("comp") != F.col("oc")) & (_far("fp", "o") <= radius)
        join(many_c.join(maybe_broadcast(_centres(many_c)), "node").where(near)
             .select(F.least("comp", "oc").alias("a"), F.greatest("comp", "oc").alias("b")).distinct())
        rows = cut_lineage(_enter(_divided(many, labels), level + 1, radius))
    return labels


def _divided(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows(node, used, fp)`` with each fingerprint's component ``comp``, without the nodes of only one."""
    if labels is None:
        return rows.withColumn("comp", F.col("fp"))
    r = rows.join(maybe_broadcast(labels.select(F.col("id").alias("fp"), F.col("component").alias("c"))), "fp", "left")
    r = cut_lineage(r.select("node", "used", "fp", F.coalesce("c", "fp").alias("comp")))
    mixed = r.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("node")
    return r.join(maybe_broadcast(cut_lineage(mixed)), "node", "left_semi")


def _centres(many: DataFrame) -> DataFrame:
    """Per node the member ``o`` (of component ``oc``) nearest the bitwise majority of its members."""
    sums = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    total = many.groupBy("node").agg(F.count("*").alias("n"), *sums)
    bit = lambda i: (1 << i) - (1 << 64) if i == 63 else 1 << i
    major = F.lit(0).cast("long")
    for i in range(64):
        major = major.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(bit(i)).cast("long")).otherwise(F.lit(0).cast("long")))
    middle = cut_lineage(total.select("node", major.alias("middle")))
    near = many.join(maybe_broadcast(middle), "node").select("node", "fp", "comp", _far("fp", "middle").alias("far"))
    best = near.groupBy("node").agg(F.min(F.struct("far", "fp", "comp")).alias("p"))
    return cut_lineage(best.select("node", F.col("p.fp").alias("o"), F.col("p.comp").alias("oc")))


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = NODE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``."""
    d = cut_lineage(fingerprints(docs))
    fps = cut_lineage(d.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = hamming_components(fps.select("fp"), radius, most)
    if labels is None:
        named = fps.withColumnRenamed("low", "component_id")
    else:
        own = cut_lineage(fps.join(maybe_broadcast(labels.withColumnRenamed("id", "fp")), "fp", "left")
                          .select("fp", "low", F.coalesce("component", "fp").alias("component")))
        names = own.groupBy("component").agg(F.min("low").alias("component_id"))
        named = own.join(names, "component").select("fp", "component_id")
    return d.join(maybe_broadcast(cut_lineage(named)), "fp", "left").select("doc_id", "fp", "component_id")
