"""Operator 11: periodic runs of words by maximal pairs.

A run is a stretch of words with smallest period q, at least ``max(MIN_WORDS, MIN_EXPONENT * q)`` long, that no
neighbouring word extends. Its two overlapping copies q words apart are a maximal pair: equal
stretches of words whose left and right neighbours differ. So the maximal pairs (p, p + d) of length l with
l + d long enough and at least MIN_EXPONENT times d are exactly the stretches with period d that can't be extended;
where several d give one stretch the smallest is its period.

Per text: ranks of 1, 2, 4, ... words by pair doubling give the sorted suffixes and their common prefixes (LCP);
only those that share four words with another one are sorted further. A bottom-up walk over the LCP intervals
merges the children of an interval of depth l, smaller into larger. A node lists its places with the class
of each, the word on its left; pairs join places of different children (right-maximal) and of different classes
(left-maximal), so nodes of one class are merged unsearched. Only the nearest place on each side has to
be looked at: if the common prefix of p and p + q has no smaller period, it cannot start between them.
Intervals whose places are all further apart than a third of their depth are left out beforehand.

Everything about a text happens in one task, without any shuffle; texts are worked on in blocks of about
``_BLOCK_WORDS`` words, a longer text by itself.

Defined results: null, empty and wordless texts have no run and collapse to the empty string. Texts
without a run keep all their words, joined by single spaces. Repeated rows get equal results, null ids
stay, an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import small_batches

MIN_WORDS = 6
MIN_EXPONENT = 4
#: Least common prefix of a maximal pair that is a run: MIN_WORDS - 1 at distance 1, more at others.
_LEAST = min(max(MIN_WORDS - d, (MIN_EXPONENT - 1) * d) for d in range(1, MIN_WORDS + 1))
_BLOCK_WORDS = 1 << 18
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def _word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, never equal in two texts, and the texts' first positions (with the end)."""
    ids, base = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids += [base + known.setdefault(w, len(known)) for w in words]
        base += len(known)
    ends = np.cumsum([0, *map(len, texts)])
    return np.array(ids, np.int64), ends


def _ahead(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """``rank`` (0 and more) ``step`` places on, plus 1; 0 beyond the end."""
    to = at + step
    return np.where(to < len(rank), rank[np.minimum(to, len(rank) - 1)] + 1, 0)


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share four words with another one, sorted, and the words each shares with the one before."""
    n = len(ids)
    everywhere, ranks = np.arange(n), [ids]
    for step in (1, 2):  # ranks of all places by two words, then by four
        key = ranks[-1] * (n + 2) + _ahead(ranks[-1], everywhere, step)
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, everywhere, 0))  # a group is named by its first index
        ranks.append(rank)
    alone = new & np.append(new[1:], True)
    shared = open_ = order[~alone]
    step = 4
    while len(open_):  # divide the groups that are left by what follows
        rank = ranks[-1]
        group, then = rank[open_], _ahead(rank, open_, step)
        by = np.lexsort((then, group))
        open_, group, then = open_[by], group[by], then[by]
        first = np.ones(len(open_), bool)
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= then[1:] != then[:-1]
        index = np.arange(len(open_))
        rank = rank.copy()
        rank[open_] = group + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(first, index, 0))
        ranks.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    shared = shared[np.argsort(ranks[-1][shared])]
    common = np.zeros(len(shared), np.int64)
    a, b = shared[:-1].copy(), shared[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        a, b = a + (same << level), b + (same << level)
    common[1:] = a - shared[:-1]
    return shared, common


def _candidates(places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the intervals of depth ``_LEAST`` in which no two places are near enough for a run."""
    segment = np.cumsum(common < _LEAST)
    deepest = np.zeros(segment[-1] + 1 if len(segment) else 1, np.int64)
    np.maximum.at(deepest, segment, np.where(common >= _LEAST, common, 0))
    by = np.lexsort((places, segment))
    gap = np.full(len(deepest), np.iinfo(np.int64).max // MIN_EXPONENT)
    inner = segment[by][1:] == segment[by][:-1]
    np.minimum.at(gap, segment[by][1:][inner], np.diff(places[by])[inner])
    keep = (gap * (MIN_EXPONENT - 1) <= deepest)[segment]
    return places[keep], common[keep]


def _merge(a: tuple, b: tuple, depth: int, left: list[int], found: dict) -> tuple:
    """The node of two children's places; their maximal pairs go to ``found``: stretch -> smallest period."""
    (big, kinds), (small, other) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    if len(other) > len(kinds):
        kinds, other = other, kinds
    kinds |= other
    reach = depth // (MIN_EXPONENT - 1)
    if len(kinds) > 1:
        for p in small:
            k = bisect_left(big, p)
            for o in big[max(k - 1, 0): k + 1]:
                d = abs(p - o)
                if d <= reach and depth + d >= MIN_WORDS and left[p] != left[o]:
                    stretch = (min(p, o), depth + d)
                    found[stretch] = min(d, found.get(stretch, d))
    if 16 * len(small) < len(big):
        for p in small:
            insort(big, p)
    else:
        big += small
        big.sort()
    return big, kinds


def _maximal_pairs(places: list[int], common: list[int], left: list[int]) -> dict[tuple[int, int], int]:
    """All runs ``(start, length) -> period`` by a walk over the LCP intervals, deepest first."""
    found: dict[tuple[int, int], int] = {}
    stack: list[list] = []
    for i, p in enumerate(places):
        node, down = ([p], {left[p]}), common[i + 1] if i + 1 < len(places) else 0
        while stack and stack[-1][0] > down:
            depth, open_node = stack.pop()
            node = _merge(open_node, node, depth, left, found)
        if down < _LEAST:
            continue
        if stack and stack[-1][0] == down:
            stack[-1][1] = _merge(stack[-1][1], node, down, left, found)
        else:
            stack.append([down, node])
    return found


def word_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text (a list of words) its runs ``(start, length, period)`` by start, then period."""
    ids, ends = _word_ids(texts)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(ids) < MIN_WORDS:
        return runs
    places, common = _candidates(*_suffixes(ids))
    left = [-1, *ids[:-1].tolist()] if len(places) else []
    for (start, length), period in _maximal_pairs(places.tolist(), common.tolist(), left).items():
        t = int(np.searchsorted(ends, start, "right")) - 1
        runs[t].append((start - int(ends[t]), length, period))
    for r in runs:
        r.sort(key=lambda x: (x[0], x[2]))
    return runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of runs and in the first period of each run, unless another run holds them later on."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(depth).tolist()) if not d])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words``, its ``runs`` by start, then period, and its ``collapsed`` text."""
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def block(ids, texts):
        runs = word_runs(texts)
        flat = pa.array([dict(zip(("start", "length", "period"), r)) for rs in runs for r in rs], item)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        short = [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(texts, runs)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(short, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def task(batches):
        for b in batches:
            texts, begin, size = [], 0, 0
            column = b.column("text")
            for k in range(b.num_rows):
                words = (column[k].as_py() or "").encode("utf-8", "surrogatepass").split()  # ASCII blanks only
                if texts and size + len(words) > _BLOCK_WORDS:
                    yield block(b.column("doc_id").slice(begin, len(texts)), texts)
                    texts, begin, size = [], k, 0
                texts.append(words)
                size += len(words)
            if texts:
                yield block(b.column("doc_id").slice(begin, len(texts)), texts)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, f"doc_id long, n_words long, {RUNS}, collapsed string")


def strongest(runs: str) -> Column:
    """Of a runs column the run with the greatest length / period, ties by start, then period."""
    return F.expr(f"""aggregate(slice({runs}, 2, greatest(size({runs}), 1)), get({runs}, 0), (m, r) ->
        if(r.length * m.period > m.length * r.period, r, m))""")


def planted_tail(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with a periodic tail where the id's CRC-32 h ends in 0: with g = h / 10 and n words, each word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). Other texts (and null ids) stay."""
    words = f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    g = f"crc32(CAST({doc_id} AS STRING)) DIV 10"
    tail = f"""transform(array({words}), ws -> IF(size(ws) = 0, '', transform(array(named_struct(
        'a', CAST({g} % size(ws) AS INT), 'n', size(ws))), x -> array_join(transform(ws, (w, i) -> IF(i < x.a, w,
        get(ws, CAST(x.a + (i - x.a) % (1 + (x.n - x.a) DIV (3 + {g} % 8)) AS INT)))), ' '))[0]))[0]"""
    return F.expr(f"IF(crc32(CAST({doc_id} AS STRING)) % 10 = 0, {tail}, {text})")
