"""Operator 2: benchmark decontamination by SimHash of item-sized windows.

Shingles are five words (an item of fewer words is one shingle). A window is as long as
some benchmark item. Windows and items get a SimHash over their shingles, weighted
by how often they occur; fingerprints are cut into BLOCKS blocks, and an item is
indexed under every value within distance 1 of each of its blocks. Two fingerprints
within RADIUS = 2 * BLOCKS - 1 differ by at most one bit in some block, so
the block join finds all of them. Candidates are verified by exact weighted Jaccard similarity.

Which windows: one that is alike to an item of n shingles has at least
``similarity`` * n shingles of the benchmark, and moving its start to its first shingle
of that item loses nothing. So windows start at shingles that occur in an item of the window's
size and hold enough benchmark shingles; all others are ruled out beforehand, without loss. Equal
windows, such as a passage that many documents repeat, are fingerprinted once.

Defined results: words are lower-cased runs of letters, digits and non-ASCII characters; null,
empty or wordless texts and items match nothing; a window at the end of a text may be shorter; repeated items count each,
under their own id (of an id with several texts, or the null id, all are searched and the best match counts); repeated rows give one result per id and item; a
null document id is an id of its own; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import maybe_broadcast, with_row_id
from casekit.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
BITS, BLOCKS = 63, 9
BLOCK_BITS = BITS // BLOCKS
RADIUS = 2 * BLOCKS - 1
#: ASCII characters that separate words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Counters of 21 bits, three in a long: bit b of a hash, and those 21 and 42 above it, are summed at once.
_LANE = 21
_LANES = 1 | 1 << _LANE | 1 << 2 * _LANE


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingle(w: Column, at: Column, k: int) -> Column:
    """Hash of the ``k`` words from index ``at`` on."""
    return F.xxhash64(F.lit(k), *[F.get(w, at + i) for i in range(k)])


def shingles(w: Column, k: int) -> Column:
    last = F.size(w) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: shingle(w, i, k))).otherwise(
        F.array().cast("array<bigint>"))


def simhash(df: DataFrame, key: list[str], hashes: str) -> DataFrame:
    """``key`` and ``fp``: the majority of each of 63 bits over the array of hashes, repeats counted."""
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(_LANES)).alias(f"s{b}") for b in range(_LANE)]
    s = df.select(*key, F.explode(hashes).alias("h")).groupBy(*key).agg(F.count("*").alias("_all"), *sums)
    mask = (1 << _LANE) - 1

    def bit(b: int) -> Column:
        total = F.shiftrightunsigned(f"s{b % _LANE}", b // _LANE * _LANE).bitwiseAND(mask)
        return F.when(2 * total > F.col("_all"), F.lit(1 << b)).otherwise(F.lit(0).cast("long"))

    return s.select(*key, reduce(Column.bitwiseOR, [bit(b) for b in range(BITS)]).alias("fp"))


def weighted_jaccard(x: Column, y: Column) -> Column:
    """Similarity of two arrays as multisets: summed minimum by summed maximum of the counts."""
    count = lambda a, v: F.size(F.filter(a, lambda u: u == v))
    plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    both = F.when(plain, F.size(F.array_intersect(x, y))).otherwise(
        F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, v: acc + F.least(count(x, v), count(y, v))))
    return both / (F.size(x) + F.size(y) - both)


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")


def _matches(docs: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words`` for items with ``n`` shingles of ``k`` words."""
    bench = cut_lineage(items.select(F.explode("hs").alias("h"), "n").groupBy("h").agg(
        F.sort_array(F.collect_set("n")).alias("sizes")))  # as many sizes as distinct item lengths, at most
    d = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    at = d.select("row", words(F.col("text")).alias("w"))
    # outer: else a filter on the words' number is put below, which splits every text twice
    at = at.select("row", "w", F.posexplode_outer("w").alias("pos", "_")).select(
        "row", "pos", shingle(F.col("w"), F.col("pos"), k).alias("h"), (F.col("pos") <= F.size("w") - k).alias("whole"))
    hits = at.where("whole").join(maybe_broadcast(bench), "h").groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("pos", "sizes"))).alias("hits"))
    # a start needs, within its window, enough further benchmark shingles
    need = lambda n: F.ceil(n * F.lit(similarity) - 1e-9).cast("int")
    enough = lambda x, i, n: F.get("hits.pos", i + need(n) - 1) < x["pos"] + n
    starts = F.flatten(F.transform("hits", lambda x, i: F.transform(
        F.filter(x["sizes"], lambda n: F.coalesce(enough(x, i, n), F.lit(False))),
        lambda n: F.struct(x["pos"].alias("pos"), n.alias("n")))))
    hits = cut_lineage(hits.select("row", starts.alias("starts")).where(F.size("starts") > 0))

    x = d.join(maybe_broadcast(hits.select("row")), "row", "left_semi").dropDuplicates(["row"]).join(hits, "row")
    x = x.select("doc_id", "starts", words(F.col("text")).alias("w"))
    x = x.select("doc_id", "starts", shingles(F.col("w"), k).alias("hs"))
    x = x.select("doc_id", "hs", F.explode("starts").alias("s"))
    x = x.select("doc_id", F.col("s.pos").alias("pos"), F.col("s.n").alias("n"),
                 F.slice("hs", F.col("s.pos") + 1, F.col("s.n")).alias("win"))
    x = cut_lineage(x.withColumns({"c1": F.xxhash64("win"), "c2": F.xxhash64(F.lit(1), "win")}))

    key = ["c1", "c2", "n"]
    contents = cut_lineage(x.groupBy(*key).agg(F.first("win").alias("win")))
    fps = simhash(contents, key, "win")
    probe = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).alias("v"))
                                for b in range(BLOCKS)])).alias("_")
    left = fps.select(*key, "fp", probe).select(*key, "fp", "_.b", "_.v")
    near = [F.lit(0), *[F.lit(1 << j) for j in range(BLOCK_BITS)]]
    index = simhash(items, ["item_id", "n"], "hs").select(
        "item_id", "n", F.col("fp").alias("item_fp"), F.explode(F.array(*[
            F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).bitwiseXOR(j).alias("v"))
            for b in range(BLOCKS) for j in near])).alias("_")).select("item_id", "n", "item_fp", "_.b", "_.v")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    cand = left.join(maybe_broadcast(cut_lineage(index)), ["n", "b", "v"]).where(close).select(*key, "item_id").distinct()

    sim = weighted_jaccard(F.col("win"), F.col("hs"))
    good = (cand.join(contents, key).join(maybe_broadcast(items.select("item_id", "hs")), "item_id")
            .select(*key, "item_id", sim.alias("similarity")).where(F.col("similarity") >= similarity - 1e-9))
    return x.select("doc_id", "pos", *key).join(maybe_broadcast(cut_lineage(good)), key).select(
        "doc_id", "item_id", "similarity", F.col("pos").alias("start_word"), (F.col("n") + k - 1).alias("n_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item it holds: the best window's ``similarity``, ``start_word``
    and ``n_words``."""
    texts = cut_lineage(benchmark.select(F.col("item_id").alias("id"), "text").dropDuplicates()
                        .withColumn("item_id", F.monotonically_increasing_id()))  # of each text
    items = (texts.withColumn("w", words(F.col("text")))
             .withColumn("k", F.least(F.size("w"), F.lit(WORDS))).where("k > 0"))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most WORDS values
    out = None
    for k in sizes:
        own = cut_lineage(items.where(F.col("k") == k).select("item_id", shingles(F.col("w"), k).alias("hs"))
                          .withColumn("n", F.size("hs")))
        m = _matches(docs, own, k, similarity)
        out = m if out is None else out.union(m)
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, similarity double, start_word int, n_words int")
    out = out.join(maybe_broadcast(texts.select("item_id", "id")), "item_id").drop("item_id").withColumnRenamed("id", "item_id")
    best = F.max_by(F.struct("similarity", "start_word", "n_words"),
                    F.struct("similarity", -F.col("start_word"), "n_words"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows are told apart by ``with_row_id``."""
    d = with_row_id(docs)
    found = contaminated(d.select(F.col("_row").alias("doc_id"), "text"), benchmark, similarity)
    bad = cut_lineage(found.select(F.col("doc_id").alias("_bad")).distinct())
    return d.join(maybe_broadcast(bad), d["_row"] == bad["_bad"], "left_anti").drop("_row")
