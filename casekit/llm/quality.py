"""Operator 5: quality classifier by an interpolated modified Kneser-Ney n-gram model.

The model is trained on all trusted text: n-grams of characters, order ``ORDER``, over all characters
of that text. Counts, continuation counts, discounts and interpolation are
grouped sums and joins of tables sharded by n-gram. A document's score is its
negative log probability per character; it is rejected above the quantile of its
language's trusted documents.

N-grams of the most frequent characters alone are looked up in one array of SYMBOLS ** ORDER values, whatever the corpus, so
its broadcast has a proven bound (2 bytes each). Those that hold another character are joined with the model's
tables, each distinct one once. What the corpus sends to the count
tables grows with the number of its partitions and its distinct n-grams. The driver holds the characters, at most Unicode's.

Defined results: a null or empty text has no characters, gets the language's median
and is kept; null languages form a language of their own; a language without
trusted documents takes the quantile of all; without any trusted text nothing can
be judged and every document is kept (score null). Repeated rows are judged row by
row; an empty table gives no rows. Columns beyond doc_id, text, lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import maybe_broadcast, release_caches, small_batches, with_row_id
from casekit.session import cut_lineage

ORDER = 4
#: Symbols in the array, a power of two: 0 is the document's border, 1 any character that the trusted text lacks, then
#: the frequent ones. The others have numbers from here on.
SYMBOLS = 64
BITS = 6
#: Bits of a symbol in the tables: they hold any code point, and a context of ORDER - 1 of them is a long.
WIDE = 21
LAST = (1 << WIDE) - 1
#: Share of a language's trusted documents, at least, that score better than its threshold.
QUANTILE = 0.995
#: A document's mean is taken with as many characters of its language's median score.
PRIOR_CHARS = 40
#: N-grams that a task holds before it counts or hands them on.
HELD = 1 << 21


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(trusted: DataFrame) -> list[int]:
    """All code points of the trusted text, the most frequent first."""

    def count(batches):
        release_caches()
        total: dict[int, int] = {}
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    chars, n = np.unique(_codes(t), return_counts=True)
                    for c, k in zip(chars.tolist(), n.tolist()):
                        total[c] = total.get(c, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())],
                                         names=["c", "n"])

    found = trusted.select("text").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values(["n", "c"], ascending=[False, True]).c.tolist()


class Symbols:
    """Maps text to symbols and to n-grams."""

    def __init__(self, chars: list[int]):
        self.number = np.ones(max(chars, default=0) + 2, np.uint32)  # the last stands for all code points from there on
        self.number[np.array(chars, np.int64)] = np.arange(2, len(chars) + 2)

    def of(self, text: str) -> np.ndarray:
        return self.number[np.minimum(_codes(text), len(self.number) - 1)]

    def grams(self, text: str, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams, one per character, borders before the first: those of symbols below SYMBOLS as places in the
        array, and of the others the context and the last symbol."""
        s = np.concatenate([np.zeros(order - 1, np.uint32), self.of(text)])
        n = len(s) - order + 1
        out = s[:n]
        for k in range(1, order):
            out = (out << np.uint32(BITS)) | s[k: k + n]
        rare = s >= SYMBOLS
        if not rare.any():
            return out, np.empty(0, np.int64), np.empty(0, np.int64)
        some = rare[:n].copy()
        for k in range(1, order):
            some |= rare[k: k + n]
        at, wide = np.flatnonzero(some), s.astype(np.int64)
        context = wide[at]
        for k in range(1, order - 1):
            context = (context << WIDE) | wide[at + k]
        return out[~some], context, wide[at + order - 1]


def _counted(context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts."""
    if not len(w):
        return context, w, w
    contexts, place = np.unique(context, return_inverse=True)
    keys, n = np.unique((place.astype(np.int64) << WIDE) | w, return_counts=True)
    return contexts[keys >> WIDE], keys & LAST, n


def count_ngrams(trusted: DataFrame, chars: list[int]) -> DataFrame:
    """``(ctx, w, c)``: all n-grams of the highest order in the trusted text, as context and last symbol, with their counts.
    Tasks count on their own first, so one row per distinct n-gram and task is shuffled, of those with a rare
    symbol one per ``HELD`` n-grams."""

    def count(batches):
        release_caches()
        sym, held, rest, size, total = Symbols(chars), [], [], 0, None

        def fold(total, held):
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            if total is None:
                return grams, n
            keys, at = np.unique(np.concatenate([total[0], grams]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([total[1], n])).astype(np.int64)

        def rows(context, w, n):
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (context, w, n)], names=["ctx", "w", "c"])

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    grams, context, w = sym.grams(t)
                    held.append(grams)
                    rest.append((context, w))
                    size += len(grams) + len(w)
                    if size > HELD:
                        total, held, size = fold(total, held), [], 0
                        yield rows(*_counted(*(np.concatenate(x) for x in zip(*rest))))
                        rest = []
        if held:
            total = fold(total, held)
            yield rows(*_counted(*(np.concatenate(x) for x in zip(*rest))))
        if total is not None:
            grams, context = total[0].astype(np.int64), 0
            for k in range(ORDER - 1, 0, -1):
                context = (context << WIDE) | (grams >> BITS * k) & SYMBOLS - 1
            yield rows(context, grams & SYMBOLS - 1, total[1])

    return trusted.select("text").mapInArrow(count, "ctx long, w long, c long").groupBy("ctx", "w").agg(F.sum("c").alias("c"))


def _shorter(n: int):
    """The context of an n-gram without its first symbol."""
    return F.col("ctx").bitwiseAND((1 << WIDE * max(n - 2, 0)) - 1)


def kneser_ney(top: DataFrame, order: int = ORDER) -> DataFrame:
    """``(n, ctx, w, logp, backoff)`` of every seen n-gram of all orders, and the back-off of every seen context.

    Rows: ``n`` (order of the row), ``ctx`` and ``w`` (its context and last symbol), ``logp`` (of ``w`` given ``ctx``, interpolated
    over all lower orders) and ``backoff`` (log weight that the n-gram, as a context, gives the lower order)."""
    counts = {order: cut_lineage(top.select("ctx", "w", "c"))}
    for n in range(order - 1, 0, -1):  # continuation counts: distinct symbols before the n-gram
        counts[n] = cut_lineage(counts[n + 1].groupBy(_shorter(n + 1).alias("ctx"), "w").agg(F.count("*").alias("c")))
    symbols = max(SYMBOLS, counts[1].count() + 2)
    lower = None
    out = []
    for n in range(1, order + 1):
        c = counts[n]
        ones = c.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
        d = discounts(*[x or 0 for x in ones])
        cut = F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        rows = c.select("ctx", "w", _shorter(n).alias("suffix"), "c", cut.alias("d"))
        ctx = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = rows.join(ctx, "ctx")
        if n == 1:  # below the lowest order all symbols are equally likely
            p = rows.select("ctx", "w", ((F.col("c") - F.col("d")) / F.col("total")
                                         + F.col("gamma") / symbols).alias("p"))
            zero = ctx.first()
            out.append(c.sparkSession.createDataFrame(
                [(0, 0, 0, float(np.log(1.0 / symbols)), float(np.log(zero["gamma"] or 1.0)))],
                "n int, ctx long, w long, logp double, backoff double"))
        else:
            p = rows.join(lower.select(F.col("ctx").alias("suffix"), "w", F.col("p").alias("q")), ["suffix", "w"]).select(
                "ctx", "w", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
            out[-1] = out[-1].drop("backoff").join(ctx.select(
                F.shiftright("ctx", WIDE).alias("ctx"), F.col("ctx").bitwiseAND(LAST).alias("w"),
                F.log("gamma").alias("backoff")), ["ctx", "w"], "full")
            # a context of borders ends in no counted n-gram: it has a back-off only
            out[-1] = out[-1].withColumn("n", F.lit(n - 1))
        lower = cut_lineage(p)
        out.append(lower.select(F.lit(n).alias("n"), "ctx", "w", F.log("p").alias("logp"),
                                F.lit(None).cast("double").alias("backoff")))
    table = out[0]
    for x in out[1:]:
        table = table.unionByName(x)
    return cut_lineage(table)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more; where a count of counts is 0 (small
    or saturated tables) half a count per step."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3)))


def dense(model: DataFrame, order: int = ORDER) -> np.ndarray:
    """Log probability of every n-gram of the highest order and of symbols below SYMBOLS, seen or not, as one array of
    SYMBOLS ** order float16 values. Order n of the model has at most SYMBOLS ** n such rows of 12 bytes, so what the
    driver gathers has a fixed bound."""
    place, over = F.col("w"), 0  # packed anew in BITS; bits that no such symbol has
    for k in range(order - 1):
        place = place + F.shiftleft(F.shiftright("ctx", WIDE * k).bitwiseAND(SYMBOLS - 1), BITS * (k + 1))
        over |= (LAST ^ (SYMBOLS - 1)) << WIDE * k
    few = model.where((F.col("w") < SYMBOLS) & (F.col("ctx").bitwiseAND(F.lit(over)) == 0)).withColumn("gram", place)
    log = lambda n, value: few.where(F.col("n") == n).select(
        F.col("gram").cast("int"), F.col(value).cast("float").alias("v")).where("v IS NOT NULL").toPandas()
    table = log(0, "logp").v.to_numpy()
    for n in range(1, order + 1):
        low, own = log(n - 1, "backoff"), log(n, "logp")
        back = np.zeros(SYMBOLS ** (n - 1), np.float32)  # an unseen context leaves all to the lower order
        back[low.gram.to_numpy()] = low.v.to_numpy()
        # n-gram (x, suffix, w): suffix and w index the lower table, x and suffix the back-off; a first symbol at a time
        step, part = len(table), SYMBOLS ** max(n - 2, 0)
        made = np.empty(SYMBOLS ** n, np.float16 if n == order else np.float32)
        for x in range(SYMBOLS if n > 1 else 0):
            made[x * step: (x + 1) * step] = table + np.repeat(back[x * part: (x + 1) * part], SYMBOLS)
        if n == 1:
            made[:] = table + back
        made[own.gram.to_numpy()] = own.v.to_numpy()
        table = made
    return table


def log_probability(grams: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``(ctx, w, logp)`` of distinct n-grams ``(ctx, w)`` of the highest order, seen or not."""
    g = grams.select("ctx", "w", F.col("ctx").alias("_c"), F.lit(0.0).alias("logp"), F.lit(False).alias("_seen"))
    for n in range(order, 0, -1):  # an unseen n-gram takes its context's back-off, if any, and the lower order
        own = model.where((F.col("n") == n) & F.col("logp").isNotNull()).select(
            F.col("ctx").alias("_c"), "w", F.col("logp").alias("_p"))
        back = model.where((F.col("n") == n - 1) & F.col("backoff").isNotNull()).select(
            (F.shiftleft("ctx", WIDE) + F.col("w")).alias("_c"), F.col("backoff").alias("_b"))
        more = F.coalesce("_p", F.coalesce("_b", F.lit(0.0)))
        seen = F.col("_seen") | F.col("_p").isNotNull()
        g = g.join(own, ["_c", "w"], "left").join(back, "_c", "left").select(
            "ctx", "w", F.col("_c").bitwiseAND((1 << WIDE * max(n - 2, 0)) - 1).alias("_c"),
            F.when(F.col("_seen"), F.col("logp")).otherwise(F.col("logp") + more).alias("logp"), seen.alias("_seen"))
    none = model.where("n = 0").first()["logp"]
    return g.select("ctx", "w", F.when(F.col("_seen"), F.col("logp")).otherwise(F.col("logp") + none).alias("logp"))


def score(docs: DataFrame, chars: list[int], table) -> DataFrame:
    """``(doc_id, lang, trusted, n, nll, rare)``: characters and summed negative log probability of each text, without
    its n-grams that hold a symbol from SYMBOLS on; ``rare`` has those with their counts ``k``. ``table`` is a broadcast of ``dense``."""
    shape = pa.list_(pa.struct([("ctx", pa.int64()), ("w", pa.int64()), ("k", pa.int64())]))

    def task(batches):
        release_caches()
        sym, logp = Symbols(chars), table.value

        def rows(b, start, n, nll, rare):
            part = b.slice(start, len(n))
            ends = np.cumsum([0, *(len(x[0]) for x in rare)])
            flat = [pa.array(np.concatenate(x)) if rare else pa.array([], pa.int64()) for x in (zip(*rare) if rare else [[]] * 3)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["ctx", "w", "k"]))
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), part.column("trusted"), pa.array(n, pa.int64()),
                 pa.array(nll, pa.float64()), lists.cast(shape)], names=["doc_id", "lang", "trusted", "n", "nll", "rare"])

        for b in batches:
            start, n, nll, rare, held = 0, [], [], [], 0
            for t in b.column("text").to_pylist():
                grams, *rest = sym.grams(t or "")
                n.append(len(t or ""))
                nll.append(0.0 - float(logp[grams].sum(dtype=np.float64)))
                rare.append(_counted(*rest))
                held += len(rare[-1][0])
                if held > HELD // 8:
                    yield rows(b, start, n, nll, rare)
                    start, n, nll, rare, held = start + len(n), [], [], [], 0
            if n:
                yield rows(b, start, n, nll, rare)

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text", "trusted").mapInArrow(
        task, "doc_id long, lang string, trusted boolean, n long, nll double, rare array<struct<ctx: long, w: long, k: long>>")


def _with_rare(s: DataFrame, model: DataFrame) -> DataFrame:
    """``s`` of ``score``, the n-grams in ``rare`` added to ``nll``."""
    s = cut_lineage(s.withColumn("_row", F.monotonically_increasing_id()))
    rare = s.select("_row", F.explode("rare").alias("r")).select("_row", "r.*")
    s = s.drop("rare")
    if rare.isEmpty():
        return s.drop("_row")
    each = cut_lineage(log_probability(rare.select("ctx", "w").distinct(), model))
    more = rare.join(maybe_broadcast(each), ["ctx", "w"]).groupBy("_row").agg(F.sum(F.col("k") * F.col("logp")).alias("_more"))
    return cut_lineage(s.join(more, "_row", "left").withColumn("nll", F.col("nll") - F.coalesce("_more", F.lit(0.0)))
                       .drop("_row", "_more"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE,
             prior_chars: int = PRIOR_CHARS, key: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, lang, n_chars, perplexity`` (per character), ``threshold``, ``keep``;
    with a ``key`` column its values stand in ``doc_id``.

    Trusted are the documents whose label has quality 1 and toxic 0; the model is trained on all of them."""
    spark = small_batches(docs).sparkSession
    good = cut_lineage(labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(
        F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct())
    docs = docs.select("doc_id", "lang", "text", F.col(key).alias("_key"))
    d = docs.join(maybe_broadcast(good.withColumn("trusted", F.lit(True))), F.col("doc_id") == F.col("_id"), "left")
    d = d.withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    d, docs = (x.withColumn("doc_id", F.col("_key")) for x in (d, docs))
    trusted = d.where("trusted").select("text")
    chars = alphabet(trusted)
    if not chars:
        return docs.select("doc_id", "lang", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                           F.lit(None).cast("double").alias("perplexity"),
                           F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    model = kneser_ney(count_ngrams(trusted, chars))
    table = spark.sparkContext.broadcast(dense(model))
    s = _with_rare(score(d, chars, table), model)
    table.unpersist()
    mean = F.col("nll") / F.col("n")
    known = s.where("trusted AND n > 0")
    every = known.agg(F.percentile_approx(mean, 0.5, 10000)).first()[0]
    mid = known.groupBy("lang").agg(F.percentile_approx(mean, 0.5, 10000).alias("mid"))
    s = s.join(maybe_broadcast(cut_lineage(mid.withColumnRenamed("lang", "_l"))),
               F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l").withColumn("mid", F.coalesce("mid", F.lit(every)))
    s = cut_lineage(s.withColumn("value", (F.col("nll") + prior_chars * F.col("mid")) / (F.col("n") + prior_chars)))
    known = s.where("trusted AND n > 0")
    every = known.agg(F.percentile_approx("value", quantile, 100_000)).first()[0]
    top = known.groupBy(F.col("lang").alias("_l")).agg(F.percentile_approx("value", quantile, 100_000).alias("top"))
    s = s.join(maybe_broadcast(cut_lineage(top)), F.col("lang").eqNullSafe(F.col("_l")), "left")
    top = F.coalesce("top", F.lit(every))
    return s.select("doc_id", "lang", F.col("n").alias("n_chars"), F.exp("value").alias("perplexity"),
                    F.exp(top).alias("threshold"), (F.col("value") <= top).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected documents; rows are told apart by ``with_row_id``."""
    d = with_row_id(docs)
    bad = cut_lineage(classify(d, labels, key="_row", **options).where("NOT keep").select(F.col("doc_id").alias("_bad")).distinct())
    return d.join(maybe_broadcast(bad), d["_row"] == bad["_bad"], "left_anti").drop("_row")
