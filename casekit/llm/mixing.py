"""Operator 1: mixing sources to target weights by Sainte-Lague apportionment.

Sources get words by highest quotients target / (2j + 1); each source is divided into
shards by a hash of the document (a hot source into many) and its words are
apportioned to the shards the same way. In a shard the documents stand in
seeded order as one token stream; the quota takes the whole stream as often as it
goes, and the rest by a seeded draw of blocks, the last of them in part. Blocks are
as long as ``blocks`` of them hold the whole mix, but a shard has at least SHARD_BLOCKS.

Defined results: null or wordless text has size 0 and takes 0 words; null
sources form one source, ranked last; a source of size 0 has target 0; repeated
rows are mixed as rows of their own; an empty table gives no rows. Columns other
than the id, source and text are neither read nor needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit.llm.common import global_rank, maybe_broadcast, seeded
from casekit.session import cut_lineage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks the whole mix is cut into if its shards are large, and blocks of a small shard.
BLOCKS, SHARD_BLOCKS = 200_000, 16
#: Documents a shard holds on average.
SHARD_DOCS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> Column:
    """Weight by the source's rank: the cycle's values, repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("idx") % len(cycle) + 1).cast("int"))


def source_targets(sized: DataFrame, weight: Column, max_repeat: int = 3) -> DataFrame:
    """``(source, idx, n_docs, source_size, target)``: all tokens shared by weight; a target
    stops at ``max_repeat`` times its source, the excess goes to the others by weight."""
    s = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    s = cut_lineage(global_rank(s, [F.col("source").asc_nulls_last()], "idx").withColumn("w", weight.cast("double")))
    cap = F.col("source_size") * float(max_repeat)
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, last = 0.0, -1.0
    while level != last:  # the level only rises, and only while another source is capped
        last = level
        capped = cap <= F.col("w") * last if last else F.lit(False)
        full, w = s.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("w")))).first()
        level = max(last, (total - (full or 0.0)) / w) if w else last
    return s.withColumn("target", F.least(cap, F.col("w") * level)).drop("w")


def _seats(claims: DataFrame, within: list[str], seats: str | int, key: list[str]) -> DataFrame:
    """Highest quotients: of the rows ``key`` of each ``within`` group (all rows if empty), with
    columns ``claim`` and ``most`` (seats it can take), the ``seats`` first
    quotients claim / (2j + 1) win a seat. Returns ``key`` and ``quota``, for quotas above 0.

    Claims are scaled to sum to the seats. Of n rows that sum to s the divisor then is off 1 by n / 2s at most
    (upwards by the rows below ``most`` alone, which no other can relieve), so only the quotients about a
    claim are in doubt; those before have won. About five quotients a row are ranked, however many the seats."""
    c = claims.where((F.col("most") > 0) & (F.col("claim") > 0)).withColumn(
        "_seats", (F.col(seats) if isinstance(seats, str) else F.lit(seats)).cast("long"))
    free = F.col("claim") * F.col("_seats") < F.col("_sum") * F.col("most")
    total = cut_lineage(c.groupBy(*within).agg(F.sum("claim").alias("_sum"), F.count("*").alias("_rows")))
    c = c.join(maybe_broadcast(total), within) if within else c.crossJoin(F.broadcast(total))
    c = c.withColumn("_free", free).withColumn("claim", F.col("claim") * F.col("_seats") / F.col("_sum"))
    total = cut_lineage(c.groupBy(*within).agg(F.sum(F.when(F.col("_free"), F.col("claim"))).alias("_fsum"),
                                               F.count_if("_free").alias("_frows")))
    c = c.join(maybe_broadcast(total), within) if within else c.crossJoin(F.broadcast(total))
    off = F.greatest(F.col("_rows") / (2 * F.col("_seats")), F.coalesce(F.col("_frows") / (2 * F.col("_fsum")), F.lit(0.0)))
    off = F.ceil(F.col("claim") * off) + 2
    c = c.withColumn("base", F.least("most", F.greatest(F.lit(0), F.floor("claim") - off)).cast("long"))
    c = c.withColumn("last", F.least(F.col("most"), F.ceil("claim") + off) - 1)
    c = cut_lineage(c.select(*key, "claim", "base", "last", "_seats"))
    left = c.groupBy(*within).agg((F.first("_seats") - F.sum("base")).alias("_left"))
    c = c.drop("_seats")
    q = (c.where("last >= base").withColumn("j", F.explode(F.sequence("base", "last")))
         .withColumn("q", F.col("claim") / (2 * F.col("j") + 1)))
    q = global_rank(q, [*[F.col(x) for x in within], F.col("q").desc(), *[F.col(x) for x in key], F.col("j")], "r")
    if within:
        q = cut_lineage(q)
        left = left.join(q.groupBy(*within).agg(F.min("r").alias("_first")), within)
        q = q.join(maybe_broadcast(cut_lineage(left)), within)
    else:
        q = q.crossJoin(F.broadcast(left.withColumn("_first", F.lit(0))))
    won = q.where(F.col("r") - F.col("_first") < F.col("_left")).select(*key, F.lit(1).cast("long").alias("quota"))
    return (won.union(c.select(*key, F.col("base").alias("quota"))).groupBy(*key)
            .agg(F.sum("quota").alias("quota")).where("quota > 0"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
        weight: Column | None = None, blocks: int = BLOCKS, max_repeat: int = 3, shard_docs: int = SHARD_DOCS,
        seed: int = 17) -> DataFrame:
    """One row per document: ``(doc_id, source, size, source_size, target, taken)``; ``taken`` is
    the number of its words in the mix, repeats counted. ``size`` defaults to the words of ``text``,
    ``weight`` (an expression on the source's rank ``idx``) to the cycle 5, 2, 1."""
    sized = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    (word_count(F.col("text")) if size is None else size).alias("size")))
    src = cut_lineage(source_targets(sized, cyclic_weights() if weight is None else weight, max_repeat))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    longest = max(1, -(-total // blocks))

    s = src.withColumnRenamed("source", "_s")
    d = (sized.join(maybe_broadcast(s), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
         .withColumn("shard", F.pmod(seeded("doc_id", seed=seed), F.ceil(F.col("n_docs") / shard_docs))))
    shard = d.groupBy("idx", "shard").agg(F.sum("size").alias("tokens"))
    shard = cut_lineage(shard.where("tokens > 0").withColumn(
        "block", F.least(F.lit(longest), F.ceil(F.col("tokens") / SHARD_BLOCKS)).cast("long")))

    claims = src.select("idx", (F.col("source_size") * max_repeat).alias("most"), F.col("target").alias("claim"))
    quota = _seats(claims, [], total, ["idx"]).withColumnRenamed("quota", "won")
    claims = shard.join(quota, "idx").select("idx", "shard", "won", (F.col("tokens") * max_repeat).alias("most"),
                                             F.col("tokens").cast("double").alias("claim"))
    quota = _seats(claims, ["idx"], "won", ["idx", "shard"])
    shard = cut_lineage(shard.join(quota, ["idx", "shard"]).select(
        "idx", "shard", "tokens", "block", F.floor(F.col("quota") / F.col("tokens")).alias("passes"),
        (F.col("quota") % F.col("tokens")).alias("rest")))

    order = Window.partitionBy("idx", "shard").orderBy(seeded("idx", "shard", "b", seed=seed), "b")
    long = F.least(F.col("block"), F.col("tokens") - F.col("b") * F.col("block"))
    drawn = (shard.where("rest > 0").withColumn("b", F.explode(F.sequence(
                 F.lit(0).cast("long"), F.ceil(F.col("tokens") / F.col("block")) - 1)))
             .withColumn("before", F.sum(long).over(order.rowsBetween(Window.unboundedPreceding, 0)) - long)
             .where("before < rest").select("idx", "shard", "b", F.least(long, F.col("rest") - F.col("before")).alias("_in")))

    order = Window.partitionBy("idx", "shard").orderBy(seeded("doc_id", seed=seed), "doc_id", "size")
    keep = ["doc_id", "source", "size", "source_size", "target"]
    d = d.join(maybe_broadcast(shard.select("idx", "shard", "passes", "block")), ["idx", "shard"], "left")
    d = (d.where("size > 0").withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("start", F.col("end") - F.col("size"))
         .unionByName(d.where("size = 0").withColumns({"start": F.lit(None).cast("long"),
                                                       "end": F.lit(None).cast("long")})))
    d = cut_lineage(d)
    block = F.coalesce("block", "end")  # a shard without a quota has no drawn blocks
    spans = d.where("size > 0").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block),
                                                                     F.floor((F.col("end") - 1) / block))))
    at = F.col("b") * block
    hit = F.when(F.col("_in").isNotNull(), F.greatest(
        F.least(F.col("end"), at + F.col("_in")) - F.greatest(F.col("start"), at), F.lit(0))).otherwise(0)
    spans = (spans.join(drawn, ["idx", "shard", "b"], "left")
             .groupBy("idx", "shard", "start", "passes", *keep).agg(F.sum(hit).alias("part")))
    taken = F.coalesce("passes", F.lit(0)) * F.col("size") + F.col("part")
    return spans.select(*keep, taken.cast("long").alias("taken")).unionByName(
        d.where("size = 0").select(*keep, F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", shard_docs: int = SHARD_DOCS,
                  seed: int = 17, **options) -> DataFrame:
    """``docs`` as rows of the mix, in whole documents. In a shard the shares taken / size are rounded in order of
    size, each with what the ones before left over, from a seeded start: so a shard's words are within its longest
    document of those that ``mix`` takes. Rows that share an id and a source count as one document."""
    taken = mix(docs, id_col, source_col, shard_docs=shard_docs, seed=seed, **options).groupBy("doc_id", "source").agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("size > 0")
    taken = cut_lineage(taken)
    n = cut_lineage(taken.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n")))
    taken = (taken.join(maybe_broadcast(n), F.col("source").eqNullSafe(F.col("_s")))
             .withColumn("shard", F.pmod(seeded("doc_id", seed=seed), F.ceil(F.col("_n") / shard_docs))))
    by = Window.partitionBy("source", "shard").orderBy("size", seeded("doc_id", seed=seed), "doc_id")
    upto = (F.sum(F.col("taken") / F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, 0))
            + F.pmod(seeded("source", "shard", seed=seed), F.lit(1 << 20)) / (1 << 20))
    # the start is below 1, so nothing is emitted before the first document
    taken = taken.withColumn("_upto", F.floor(upto + 1e-9)).withColumn(
        "_copies", (F.col("_upto") - F.coalesce(F.lag("_upto").over(by), F.lit(0))).cast("int"))
    taken = cut_lineage(taken.where("_copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                                                          "_copies"))
    row = F.struct(*[docs[c].alias(c) for c in docs.columns])
    same = docs[id_col].eqNullSafe(taken["_id"]) & docs[source_col].eqNullSafe(taken["_source"])
    return (docs.join(maybe_broadcast(taken), same)
            .select(F.explode(F.array_repeat(row, taken["_copies"])).alias("row")).select("row.*"))
