"""Operator 3: document fingerprints by threshold-scaled sketches.

A sketch retains every shingle hash below a fixed fraction of the hash range, so its
size follows the document's and the sketches of parts merge by union; overlaps of
two sketches estimate resemblance and containment, also of documents of very
unequal length. A shingle is 16 bytes of the UTF-8 text at every position
(a shorter text is one shingle). The smallest hash is kept too, apart from the
sketch: it tells texts apart that are too short to have a hash below the threshold.

Defined results: a null text is the empty text, whose fingerprint is ``-:``; equal
texts have equal fingerprints; two empty sketches are alike (1.0) if their smallest
hashes are equal (both empty texts included) and unlike (0.0) otherwise; of an empty
and a filled sketch the likeness is 0. Repeated ids stand beside each other, by
text; null ids come last; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE_BYTES = 16
#: One hash in so many is retained (a power of two).
SCALE = 8
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_POWERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)
_NONE = np.zeros(0, np.uint64)
_EMPTY = np.zeros(0, np.uint32)


def shingle_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of all shingles, in order."""
    if not data:
        return _NONE
    if len(data) < SHINGLE_BYTES:
        return np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), np.uint64)
    h = _BYTE[np.frombuffer(data, np.uint8)]
    for step, power in zip((1, 2, 4, 8), _POWERS):  # hashes of 2, 4, 8, 16 bytes from two halves
        h = h[:-step] * power + h[step:]
    h ^= h >> _SHIFT
    h *= _MIX
    h ^= h >> _SHIFT
    return h


def sketch(text: str, scale: int = SCALE) -> tuple[np.ndarray, int | None]:
    """Retained hashes (sorted, 32 significant bits) and the smallest hash (None for an empty text)."""
    h = shingle_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(h):
        return _EMPTY, None
    kept = h[h < np.uint64((1 << 64) // scale)]
    shift = np.uint64(32 - (scale.bit_length() - 1))
    return np.unique((kept >> shift).astype(np.uint32)), int(h.min())


def likeness(a: tuple, b: tuple) -> tuple[float, float]:
    """Estimated resemblance, and containment of the smaller in the larger."""
    (x, low), (y, low2) = a, b
    if not len(x) or not len(y):
        same = float(not len(x) and not len(y) and low == low2)
        return same, same
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both), both / min(len(x), len(y))


def encode(s: tuple) -> str:
    """Text form: smallest hash in hex, ``:``, the retained hashes, 4 bytes each, in base64."""
    if s[1] is None:
        return "-:"
    return f"{s[1]:016x}:{base64.b64encode(s[0].astype('>u4').tobytes()).decode()}"


def decode(text: str) -> tuple[np.ndarray, int | None]:
    low, _, body = text.partition(":")
    kept = np.frombuffer(base64.b64decode(body), ">u4").astype(np.uint32)
    return kept, None if low == "-" else int(low, 16)


def merge(a: tuple, b: tuple) -> tuple[np.ndarray, int | None]:
    """Sketch of two documents together."""
    lows = [x for x in (a[1], b[1]) if x is not None]
    return np.union1d(a[0], b[0]), min(lows, default=None)


def with_next(docs: DataFrame) -> DataFrame:
    """Deals ``docs(doc_id, text)`` into ranges of descending ids, each followed by a copy of the first
    row after it (flag ``after``; after the last range comes the first), sorted for one sequential pass.

    The driver learns the range limits only: at most one id per partition."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    ids = d.select("doc_id").withColumn("_k", key)
    limits = sorted(set(ids.where("doc_id IS NOT NULL").approxQuantile("_k", [i / n for i in range(1, n)], 0.2 / n)))
    limits = limits or [0.0]  # a Bucketizer needs one inner limit
    cut = Bucketizer(splits=[float("-inf"), *limits, float("inf")], inputCol="_k", outputCol="_b")
    place = (F.lit(len(limits)) - F.col("_b")).cast("int").alias("place")  # 0 holds the largest ids
    firsts = (cut.transform(ids).select("doc_id", place).groupBy("place").agg(F.max("doc_id").alias("first"))
              .orderBy("place").collect())
    if not firsts:
        return d.select(F.lit(0).alias("place"), F.lit(False).alias("after"), "doc_id", "text")
    # the first rows of a range also go behind the range before
    to = [(r["place"], r["first"], firsts[i - 1]["place"]) for i, r in enumerate(firsts)]
    to = F.broadcast(docs.sparkSession.createDataFrame(to, "p int, first long, also int"))  # a row per partition
    x = cut.transform(d.withColumn("_k", key)).select("doc_id", "text", place)
    x = x.join(to, (F.col("place") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("place"), F.lit(False).alias("after"))
    ghost = F.struct(F.col("also").alias("place"), F.lit(True).alias("after"))
    x = x.select("doc_id", "text", F.explode(F.when(F.col("also").isNull(), F.array(own))
                                             .otherwise(F.array(own, ghost))).alias("_at"))
    x = x.select("_at.place", "_at.after", "doc_id", "text")
    return x.repartitionById(len(limits) + 1, "place").sortWithinPartitions(
        "place", "after", F.col("doc_id").desc_nulls_last(), "text")


def edited_text(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first code points of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """One row per document with its fingerprint and that of its edited text, and how alike the
    fingerprint is to the edited text's and to the next document's (by descending id)."""
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
            "contained_edited", "contained_next"]
    kinds = pa.schema(list(zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                                      pa.float64(), pa.float64(), pa.float64()])))

    def task(batches):
        prev, rows = None, []  # prev: place, after, id, text, sketch
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("place", "after", "doc_id", "text"))):
                if prev and prev[0] == r[0] and prev[1]:
                    continue  # one copy is enough
                now = (*r, sketch(r[3], scale))
                if prev and prev[0] == r[0]:
                    edit = edited_text(prev[3], r[3])
                    es = sketch(edit, scale)
                    (je, ce), (jn, cn) = likeness(prev[4], es), likeness(prev[4], now[4])
                    rows.append((prev[2], len(prev[3]), hashlib.sha256(edit.encode()).hexdigest(), encode(prev[4]),
                                 encode(es), je, jn, ce, cn))
                prev = now
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)],
                                                     schema=kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    ddl = ", ".join(f"{c} {t}" for c, t in zip(cols, ["long", "long", "string", "string", "string", *["double"] * 4]))
    return with_next(docs).mapInArrow(task, ddl)
