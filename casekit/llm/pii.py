"""Operator 8: personal data by patterns, and bootstrapped extraction from their contexts.

Base spans are matches of four fixed patterns. They are the seeds of a bootstrap:
the words around seeds and around other identifier-like tokens (with a digit or an
at-sign) are lexical patterns; Spark scores the graph of patterns and instances in
rounds - a pattern by the share and number of known instances among all it
extracts, an instance by its best pattern - and identifiers that stand in a
high-confidence pattern are added as spans of the pattern's kind.

Defined results: a null text is the empty text, without spans; digests and lists of no
span are of the empty string; repeated rows are searched row by row; an empty table
gives no rows. Other columns are not read. All offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import maybe_broadcast
from casekit.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
#: The fixed patterns, each written so that Java's matcher needs linear time and no recursion: a run is
#: entered at its first character (or where the last match ended), and repetitions give nothing back
#: where giving back can't lead to a match.
_AT = "(?:\\G|(?<![A-Za-z0-9._%+-]))"
PATTERNS = {
    "email": _AT + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Identifier-like tokens: runs of non-space with a digit or at-sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Characters before and after an instance in which its context words are looked for.
CONTEXT = 64


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (
            F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _matches(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of a pattern's valid matches: the texts between the matches and the matches, in turn,
    add up to their offsets."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc, x):
        start = acc["off"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("off"), F.when(valid(x["m"]), F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), found,
                       lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).alias("off"), F.array().cast(_SPAN).alias("spans"))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""
    none = F.array().cast(_SPAN)
    parts = []
    for i, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit("@")) if HINTS[kind] == "@" else F.rlike(text, F.lit(HINTS[kind]))
        parts.append(F.when(hint, _matches(text, PATTERNS[kind], i, lambda m, k=kind: _valid(k, m))).otherwise(none))
    return F.concat(*parts)


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _event(text: Column, s: Column) -> Column:
    """An instance with the words beside it, digits folded."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    at = F.greatest(s["start"] - CONTEXT, F.lit(0))
    left = F.regexp_extract(text.substr(at + 1, s["start"] - at), r"(\S+)\s*$", 1)
    right = F.regexp_extract(text.substr(s["end"] + 1, F.lit(CONTEXT)), r"^\s*(\S+)", 1)
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                    F.lower(text.substr(s["start"] + 1, s["end"] - s["start"])).alias("value"),
                    fold(left).alias("left"), fold(right).alias("right"))


def find(docs: DataFrame, rounds: int = 3, trust: float = 0.5, accept: float = 0.8, support: int = 8) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` (arrays of spans) per row of ``docs``.

    ``trust``: patterns from this score on pass it to their instances; ``accept``: those from this score on
    add spans; ``support``: known instances from which on a pattern's number of them no longer lowers its score.
    """
    text = F.col("text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(text))
    tokens = F.when(F.rlike(text, F.lit("[0-9@]")), F.filter(
        _matches(text, TOKEN, -1, lambda m: F.lit(True)),
        lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    )).otherwise(F.array().cast(_SPAN))
    d = d.withColumn("events", F.transform(F.concat("base", tokens), lambda s: _event(text, s)))
    d = cut_lineage(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "events"))

    e = d.select("row", F.explode("events").alias("e")).select("row", "e.*")
    e = e.withColumn("pattern", F.explode(F.array_compact(F.array(
        F.when(F.col("left") != "", F.concat(F.lit("L "), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("R "), "right")),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B "), "left", F.lit(" "), "right"))))))
    edges = cut_lineage(e.groupBy("pattern", "value").agg(F.count("*").alias("n")))
    many = edges.groupBy("pattern").agg(F.count("*").alias("all"))
    seeds = cut_lineage(e.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("s")).distinct())
    known, scores = seeds, None
    for _ in range(rounds):
        hits = edges.join(maybe_broadcast(known), "value").groupBy("pattern", "kind").agg(F.sum("s").alias("hits"))
        weight = F.least(F.lit(1.0), F.log2(F.col("hits") + 1) / F.log2(F.lit(support + 1.0)))
        scores = cut_lineage(hits.join(many, "pattern").select(
            "pattern", "kind", (F.col("hits") / F.col("all") * weight).alias("score")).where(F.col("score") >= trust))
        if scores.isEmpty():
            break
        new = (edges.join(maybe_broadcast(scores), "pattern").groupBy("value", "kind").agg(F.max("score").alias("s"))
               .join(seeds.select("value").distinct(), "value", "left_anti"))
        known = cut_lineage(seeds.unionByName(new))
    found = e.where((F.col("kind") < 0) & (F.col("value").contains("@") | (
        F.length(F.regexp_replace("value", "[^0-9]", "")) >= 4))).drop("kind")
    best = (found.join(maybe_broadcast(scores.where(F.col("score") >= accept)), "pattern")
            .groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")))
    added = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    return d.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))
