"""Operator 9: URL filter rules matched by hashed host-suffix/path-prefix expressions.

Every URL is expanded into the expressions ``<host suffix><path prefix>`` a rule
could have: the label suffixes of its host, and the prefixes of its path whose
length some rule path has. Expressions meet rules on the first 32 bits of
their SHA-256 digest; the full digest then confirms, and the longest rule wins.
No expression longer than the longest rule is made, so a URL of any length
expands into a bounded list, without loss.

Defined results: a null URL, or one without ``://``, has host and path '' and fits
no rule; a rule with host '' fits nothing; repeated rules count once; of rules of
equal length the one with the longer host wins, then block over allow. Repeated
URLs are judged row by row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.llm.common import maybe_broadcast
from casekit.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
#: Rules of the query, (verdict, host, path).
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substring_index(F.expr("substring(url, locate('://', url) + 3)"), "#", 1))


def split_url(df: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lowered) and ``path`` of the column ``url``."""
    d = df.withColumn("_r", F.substring_index(_after_scheme(F.col("url")), "?", 1))
    host = F.substring_index("_r", "/", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (d.withColumn("host", F.coalesce(lowered, F.lit("")))
            .withColumn("path", F.coalesce(F.expr("substring(_r, char_length(substring_index(_r, '/', 1)) + 1)"),
                                           F.lit(""))).drop("_r"))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """``pages(page_id, url)`` judged by ``rules(verdict, rule_host, rule_path)``: one row per page
    with ``page_id, host, path, rule, verdict``; ``default`` where no rule fits."""
    rules = cut_lineage(rules.where("rule_host <> ''").select(
        "verdict", "rule_host", F.coalesce("rule_path", F.lit("")).alias("rule_path")).distinct()
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
        .withColumn("head", F.substring("digest", 1, 8)))
    most, lengths = rules.agg(F.max(F.size(F.split("rule_host", r"\."))),
                              F.sort_array(F.collect_set(F.char_length("rule_path")))).first()
    # a rule path's possible lengths: at most as many as the longest rule path has characters
    lengths = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    p = split_url(pages.select("page_id", "url").withColumn("_row", F.monotonically_increasing_id()))
    p = cut_lineage(p.drop("url"))
    distinct = p.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit((most or 0) - 1)), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")),
                        lambda n: F.col("path").substr(F.lit(1), n))
    x = (distinct.withColumn("h", F.explode(hosts)).withColumn("q", F.explode(paths))
         .withColumn("full", F.sha2(F.concat_ws("\n", "h", "q"), 256))
         .select("host", "path", "full", F.substring("full", 1, 8).alias("head")))
    fits = x.join(maybe_broadcast(rules), "head").where("full = digest")
    rank = F.struct(F.char_length("rule"), F.char_length("rule_host"), F.col("verdict") == BLOCK)
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return p.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
