"""One query per operator over the driver's tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.llm import decontaminate, fingerprint, hamming, lines, mixing, neardup, pii, quality, runs, tokens, urls, warc
from casekit.llm import whitening as whiten
from casekit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark, sf_dir):
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op2_benchmark_simhash(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_scaled_sketch(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_fuzzy_lines(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


@query
def op5_quality_ngrams(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_warc_transactions(spark, sf_dir):
    c = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    full = F.col("response.type") == "response"
    return c.select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(full, F.col("response.length")).otherwise(F.col("metadata.payload_length")).alias("payload_bytes"),
        F.when(full, F.col("response.sha256")).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("metadata.refers_to_page").alias("refers_to"),
        F.col("request.record_id").isNotNull().alias("has_request"))


ORACLE["op6_warc_transactions"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to, true AS has_request
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
"""


@query
def op7_token_frames(spark, sf_dir):
    import public_tokenizers

    return tokens.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_pii_bootstrap(spark, sf_dir):
    f = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), partial(operator.eq, i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(pii.KINDS)]
    return f.select("doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
                    pii.span_list(F.sort_array(F.concat("base", "added"))).alias("spans"),
                    F.size("added").cast("long").alias("n_added"))


@query
def op9_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_frame(spark, urls.RULES))


ORACLE["op9_url_filter"] = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), rules(kind, h, q) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
         ('allow', 'org', '/fr/')
), best AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(kind, length(h || q)) AS kind
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, best.rule, coalesce(best.kind, 'allow') AS verdict
FROM s LEFT JOIN best USING (page_id)
"""


@query
def op10_chosen_path(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.planted_tail().alias("text"))
    r = runs.periodic_runs(docs).withColumn("best", runs.strongest("runs"))
    lines_ = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    listed = F.concat_ws("", F.transform(lines_, lambda x: F.concat(x, F.lit("\n"))))
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.period", "best.length",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_chebyshev_whitening(spark, sf_dir):
    return whiten.whitened(whiten.lattice(table(spark, sf_dir, "embeddings"), "embedding"))


@query
def op13_simhash_index(spark, sf_dir):
    d = hamming.simhash_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
