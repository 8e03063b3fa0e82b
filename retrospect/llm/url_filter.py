"""URL block and allow rules: host-suffix and path-prefix expressions, hashed and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: Most bytes of rules that are broadcast; a larger rule set goes to a shuffled join.
BROADCAST_BYTES = 32 << 20
#: Hexadecimal digits of a rule's digest that the join compares first.
SHORT = 8


def host_of(url):
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (its host and path joined, or null) and verdict to each row of ``df``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains of it if the url's path starts with the rule's. The longest rule (host and path in
    characters) wins, then the one with the longer host, then block before allow. Without a rule
    the verdict is ``default``.

    Method: a url is expanded into each suffix of its host by whole labels, times each prefix of
    its path whose length some rule's path has (so that any string prefix can be a rule, not only
    whole folders). Expressions meet rules on 32 bits of a digest; what meets is confirmed by the
    full SHA-256. A row's expressions stay in its own task until they are reduced to one best
    rule, so the shuffle after it carries one row a url, and a hot host adds nothing.

    Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule; a
    rule with a null or empty host fits nothing, a rule's null path counts as empty; repeated
    rules count once; rows of ``df`` that repeat are judged each; columns of ``df`` that bear a
    result's name are replaced, others stay; no rules: all rows get the default."""
    known = rules.where("host <> ''").select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    bound = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 160).alias("bytes"), F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    text = F.concat(F.col("r_host"), F.lit("\n"), F.col("r_path"))
    known = known.withColumns({"r_digest": F.sha2(text.cast("binary"), 256)}).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    if (bound["bytes"] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)

    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    # the row's own columns travel as one, so that no name of theirs can meet a helper's
    rows = df.select(F.struct(*kept).alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("number"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    lengths = F.array(*[F.lit(x) for x in bound["lengths"]]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.expr("path").substr(F.lit(1), n))
    texts = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    wide = rows.withColumn("digest", F.explode_outer(F.transform(texts, lambda t: F.sha2(t.cast("binary"), 256))))
    met = wide.join(known, (F.substring("digest", 1, SHORT) == F.col("r_short")) & (F.col("digest") == F.col("r_digest")), "left")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = F.max(F.when(F.col("r_digest").isNotNull(), rank)).alias("best")
    found = met.groupBy("number").agg(*[F.first(c).alias(c) for c in ("row", "host", "path")], best)
    return found.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from ``judge_urls`` over all pages."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY r_host IS NULL, length(r_host) + length(r_path) DESC, length(r_host) DESC) AS n
  FROM u LEFT JOIN r ON (host = r_host OR suffix(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
