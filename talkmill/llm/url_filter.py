"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import ascii_lower, join_skewed, small, table

#: Rules up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000
#: Pairs of label count and path length up to which broadcast rules are joined in place, one pair after another.
PLACES = 48
HASH_PREFIX_HEX = 8

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url):
    """Columns (host, path): host A-Z lower-cased, from the first ``://`` up to ``/ ? #``; path then up to ``? #``.

    Null, or no ``://``: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    ``rules`` holds (host, path, verdict). A rule fits its host and all subdomains if the url's path
    starts with the rule's path. The longest rule string wins, then the longer host, then ``block``.
    Rules with a null part fit nothing. Without a fitting rule, ``rule`` is null and ``verdict`` is
    ``default``. Null urls and urls without ``://`` have an empty host and path. Repeated pages are
    judged alike; with no rules or no pages the result keeps its columns.

    Only label counts and path lengths that some rule has are expanded, so the number of expressions
    of a url doesn't depend on its length. Rules of few shapes that can be broadcast are joined in place,
    without a shuffle. Otherwise urls that agree in all that rules can see are judged once, and the
    verdicts of the most frequent ones come back by a broadcast, those of the others by a shuffle.
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).dropna()
    rules = (
        rules.withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
        .groupBy("digest", "r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # "block" sorts after "allow"
        .withColumn("short", F.substring("digest", 1, HASH_PREFIX_HEX))
    )
    shapes = rules.agg(
        F.collect_set(F.size(F.split("r_host", "\\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")
    ).first()
    labels, lengths = sorted(shapes.labels) or [1], sorted(shapes.lengths) or [0]

    host, path = host_and_path(F.col(url))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rule = F.concat("r_host", "r_path")
    worth = F.struct(F.length(rule).alias("n"), F.length("r_host").alias("m"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))
    is_small = small(rules, BROADCAST_RULES)
    if is_small and len(labels) * len(lengths) <= PLACES:
        return _judged_in_place(parsed, rules.withColumn("worth", worth), labels, lengths).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    tail = F.substring_index("host", ".", -labels[-1])
    parsed = parsed.withColumns({"_tail": tail, "_head": F.substring("path", 1, lengths[-1])})
    parts = F.split("_tail", "\\.")
    suffixes = F.array(*[F.when(F.size(parts) >= n, F.substring_index("_tail", ".", -n)) for n in labels])
    prefixes = F.array(*[F.when(F.length("_head") >= n, F.substring("_head", 1, n)) for n in lengths])
    keys = parsed.select("_tail", "_head").distinct()
    asked = (
        keys.withColumn("s", F.explode(suffixes))
        .withColumn("p", F.explode(prefixes))
        .filter("s is not null and p is not null")
        .withColumn("asked", _digest(F.col("s"), F.col("p")))
        .withColumn("short", F.substring("asked", 1, HASH_PREFIX_HEX))
    )
    near = F.broadcast(rules) if is_small else rules
    found = (
        asked.join(near, "short")
        .filter((F.col("asked") == F.col("digest")) & (F.col("s") == F.col("r_host")) & (F.col("p") == F.col("r_path")))
        .groupBy("_tail", "_head")
        .agg(F.max(worth).alias("best"))
        .select(F.col("_tail").alias("_t"), F.col("_head").alias("_h"), "best.rule", "best.verdict")
    )
    joined = join_skewed(parsed, found, {"_tail": "_t", "_head": "_h"})
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop("_tail", "_head", "_t", "_h")


def _judged_in_place(parsed: DataFrame, rules: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """One broadcast join for each label count and path length; a rule's host and path are unique, so no join multiplies rows."""
    best = []
    for i, (n, size) in enumerate((n, size) for n in labels for size in lengths):
        parts = F.split("host", "\\.")
        suffix = F.when(F.size(parts) >= n, F.substring_index("host", ".", -n))
        prefix = F.when(F.length("path") >= size, F.substring("path", 1, size))
        own = rules.filter((F.size(F.split("r_host", "\\.")) == n) & (F.length("r_path") == size))
        own = own.select(*[F.col(c).alias(f"_{c}{i}") for c in ("short", "digest", "r_host", "r_path", "worth")])
        asked = parsed.withColumns({"_s": suffix, "_p": prefix, "_asked": _digest(suffix, prefix)}).withColumn("_first", F.substring("_asked", 1, HASH_PREFIX_HEX))
        same = (F.col("_asked") == F.col(f"_digest{i}")) & (F.col("_s") == F.col(f"_r_host{i}")) & (F.col("_p") == F.col(f"_r_path{i}"))
        joined = asked.join(F.broadcast(own), (F.col("_first") == F.col(f"_short{i}")) & same, "left")
        parsed = joined.drop("_s", "_p", "_asked", "_first", *[f"_{c}{i}" for c in ("short", "digest", "r_host", "r_path")])
        best.append(f"_worth{i}")
    worth = F.array_max(F.array(*best))
    return parsed.withColumns({"rule": worth["rule"], "verdict": worth["verdict"]}).drop(*best)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT row_number() OVER () AS k, page_id,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT k, page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT k, max_by(r_host || r_path, length(r_host || r_path)) AS rule,
  max_by(r_verdict, length(r_host || r_path)) AS verdict
  FROM parsed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (k)
"""
