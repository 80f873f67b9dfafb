r"""URL filters: a blocked Bloom filter in front of an exact hash join, in DataFrame functions only.

A rule (verdict, host, path) fits a URL on its host or any subdomain whose path starts with the rule's. Every rule has a
canonical form, ``host`` + ``path``, and a shape, its number of host labels and its path's length. A URL's candidates are
its own canonical prefixes of the shapes that the list has, so a row makes as many candidates as there are shapes, never
one for each rule. The Bloom filter drops nearly all candidates of the distinct (host, path) in the stage that makes them;
the hits alone go on, to the exact join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, common

#: Words that the filter may have to be held whole by every task (8 MB); beyond, its blocks are joined.
MAX_HELD_WORDS = bloom.MAX_WORDS
#: Bytes of rules, with so many for each besides its text, up to which the exact join is broadcast; beyond, it shuffles.
MAX_BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a URL; both empty for null and for strings without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) from (verdict, ``host/path``) pairs."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(rule, depth, reach, verdict) of ``rules`` (rule, verdict): host labels and path length of each distinct rule.

    A rule that is listed with both verdicts blocks. Null rules are ignored.
    """
    host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract("rule", "^[^/]*(.*)", 1)
    return (
        rules.filter("rule is not null")
        .select(F.concat(host, path).alias("rule"), _labels(host).alias("depth"), F.length(path).alias("reach"), "verdict")
        .groupBy("rule", "depth", "reach")
        .agg(F.max("verdict").alias("verdict"))
    )


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _candidates(shapes: Column) -> Column:
    """The canonical prefixes of (host, path) that have one of the ``shapes`` (host labels, path length)."""
    fits = F.filter(shapes, lambda s: (s["depth"] <= F.col("labels")) & (s["reach"] <= F.length("path")))
    return F.transform(
        fits,
        lambda s: F.concat(
            F.call_function("substring_index", F.col("host"), F.lit("."), -s["depth"]), F.substr("path", F.lit(1), s["reach"])
        ),
    )


def _hits(urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """(host, path, rule): of distinct ``urls`` (host, path, candidates), the candidates that pass the filter."""
    blocks = bloom.blocks_for(n_rules)
    filled = bloom.bloom_blocks(rules, "rule", blocks)
    key = F.col("rule")
    each = urls.select("host", "path", F.explode("candidates").alias("rule"))
    if blocks * bloom.WORDS <= MAX_HELD_WORDS:
        each = each.withColumn("own", bloom.block_words(bloom.held_words(filled, blocks), key, blocks))
        passes = bloom.all_set([F.get("own", i) for i in range(bloom.WORDS)], key)
    else:
        each = each.withColumn("block", bloom.block_of(key, blocks)).join(filled.hint("merge"), "block")
        passes = bloom.all_set([F.col(f"w{i}") for i in range(bloom.WORDS)], key)
    return each.filter(passes).select("host", "path", "rule")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url), under ``rules`` (rule, verdict).

    Of the rules that fit, the longest wins; of equally long ones, that with more host labels. A URL that no rule fits
    isn't listed and gets ``default`` and a null rule. Defined results: null urls, and those without ``://``, have an
    empty host and path and fit no rule; very long urls are judged whole; repeated rows give repeated results; with no
    rules all URLs get ``default``; an empty table gives an empty result; other columns are ignored.
    """
    listed = common.durable(canonical_rules(rules))
    n_rules, n_bytes = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
    if not n_rules:
        return split.select("*", *none)
    # At most the labels of the longest host times the characters of the longest path, however many rules there are.
    shapes = listed.agg(F.collect_set(F.struct("depth", "reach")).alias("shapes")).scalar()
    distinct = split.filter("host != ''").select("host", "path").distinct()
    distinct = distinct.withColumn("labels", _labels(F.col("host"))).withColumn("shapes", shapes)
    distinct = distinct.withColumn("candidates", _candidates(F.col("shapes")))
    exact = listed.select("rule", "depth", "verdict")
    exact = F.broadcast(exact) if n_bytes + ROW_BYTES * n_rules <= MAX_BROADCAST_BYTES else exact.hint("shuffle_hash")
    best = F.max(F.struct(F.length("rule").alias("size"), "depth", "rule", "verdict")).alias("best")
    found = _hits(distinct, listed, n_rules).join(exact, "rule").groupBy("host", "path").agg(best)
    # Rows without a host, which may be many, have nothing to be joined with.
    judged = split.filter("host != ''").join(found, ["host", "path"], "left")
    judged = judged.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(split.filter("host = ''").select("*", *none))


OP4_SQL = r"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
  ('block', 'net/fr/', 'net', '/fr/')
), a AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT p.*, rules.rule, rules.verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rules.rule) DESC NULLS LAST, length(rhost) DESC) AS place
  FROM p LEFT JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
) WHERE place = 1
"""


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages", "page_id", "url"), rule_table(spark, RULES))
