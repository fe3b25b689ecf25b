"""URL filters: a blocked Bloom filter over listed canonical URLs, then an exact hash join.

Native on the whole path: DataFrame functions only. Verdicts come first from host rules (allow or block a
domain and its subdomains below a path; the longest fitting rule wins), else from the list: a URL whose
canonical form is listed is blocked.

The filter has one 64-bit block for every four listed URLs and eight bits for a URL in its block, built
by a bitwise-or aggregate. It has at most ``broadcast_blocks`` blocks (16 bytes each), so its broadcast is bounded: a longer
list makes it fuller, which costs false positives and no result. URLs that miss the filter are not
listed and skip the join; possible hits are joined with the list itself, which removes false positives.

Null URLs and URLs without "://" have empty host and path, fit no rule and are allowed. A repeated row is
judged each time. An empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URLS_PER_BLOCK = 4
PROBES = 8
BROADCAST_BLOCKS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules are policy, kept by hand: at most MAX_RULES of them stand in the plan.
MAX_RULES = 1000
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: A canonical URL that this many pages or more share is listed by op10.
LISTED_PAGES = 2


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without .html and closing slashes, no query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html?)?/*\z", ""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(name, verdict) of the longest rule that fits, else null; equal lengths go by name."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    if not rules:
        return out
    chain = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        own = r.host.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def _mask(key: Column) -> Column:
    """PROBES bits of a 64-bit block: six bits of the key's second hash for each."""
    h = F.xxhash64(key, F.lit(2))
    m = F.lit(0).cast("long")
    for i in range(PROBES):
        six = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        m = m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), six))
    return m


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the distinct keys in ``listed.key``."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def listed_keys(urls: DataFrame, listed: DataFrame, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """urls (with a column key) plus is_listed. listed: a column key; its nulls and repeats count for nothing."""
    keys = written(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed-urls")
    # Longer lists share the bound's blocks: more false positives for the exact join, never a larger broadcast.
    blocks = max(1, min(broadcast_blocks, -(-keys.count() // URLS_PER_BLOCK)))
    bits = F.broadcast(written(bloom(keys, blocks), "bloom"))
    probed = urls.withColumn("__block", _block(F.col("key"), blocks)).join(bits.withColumnRenamed("block", "__block"), "__block", "left")
    mask = _mask(F.col("key"))
    probed = probed.withColumn("__maybe", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("__block", "bits")
    miss = probed.where(~F.col("__maybe")).withColumn("is_listed", F.lit(False))
    exact = keys.withColumn("__in", F.lit(True))
    hit = probed.where("__maybe").join(exact, "key", "left").withColumn("is_listed", F.coalesce("__in", F.lit(False))).drop("__in")
    return miss.drop("__maybe").unionByName(hit.drop("__maybe"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, is_listed, verdict) of pages(page_id, url); listed: canonical URLs as key."""
    u = F.col("url")
    rows = pages.select("page_id", host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", canonical(F.col("host"), F.col("path")))
    found = listed_keys(rows, listed, broadcast_blocks)
    verdict = F.coalesce("r.verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("r.name").alias("rule"), "is_listed", verdict.alias("verdict"))


def crowded_urls(pages: DataFrame, least: int = LISTED_PAGES) -> DataFrame:
    """Canonical URLs with a host that ``least`` pages or more share, as key."""
    u = F.col("url")
    rows = pages.select(host_of(u).alias("host"), path_of(u).alias("path")).where("host <> ''")
    return rows.groupBy(canonical(F.col("host"), F.col("path")).alias("key")).count().where(F.col("count") >= least).select("key")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. Listed are the canonical URLs that two pages or more share: mirrors and
    crawler traps that a corpus needn't hold twice."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, crowded_urls(pages))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
k AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?)?/*$', '') AS key FROM p),
l AS (SELECT key FROM k WHERE host <> '' GROUP BY key HAVING count(*) >= 2),
r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM k) h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, k.host, k.path, rule, l.key IS NOT NULL AS is_listed,
       coalesce(rule_verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN fit ON k.host = fit.host AND k.path = fit.path LEFT JOIN l ON k.key = l.key
"""
