"""URL filters: a blocked Bloom filter in front of an exact join.

Listed canonical URLs fill a blocked Bloom filter held as a table: a URL's hash names one 64-bit block, and four bits
of it; a block is the bitwise or of its URLs' bits. Pages are looked up in the blocks (broadcast while the table has at
most BROADCAST_BLOCKS rows, else shuffled, with pages that need no look-up spread over all tasks); only those whose four bits are all set are joined exactly, by the canonical
URL, which removes the false positives. Host and path rules come before the list. DataFrame functions only.

Canonical form: the host without a leading www. or m., and the path without a trailing slash or .html; scheme, port
marks, query and fragment are dropped.

Nulls and edge cases: a null URL or one without :// has an empty host and path, matches no rule and is allowed; rules
are tried longest first (host, then path; ties cannot occur between different rules of one length on one URL except by
host, where the earlier rule of the table wins); listed rows may repeat or be null; repeated pages are judged each; URLs
of any length are read whole; an empty table gives no rows; extra columns pass through whatever their names, but columns
host, path, rule and verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BITS_PER_URL = 16
#: At 16 bits a URL, a list of 262,144 URLs at most is broadcast.
BROADCAST_BLOCKS = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_fits(host: str, path: str) -> Column:
    h = F.col("host")
    return ((h == host) | h.endswith("." + host)) & F.startswith(F.col("path"), F.lit(path))


def by_rules(rules=RULES) -> tuple[Column, Column]:
    """The rule that wins and its verdict, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = rule_fits(host, path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def canonical() -> Column:
    return F.concat(F.regexp_replace("host", r"^(?:www|m)\.", ""), F.regexp_replace("path", r"(?:/|\.html)$", ""))


def bloom_key(url: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a URL, and a mask of four bits in it."""
    h = F.xxhash64(url)
    g = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    mask = None
    for i in range(4):
        bit = F.call_function("shiftleft", one, F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(h, F.lit(blocks).cast("long")), mask


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """The rows of pages with host, path, rule and verdict; listed: column canonical, URLs to block."""
    urls = written(listed.where(F.col("canonical").isNotNull()).select(F.col("canonical").alias("hit")).distinct(), "listed-urls")
    n = urls.count()
    blocks = max(1, -(-n * BITS_PER_URL // 64))
    block, mask = bloom_key(F.col("hit"), blocks)
    bloom = urls.select(block.alias("block"), mask.alias("m")).groupBy("block").agg(F.bit_or("m").alias("bits"))
    if blocks <= BROADCAST_BLOCKS:
        bloom, urls = F.broadcast(bloom), F.broadcast(urls)
    # the user's row travels in one struct, so its names meet no other
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # keys that match nothing, by the row's own values, so that rows without a URL or a hit do not meet in one task
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, t in pages.dtypes if "map<" not in t and t != "variant")), F.lit(1 << 40))
    host, path = host_and_path(F.col(f"`{url}`"))
    row = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host.alias("host"), path.alias("path"), (-1 - spread).alias("spread"))
    name, verdict = by_rules(rules)
    told = row.withColumns({"rule": name, "ruled": verdict}).withColumn("asked", F.when(F.col("rule").isNull() & (F.col("host") != ""), canonical()))
    block, mask = bloom_key(F.col("asked"), blocks)
    keyed = told.withColumns({"block": F.when(F.col("asked").isNotNull(), block).otherwise(F.col("spread")), "mask": mask})
    probed = keyed.join(bloom, "block", "left")
    possible = F.when(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.col("asked"))
    probed = probed.withColumn("possible", possible).withColumn("key", F.coalesce("possible", F.col("spread").cast("string")))
    joined = probed.join(urls, (F.col("key") == F.col("hit")) & F.col("possible").isNotNull(), "left")
    out = F.coalesce("ruled", F.when(F.col("hit").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("row.*", "host", "path", "rule", out.alias("verdict"))


#: Hosts whose every known page the query lists, with all their subdomains.
LISTED_HOST = r"(?:^|\.)(?:casino-win|cheap-pills|free-bets|spam-farm)\.example\.(?:com|net|org)\z"


def listed_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """The canonical URLs of all pages of the listed hosts, whatever their numbers: the list that a crawl of them gives."""
    host, path = host_and_path(F.col(f"`{url}`"))
    return pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike(LISTED_HOST)).select(canonical().alias("canonical"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|\.)(casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)\z') THEN 'block'
  ELSE 'allow' END AS verdict FROM j
"""
