"""URL filter: rules by host and path, and a blocked Bloom filter before an exact join.  All in DataFrame operations.

Listed URLs are compared in canonical form: scheme, ``www.``, default port, fragment,
tracking parameters (``utm_*``, ``ref``), ``index.html`` and a trailing slash are
dropped, the host is lower-cased and the other parameters are sorted.

The filter holds BITS bits a listed URL in blocks of 256.  A URL sets eight bits of one
block, so a probe reads one row of a table that is broadcast if its counted rows are few
and shuffled by block otherwise.  Only possible hits go to the hash join with the list,
which removes false positives.  Where the counted list is small, filter and list are
broadcast and the pages are read once, without a shuffle; otherwise that join is salted,
as one URL may hold many rows, and only possible hits are shuffled.

Null URLs, and URLs without ``://``, have an empty host and path, fit no rule and are
never listed.  Repeated rows are each judged.  URLs of any length are compared whole; of equally long rules
the last in the order of verdict, host and path holds; an empty table or list gives an empty result or no hits; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.plans.skew import BROADCAST_ROWS, salted_join
from respondex.plans.staging import staged

#: Bits of the filter for each listed URL; bits of a block.
BITS, BLOCK = 16, 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Rules of the contract: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Pages of at least one such sign in SIGNS_IN characters are rejected by content; the query lists their URLs.
SIGNS, SIGNS_IN = "[#*$%|]", 50


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Canonical form of a URL; null without ``://``."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    p = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", "/"), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref)(=|$)"))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(h, p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def fitting_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def masks(url: Column) -> list[Column]:
    """The four 64-bit words of a URL's eight bits."""
    h = F.xxhash64(url, F.lit(1))
    bits = [F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8)]
    out = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for b in bits:
            word = word.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0..w3)`` of a table of distinct canonical URLs ``c``."""
    rows = listed.select(block(F.col("c"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks(F.col("c")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, listed)`` of every row of pages.

    verdict: the longest fitting rule's, else ``block`` if the URL is listed, else
    ``allow``.  listed: whether the exact join found it (null if a rule fitted).
    """
    known = staged(listed.select(canonical(F.col(listed_col).cast("string")).alias("c")).where("c IS NOT NULL").distinct(), "listed-urls")
    n = known.count()
    blocks, small = max(1, -(-n * BITS // BLOCK)), n <= BROADCAST_ROWS
    table = bloom(known, blocks)
    table = F.broadcast(table) if blocks <= BROADCAST_ROWS else table
    u = F.col("u")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u")).select("id", host(u).alias("host"), path(u).alias("path"), canonical(u).alias("c"))
    rows = rows.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    free = rows.select("*", block(F.coalesce("c", F.col("id").cast("string"), F.lit("")), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks(F.col("c")))])
    probed = free.join(table, "block", "left")
    inside = F.coalesce(F.col("w0").bitwiseAND(F.col("m0")) == F.col("m0"), F.lit(False))
    for i in range(1, 4):
        inside = inside & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    inside = F.coalesce(inside & F.col("r").isNull(), F.lit(False))
    found = known.withColumn("found", F.lit(True))
    if small:
        at = probed.withColumn("c", F.when(inside, F.col("c"))).join(F.broadcast(found), "c", "left")
    else:
        at = salted_join(probed.where(inside), found, ["c"]).unionByName(probed.where(~inside).withColumn("found", F.lit(False)))
    hit = F.when(F.col("r").isNull(), F.coalesce("found", F.lit(False)))
    return at.select(F.col("id").alias(id_col), "host", "path", "r.rule", F.coalesce("r.verdict", F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed"))


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page; listed are the URLs of pages rejected by their content, one sign or more in SIGNS_IN characters."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    signs = F.length("html") - F.length(F.regexp_replace("html", SIGNS, ""))
    listed = pages.where(SIGNS_IN * signs >= F.length("html")).where("html <> ''").select("url")
    return judged(pages, listed).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (SELECT page_id, url, html <> '' AND 50 * (length(html) - length(regexp_replace(html, '[#*$%|]', '', 'g'))) >= length(html) AS bad, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h0, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT page_id, url, bad, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
  list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS pairs FROM p),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END END AS canon FROM q),
listed AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND bad),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(v, rh, rp)),
fit AS (SELECT page_id, host AS h, path AS pa, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v FROM (SELECT DISTINCT page_id, host, path FROM c) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2, 3)
SELECT c.page_id, host, path, rule, coalesce(v, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON fit.page_id = c.page_id AND h = host AND pa = path LEFT JOIN listed l ON l.canon = c.canon
"""
