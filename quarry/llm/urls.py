"""Operator 7: URL filters by a blocked Bloom filter of listed canonical URLs and an exact hash join.

Two lists are probed the same way: a filter passes possible hits, an exact join
removes its false positives.

1. Rules (host, path, verdict). A rule fits its host and all subdomains when the
   URL's path starts with the rule's; the longest rule wins. A URL's candidates
   are the last labels of its host with the first characters of its path, for
   each (labels, path length) that any rule has.
2. Listed canonical URLs, which are blocked, judge the URLs that no rule fits:
   a URL is listed when its canonical form is. In ``judge`` the list is the
   canonical URLs that the rules block, so that other spellings of a blocked
   page (user, port, trailing dot, tracking parameters, fragment) are blocked
   as well; what is on no list is allowed.

Canonical form: no scheme, user, default port, trailing dot of the host,
fragment or tracking parameters (utm_*, gclid, fbclid); no slash at the end.

Scale. Each distinct URL is judged once, and hits alone are shuffled; filters
have a fixed byte bound (see ``bloom``). Verdicts are joined back to the pages
on the URL, an equi-join that AQE may split where one URL is frequent.

Defined cases: a null URL or one without `://` has an empty host and path and
is allowed without a rule; repeated rows each get a row; an empty table gives no
rows; equally long rules are decided by the longer host, then the rule's text;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import common as C

# The rules of the query (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _after(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return C.fold_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Canonical form; empty for a null URL or one without `://`."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"\.?(:(80|443)?)?$", "")
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[^=]*|gclid|fbclid)(=|$)") & (p != "")), "&")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _hits(probes: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows of probes whose key is a key of listed(key, ...): Bloom filter, then exact join."""
    words = bloom.build(listed.select(F.xxhash64(key).alias("k")), "k")
    return probes.where(bloom.maybe(probes.sparkSession, words, F.xxhash64(key))).join(listed, key)


def by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the longest rule that fits each of urls(url, host, path)."""
    listed = rules.select(F.concat("host", "path").alias("rule"), "verdict",
                          F.length("host").alias("_h"), F.size(F.split("host", r"\.")).alias("labels"),
                          F.length("path").alias("chars"))
    shapes = listed.select("labels", "chars").distinct().collect()  # few: label counts x path lengths of the rules
    if not shapes:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    candidates = F.array(*[
        F.when((labels >= s.labels) & (F.length("path") >= s.chars),
               F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.chars))) for s in shapes])
    probes = (urls.where("host <> ''").select("url", F.explode(F.array_distinct(candidates)).alias("rule"))
              .where("rule is not null"))
    hits = _hits(probes, "rule", listed.drop("labels", "chars"))
    best = F.max(F.struct(F.length("rule").alias("n"), "_h", "rule", "verdict"))
    return hits.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.verdict")


def by_list(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """(url) whose canonical form is in listed(canonical)."""
    probes = urls.select("url", canonical(F.col("url")).alias("canonical")).where("canonical <> ''")
    return _hits(probes, "canonical", listed.select("canonical").distinct()).select("url")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url) with host, path, rule and verdict; ``listed``: more canonical URLs to block."""
    url = F.col("url")
    urls = C.pin(pages.select("url").where("url is not null").distinct()
                 .select("url", host_of(url).alias("host"), path_of(url).alias("path")))
    ruled = C.pin(by_rules(urls, rules))
    block = ruled.where("verdict = 'block'").select(canonical(url).alias("canonical")).where("canonical <> ''")
    if listed is not None:
        block = block.unionByName(listed.select("canonical"))
    free = urls.join(ruled, "url", "left_anti")
    verdicts = ruled.unionByName(by_list(free, C.pin(block.distinct())).select(
        "url", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    return (pages.select("page_id", "url").join(verdicts, "url", "left")
            .select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "rule",
                    F.coalesce("verdict", F.lit("allow")).alias("verdict")))


SQL = r"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM a),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
c AS (SELECT p.*, (SELECT max({'n': length(rh || rp), 'rule': rh || rp, 'v': v}) FROM r
      WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS b,
    regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:(80|443)?)?$', '') || regexp_replace(path, '/+$', '') ||
    coalesce('?' || nullif(array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=|$)')), '&'), ''), '') AS canon FROM p)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, b.rule AS rule,
  CASE WHEN b IS NOT NULL THEN b.v WHEN canon <> '' AND canon IN (SELECT canon FROM c WHERE b.v = 'block') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


@C.query("op7_url_filter", SQL)
def op7(spark, sf_dir):
    """Every page's URL against the five rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(C.table(spark, sf_dir, "pages").select("page_id", "url"), rules)
