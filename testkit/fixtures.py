"""Crawl columns the supplied tables lack, derived from them row by row.

The supplied pages have no status, headers, cookies or resource lists. They are
made by integer arithmetic on ``page_id`` over the whole table, in SQL text that
Spark and DuckDB both run. The values are made up; they exercise rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators.extract import page_rows
from pagequarry.sources.tables import spread

HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
STATUS = (
    "CASE WHEN page_id % 23 = 0 THEN 404 WHEN page_id % 41 = 0 THEN 500 WHEN page_id % 29 = 3 THEN 301 ELSE 200 END"
)
FINAL_URL = "CASE WHEN page_id % 29 = 3 THEN url || '/moved' ELSE url END"
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
DEPTH = (
    f"CAST(length({PATH}) - length(replace({PATH}, '/', '')) - 1"
    f" + CASE WHEN length({HOST}) % 3 = 0 THEN 2 ELSE 0 END AS INT)"
)
LOAD = "CAST((page_id * 37) % 900 + 20 AS DOUBLE) / 1000"

_HEAD = """CASE page_id % 5
WHEN 0 THEN '<meta name="description" content=" About &amp; more "><meta name="viewport" content="width=device-width"><link rel="canonical" href="/c/1"><meta property="og:title" content="t">'
WHEN 1 THEN '<link rel="stylesheet" href="/s.css"><link rel="icon" href="fav.ico"><link rel="preload" href="/f.css?v=1"><script src="/a.js"></script><script src="https://cdn.example-cdn.com/gtag/js"></script>'
WHEN 2 THEN '<script>gtag("a"); fbq("b");</script><meta http-equiv="refresh" content="9">'
ELSE '' END || '</head>'"""
_BODY = """CASE page_id % 6
WHEN 1 THEN '<img src="/a.png"><img src="/b.png" alt="" width="1"><img src="/a.png" alt="again" role="presentation">'
WHEN 2 THEN '<form><label for="e">E</label><input id="e"><input name="q" type="text"><label>in <input name="w"></label><input type="hidden"></form>'
WHEN 3 THEN '<h3>skip</h3><h2>ok</h2><h4>skip</h4><button></button><button> go </button><a href="/x"></a><a href="/x2"><b>named</b></a>'
WHEN 4 THEN '<script type="application/ld+json">{"@type":"Org"}</script><script type="application/ld+json">{bad</script><meta name="robots" content="noindex">'
WHEN 5 THEN '<div aria-hidden="true"><p>a<br></p><span role="button">x</span></div><h1>second</h1><a class="btn" href="/y#f">sign up</a><p>privacy cookie consent api_key = "abcdef123456789" /api/v1/ a@b.org</p>'
ELSE '<div class="wp-embed"><img src="../i/x.woff"><video src="//v.example.org/m.mp4"></video><iframe src="/f"></iframe></div><form><input name="i1"><input name="i2"><select name="i3"></select><textarea name="i4"></textarea><input name="i5"><input name="i6"><input name="i7"><input name="i8" aria-label="eight"><input type="submit"></form><p>cookie token: "zyxwvutsrqponml" /api/ c@d.example.com</p>' END || '</article>'"""
_NAV = """CASE WHEN page_id % 2 = 0 THEN '<nav><a href="/n1">n1</a><a href="/n2">n2</a><a href="/n3">n3</a><a href="/n4">n4</a><a href="/n5">n5</a><a href="/n6">n6</a><a href="/n7">n7</a><a href="mailto:x">n8</a><a href="#n9">n9</a>' ELSE '<nav>' END"""
_TITLE = """CASE WHEN page_id % 13 = 5 THEN '<ttl>' WHEN page_id % 19 = 4 THEN '<title>A rather long lead-in for this title that goes on and on and on ' ELSE '<title>' END"""
_LANG = """CASE WHEN page_id % 17 = 3 THEN ' data-l="' ELSE ' lang="' END"""
HTML = (
    f"replace(replace(replace(replace(replace(html, '</head>', {_HEAD}), '</article>', {_BODY}), '<nav>', {_NAV}),"
    f" '<title>', {_TITLE}), ' lang=\"', {_LANG})"
)

# Header name -> value (null where the page does not send it).
HEADERS = {
    "strict-transport-security": "CASE page_id % 4 WHEN 1 THEN 'max-age=31536000; includeSubDomains' WHEN 2 THEN 'max-age=3600' END",
    "content-security-policy": "CASE page_id % 5 WHEN 1 THEN 'default-src self; frame-ancestors none' WHEN 2 THEN 'script-src unsafe-inline unsafe-eval' END",
    "x-content-type-options": "CASE page_id % 3 WHEN 1 THEN 'nosniff' WHEN 2 THEN 'none' END",
    "referrer-policy": "CASE WHEN page_id % 2 = 0 THEN 'no-referrer' END",
    "permissions-policy": "CASE WHEN page_id % 6 = 0 THEN 'camera=()' END",
    "feature-policy": "CASE WHEN page_id % 6 = 1 THEN 'camera=()' END",
    "x-frame-options": "CASE WHEN page_id % 7 = 0 THEN 'DENY' END",
    "server": "CASE page_id % 4 WHEN 0 THEN 'nginx/1.25.3' WHEN 1 THEN 'cloudflare' WHEN 2 THEN 'Apache' END",
    "x-powered-by": "CASE page_id % 8 WHEN 3 THEN 'Express/4.18.1' WHEN 5 THEN 'PHP/8.2' END",
}
COOKIE_NAME = "CASE n WHEN 0 THEN 'csrftoken' WHEN 1 THEN '_ga' ELSE 'phpsessid' END"
COOKIE_DOMAIN = "CASE WHEN n = 1 THEN '.ads.example.net' ELSE '' END"
COOKIE_SECURE = "(page_id + n) % 2 = 0"
COOKIE_HTTPONLY = "(page_id + n) % 3 = 0"

RESOURCE_DOMAIN = (
    "CASE (page_id * 7 + n * 3) % 12 WHEN 5 THEN 'cdn.example-cdn.com' WHEN 6 THEN 'www.google-analytics.com'"
    " WHEN 7 THEN 'connect.facebook.net' WHEN 8 THEN 'www.youtube.com' WHEN 9 THEN 'static.hotjar.com'"
    " WHEN 10 THEN 'fonts.gstatic.com' WHEN 11 THEN 'img' || CAST(page_id % 9 AS STRING) || '.partner.example.org'"
    " ELSE scan_id END"
)
RESOURCE_SCHEME = "CASE WHEN (page_id + n) % 11 = 0 THEN 'http' ELSE 'https' END"
RESOURCE_TYPE = (
    "CASE (page_id + n) % 5 WHEN 0 THEN 'CSS' WHEN 1 THEN 'JS' WHEN 2 THEN 'IMAGE' WHEN 3 THEN 'VIDEO' ELSE 'OTHER' END"
)
RESOURCE_SIZE = (
    "CASE WHEN (page_id + n) % 17 = 0 THEN NULL ELSE CAST(((page_id * 7919 + n * 104729) % 2600) * 1024 AS BIGINT) END"
)
STARTED = "CAST('2024-01-01 00:00:00' AS TIMESTAMP)"
RESTARTED = "CAST('2024-01-08 00:00:00' AS TIMESTAMP)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"))


HTML_AFTER = f"replace({HTML}, 'wp-embed', 'ng-app')"


def _page_columns(scan: str, url: str, final_url: str, header_suffix: str) -> list[str]:
    names = ", ".join(
        f"'{name}', CASE WHEN page_id % 4 = 1 THEN ({value}) || '{header_suffix}' ELSE {value} END" if header_suffix
        else f"'{name}', {value}"
        for name, value in HEADERS.items()
    )
    cookies = (
        "transform(filter(sequence(0, 14), n -> n < page_id % 4), n -> named_struct("
        f"'name', {COOKIE_NAME}, 'domain', {COOKIE_DOMAIN}, 'secure', {COOKIE_SECURE}, 'httponly', {COOKIE_HTTPONLY}))"
    )
    return [
        f"{scan} AS scan_id", "page_id AS seq", f"{url} AS url", f"{final_url} AS final_url", f"{STATUS} AS status_code",
        f"{DEPTH} AS depth", f"{LOAD} AS load_time", f"map_filter(map({names}), (k, v) -> v IS NOT NULL) AS headers",
        f"{cookies} AS cookies", f"{HTML_AFTER if header_suffix else HTML} AS html",
    ]


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page rows of the first scan of every host."""
    return page_rows(_raw(spark, folder).selectExpr(*_page_columns(HOST, "url", FINAL_URL, "")))


def _with_host(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).selectExpr("page_id", "url", f"{HOST} AS scan_id")


def _resource_rows(hosts: DataFrame) -> DataFrame:
    rows = hosts.select("*", F.explode(F.expr("filter(sequence(0, 14), n -> n < page_id % 15)")).alias("n"))
    return rows.selectExpr(
        "scan_id", "page_id AS seq", "CAST(n AS BIGINT) AS ord", "n", "page_id",
        f"{RESOURCE_DOMAIN} AS domain", f"{RESOURCE_SCHEME} AS scheme", f"{RESOURCE_TYPE} AS resource_type",
        f"{RESOURCE_SIZE} AS size_bytes",
    ).selectExpr(
        "scan_id", "seq", "ord",
        "scheme || '://' || domain || '/r' || CAST(page_id % 50 AS STRING) || '_' || CAST(n AS STRING) AS url",
        "resource_type", "domain <> scan_id AS is_external", "domain", "size_bytes",
    )


def resources(spark: SparkSession, folder: str) -> DataFrame:
    return _resource_rows(_with_host(spark, folder))


def second_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The later scan of every host: some pages moved, some headers and markup changed."""
    changed = "CASE WHEN page_id % 9 = 0 THEN url || '/new' ELSE url END"
    raw = _raw(spark, folder)
    return page_rows(raw.selectExpr(*_page_columns(f"{HOST} || '@2'", changed, changed, "; v2")))


def second_resources(spark: SparkSession, folder: str) -> DataFrame:
    rows = _resource_rows(_with_host(spark, folder))
    return rows.withColumn("scan_id", F.concat("scan_id", F.lit("@2")))


def websites(spark: SparkSession, folder: str) -> DataFrame:
    hosts = _with_host(spark, folder).groupBy("scan_id").agg(F.min("page_id").alias("first_page"))
    return hosts.selectExpr(
        "scan_id AS website_id", "length(scan_id) % 3 AS user_id", "'https://' || scan_id || '/' AS normalized_url",
        f"timestampadd(MINUTE, CAST(first_page AS INT), {STARTED}) AS created_at",
    )


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Two scans per website; the second failed where the host name's length is a multiple of five."""
    sites = websites(spark, folder).select("website_id")
    return sites.selectExpr(
        "website_id",
        f"explode(array(named_struct('scan_id', website_id, 'started_at', {STARTED}, 'status', 'COMPLETED', 'stage', 'COMPLETED'),"
        f" named_struct('scan_id', website_id || '@2', 'started_at', {RESTARTED},"
        " 'status', CASE WHEN length(website_id) % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END,"
        " 'stage', CASE WHEN length(website_id) % 5 = 0 THEN 'ANALYZING_SEO' ELSE 'COMPLETED' END))) AS s",
    ).selectExpr("s.scan_id", "website_id", "s.started_at", "s.status", "s.stage")


def competitors(spark: SparkSession, folder: str) -> DataFrame:
    """Each website names two rivals: itself under www (same bare host) and the www form of nobody."""
    sites = websites(spark, folder).select("website_id")
    return sites.selectExpr(
        "website_id",
        "explode(array(named_struct('k', 'www', 'u', 'https://www.' || website_id || '/'),"
        " named_struct('k', 'same', 'u', 'https://' || website_id || '/'),"
        " named_struct('k', 'none', 'u', 'https://nobody.' || website_id || '/'))) AS c",
    ).selectExpr("c.k || ':' || website_id AS competitor_id", "website_id", "c.u AS normalized_url")
