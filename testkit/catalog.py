"""Queries by name, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import text as TX
from pagequarry.functions import urls as U
from pagequarry.operators import (
    compare, correlate, diff, duplicates, extract, graph, hosts, model_output, reports, robots, scoring, technology,
)
from pagequarry.operators.rules import pages as page_rules
from pagequarry.operators.rules import resources as resource_rules
from pagequarry.plans.audit import Audit, audit
from pagequarry.session import materialize, stage_root
from pagequarry.sources.tables import read_current, write_run
from pagequarry.streaming.admission import admit
from testkit import ctes as C
from testkit import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_AUDITS: dict[tuple[str, str, int], Audit] = {}


def query(name: str, oracle: str | None = None, **extra: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = C.sql(oracle, **extra)
        return fn

    return register


def audited(spark: SparkSession, d: str, nth: int = 1) -> Audit:
    """The audit of the first or second scan of every host; its stage tables serve later queries of the session."""
    key = (spark.sparkContext.applicationId, d, nth)
    if key not in _AUDITS:
        if nth == 1:
            _AUDITS[key] = audit(X.pages(spark, d), X.resources(spark, d))
        else:
            _AUDITS[key] = audit(X.second_pages(spark, d), X.second_resources(spark, d))
    return _AUDITS[key]


def both(spark: SparkSession, d: str, table: str) -> DataFrame:
    return getattr(audited(spark, d), table).unionByName(getattr(audited(spark, d, 2), table))


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def flat(findings: DataFrame) -> DataFrame:
    """Findings with their evidence in plain columns."""
    e = F.get("evidence", F.lit(0))
    return findings.select(
        "scan_id", "category", "rule_id", big("key1").alias("key1"), big("key2").alias("key2"), "title", "severity", "confidence",
        "impact", "effort", "affected_url", e["evidence_type"].alias("evidence_type"), e["source"].alias("evidence_source"),
        e["value"].alias("evidence_value"),
    )


FLAT = ("scan_id, category, rule_id, key1, key2, title, severity, confidence, impact, effort, affected_url,"
        " evidence_type, evidence_source, evidence_value")

# ---------------------------------------------------------------- extraction


@query("home_pages", "SELECT scan_id, seq, url, status_code, depth FROM home")
def home_pages(spark, d):
    return extract.home_pages(X.pages(spark, d)).select("scan_id", "seq", "url", "status_code", "depth")


@query("page_profiles", """SELECT scan_id, seq, title, meta_description, canonical_url, CAST(word_count AS BIGINT) AS word_count,
 CAST(html_size AS BIGINT) AS html_size, text, CAST(h1_count AS BIGINT) AS h1_count, CAST(link_count AS BIGINT) AS link_count FROM prof""")
def page_profiles(spark, d):
    return extract.page_profiles(X.pages(spark, d)).select(
        "scan_id", "seq", "title", "meta_description", "canonical_url", "word_count", "html_size", "text",
        big("h1_count").alias("h1_count"), big(F.size("internal_links")).alias("link_count"),
    )


@query("page_markup_facts", """SELECT scan_id, seq, CAST(img_no_alt AS BIGINT) AS img_no_alt, coalesce(img_no_alt_first, '') AS img_no_alt_first,
 CAST(unlabeled AS BIGINT) AS unlabeled, unlabeled_first, CAST(heading_skips AS BIGINT) AS heading_skips, heading_skip_first,
 CAST(empty_links AS BIGINT) AS empty_links, empty_link_first, CAST(empty_buttons AS BIGINT) AS empty_buttons, hidden_role,
 CAST(form_max AS BIGINT) AS form_max, CAST(nav_links AS BIGINT) AS nav_links, has_unsized_img, has_html_lang, has_button,
 has_viewport, has_cta_text, CAST(noindex_metas AS BIGINT) AS noindex_metas, CAST(len(json_ld) AS BIGINT) AS json_ld_count FROM prof""")
def page_markup_facts(spark, d):
    counts = ("img_no_alt", "unlabeled", "heading_skips", "empty_links", "empty_buttons", "form_max", "nav_links", "noindex_metas", "json_ld_count")
    plain = ("scan_id", "seq", "img_no_alt_first", "unlabeled_first", "heading_skip_first", "empty_link_first", "hidden_role",
             "has_unsized_img", "has_html_lang", "has_button", "has_viewport", "has_cta_text")
    return extract.page_profiles(X.pages(spark, d)).select(*plain, *[big(c).alias(c) for c in counts])


@query("elements", f"SELECT scan_id, seq, pos, is_close, tag, txt AS text, {C.attr('href')} AS href, {C.attr('name')} AS name FROM tok")
def elements(spark, d):
    tokens = extract.elements(X.pages(spark, d))
    t = F.struct("attrs")
    from pagequarry.functions.markup import attr

    return tokens.select(
        "scan_id", "seq", "pos", "is_close", "tag", "text",
        F.coalesce(attr(t, "href"), F.lit("")).alias("href"), F.coalesce(attr(t, "name"), F.lit("")).alias("name"),
    )


@query("internal_links", "SELECT scan_id, seq, pos, link FROM lnk")
def internal_links(spark, d):
    return extract.links(X.pages(spark, d)).select("scan_id", "seq", "pos", "link")


_RES_TAGS = f"""SELECT scan_id, seq, pos, tag, CASE tag WHEN 'link' THEN 0 WHEN 'script' THEN 1 WHEN 'img' THEN 2 WHEN 'source' THEN 3 WHEN 'video' THEN 4
 WHEN 'audio' THEN 5 ELSE 6 END AS rank, trim(CASE WHEN tag = 'link' THEN {C.attr('href')} ELSE {C.attr('src')} END) AS ref, {C.attr('rel')} AS rel
 FROM tok WHERE NOT is_close AND tag IN ('link', 'script', 'img', 'source', 'video', 'audio', 'iframe')"""
_RES_LISTED = f"""SELECT t.scan_id, t.seq, rank, pos, {C.join('x.final_url', 't.ref')} AS url, tag, rel FROM restags t JOIN px x ON x.scan_id = t.scan_id AND x.seq = t.seq
 WHERE ref <> '' AND ref NOT LIKE 'data:%' AND (tag <> 'link' OR rel IN ('stylesheet', 'preload', 'prefetch', 'modulepreload', 'icon'))"""
_RES_FIRST = """SELECT scan_id, seq, rank, pos, url, CASE WHEN rel = 'icon' THEN 'IMAGE' WHEN tag = 'link' AND (rel = 'stylesheet' OR regexp_matches(url, '(?i)\\.css($|\\?)')) THEN 'CSS'
 WHEN tag IN ('img', 'source') AND regexp_matches(url, '(?i)\\.(woff2?|ttf|otf|eot)($|\\?)') THEN 'FONT' WHEN tag = 'script' THEN 'JS' WHEN tag IN ('img', 'source') THEN 'IMAGE'
 WHEN tag IN ('video', 'audio') THEN 'VIDEO' ELSE 'OTHER' END AS resource_type, row_number() OVER (PARTITION BY scan_id, seq, url ORDER BY rank, pos) AS nth FROM reslisted"""
_RES_ALL = """SELECT scan_id, seq, 0 AS part, rank * 100000 + pos AS place, url, resource_type, false AS is_inline FROM resfirst WHERE nth = 1
 UNION ALL SELECT scan_id, seq, 1, i, url, 'JS', true FROM (SELECT p.scan_id, p.seq, p.url, unnest(range(len(inline_scripts))) AS i FROM prof p)"""
_RES_CTES = dict(restags=_RES_TAGS, reslisted=_RES_LISTED, resfirst=_RES_FIRST, resall=_RES_ALL)


@query("html_resources", f"""SELECT scan_id, seq, row_number() OVER (PARTITION BY scan_id, seq ORDER BY part, place) - 1 AS ord, url, resource_type, is_inline,
 {C.host_of('url')} AS domain, NOT is_inline AND {C.host_of('url')} <> regexp_replace(scan_id, '@2$', '') AS is_external FROM resall""", **_RES_CTES)
def html_resources(spark, d):
    return extract.resources(X.pages(spark, d))


@query("script_urls", f"""SELECT t.scan_id, t.seq, row_number() OVER (PARTITION BY t.scan_id, t.seq ORDER BY pos) - 1 AS pos, {C.join('x.url', 't.ref')} AS script_url
 FROM restags t JOIN px x ON x.scan_id = t.scan_id AND x.seq = t.seq WHERE tag = 'script' AND ref <> ''""", **_RES_CTES)
def script_urls(spark, d):
    return extract.script_urls(X.pages(spark, d))


@query("meta_tags", f"""SELECT scan_id, seq, row_number() OVER (PARTITION BY scan_id, seq ORDER BY pos) - 1 AS pos,
 CASE WHEN {C.attr('name')} <> '' THEN {C.attr('name')} ELSE {C.attr('http-equiv')} END AS name, {C.attr('content')} AS content, {C.attr('property')} AS property
 FROM tok WHERE tag = 'meta' AND NOT is_close""")
def meta_tags(spark, d):
    return extract.meta_tags(X.pages(spark, d))


@query("json_ld_blocks", "SELECT scan_id, seq, i AS pos, j AS block, json_valid(j) AS valid FROM (SELECT scan_id, seq, unnest(json_ld) AS j, unnest(range(len(json_ld))) AS i FROM prof)")
def json_ld_blocks(spark, d):
    rows = X.pages(spark, d).select("scan_id", "seq", F.posexplode(extract.json_ld_blocks(F.col("html"))).alias("pos", "block"))
    return rows.select("scan_id", "seq", big("pos").alias("pos"), "block", extract.json_is_valid(F.col("block")).alias("valid"))


_JSON = """CASE page_id % 8 WHEN 0 THEN '{"a": ' || page_id || ', "a": "' || url || '", "a": {"a": []}}' WHEN 1 THEN '[{"k": "' || url || '", "k": null, "k": -1.5e3}, []]'
 WHEN 2 THEN '{"a": 1, "a": }' WHEN 3 THEN '[' || page_id || ' ' || page_id || ']' WHEN 4 THEN ' {"' || url || '" : true , "b":[1,[2,{}]] } ' WHEN 5 THEN '{"a": "' || url || '}'
 WHEN 6 THEN '{"a": 0' || page_id || '}' ELSE '"' || url || '"' END"""


@query("json_texts", f"SELECT page_id, json_valid({_JSON}) AS valid FROM pages")
def json_texts(spark, d):
    return X.table(spark, d, "pages").select("page_id", extract.json_is_valid(F.expr(_JSON)).alias("valid"))


_SOURCE = "source || '.example.org'"


@query("document_text_helpers", """SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g')) AS normalized,
 CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS truncated, sha256(text) AS sha,
 regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS printable FROM documents""")
def document_text_helpers(spark, d):
    t = F.col("text")
    return X.documents(spark, d).select(
        "doc_id", TX.normalize_whitespace(t).alias("normalized"), TX.truncate(t, 80).alias("truncated"),
        TX.sha256_hex(t).alias("sha"), TX.strip_control(t).alias("printable"),
    )


_RESPONSES = """SELECT DISTINCT url, 200 AS status_code, 'text/plain' AS mime_type, CAST(length(url) AS DOUBLE) / 100 AS load_time,
 CASE WHEN length(url) % 5 = 0 THEN 'chunked' ELSE CAST(length(url) * 1000 AS STRING) END AS content_length FROM {source}"""


@query("probed_resources", """SELECT r.scan_id, r.seq, r.ord, r.url, p.status_code, p.mime_type, p.load_time, TRY_CAST(p.content_length AS BIGINT) AS size_bytes
 FROM res r LEFT JOIN responses p ON p.url = r.url""", responses=_RESPONSES.format(source="res"))
def probed_resources(spark, d):
    found = X.resources(spark, d)
    responses = found.selectExpr(
        "url", "200 AS status_code", "'text/plain' AS mime_type", "CAST(length(url) AS DOUBLE) / 100 AS load_time",
        "CASE WHEN length(url) % 5 = 0 THEN 'chunked' ELSE CAST(length(url) * 1000 AS STRING) END AS content_length",
    ).distinct()
    return extract.with_responses(found, responses).select("scan_id", "seq", "ord", "url", "status_code", "mime_type", "load_time", "size_bytes")


# ---------------------------------------------------------------- URLs and hosts

_VARIANT = """CASE page_id % 8 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN replace(url, 'https://', '') WHEN 2 THEN upper(url)
 WHEN 3 THEN regexp_replace(url, '^(https?://)', '\\1user:pw@') WHEN 4 THEN 'ftp://' || url WHEN 5 THEN url || '/'
 WHEN 6 THEN 'localhost' ELSE '' END"""
_VARIANT_SPARK = _VARIANT.replace("'\\1user", "'$1user")


@query("normalized_urls", f"""SELECT page_id, raw, CASE WHEN error IS NULL THEN regexp_extract(u, '^(https?)://', 1) || '://' || host
 || CASE WHEN port <> '' THEN ':' || port ELSE '' END || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
 || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS normalized, error FROM (
 SELECT *, CASE WHEN u = 'https://' THEN 'empty' WHEN NOT (contains(replace(host, 'localhost', ''), '.') OR host = 'localhost') THEN 'no valid hostname'
 WHEN regexp_matches(netloc, '[^:]+.*@') THEN 'credentials' END AS error FROM (
 SELECT *, lower(regexp_extract(regexp_replace(netloc, '^.*@', ''), '^([^:]*)', 1)) AS host, regexp_extract(regexp_replace(netloc, '^.*@', ''), ':([0-9]+)$', 1) AS port FROM (
 SELECT *, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS netloc, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS query FROM (
 SELECT page_id, raw, CASE WHEN regexp_matches(trim(raw), '^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END AS u FROM (
 SELECT page_id, {_VARIANT} AS raw FROM pages)))))""")
def normalized_urls(spark, d):
    rows = X.table(spark, d, "pages").select("page_id", F.expr(_VARIANT_SPARK.replace("\\", "\\\\")).alias("raw"))
    n = U.normalize_url(F.col("raw"))
    return rows.select("page_id", "raw", n.alias("n")).select("page_id", "raw", "n.normalized", "n.error")


@query("crawl_urls", f"""SELECT page_id, raw, CASE WHEN error IS NULL THEN regexp_extract(raw, '^(https?)://', 1) || '://' || lower(netloc) || CASE WHEN path = '' THEN '/' ELSE path END
 || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical, error FROM (
 SELECT *, CASE WHEN lower(regexp_extract(raw, '^([a-zA-Z]+):', 1)) NOT IN ('http', 'https') THEN 'unsupported scheme' WHEN regexp_replace(netloc, '^.*@', '') = '' THEN 'no hostname'
 WHEN contains(netloc, '@') THEN 'credentials' END AS error FROM (
 SELECT page_id, raw, regexp_extract(raw, '^[a-zA-Z]+://([^/?#]*)', 1) AS netloc, regexp_extract(raw, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
 regexp_extract(raw, '^[^?#]*\\?([^#]*)', 1) AS query FROM (SELECT page_id, CASE WHEN page_id % 8 IN (0, 2) THEN url ELSE {_VARIANT} END AS raw FROM pages)))""")
def crawl_urls(spark, d):
    variant = _VARIANT_SPARK.replace("\\", "\\\\")
    rows = X.table(spark, d, "pages").select("page_id", F.expr(f"CASE WHEN page_id % 8 IN (0, 2) THEN url ELSE {variant} END").alias("raw"))
    return rows.select("page_id", "raw", U.crawl_url(F.col("raw")).alias("c")).select("page_id", "raw", "c.canonical", "c.error")


@query("url_predicates", f"""SELECT page_id, {C.host_of('url')} AS host, {C.host_of('url')} = {C.host_of("'https://www.' || " + C.host_of('url'))} AS same_as_www,
 true AS internal, regexp_replace({C.host_of('url')}, '^www\\.', '') AS bare, page_id % 2 = 0 AS is_html FROM pages""")
def url_predicates(spark, d):
    rows = X.table(spark, d, "pages")
    url = F.col("url")
    host = U.hostname_of(url)
    kind = F.expr("CASE WHEN page_id % 2 = 0 THEN 'Text/HTML; charset=utf-8' ELSE 'image/png' END")
    return rows.select(
        "page_id", host.alias("host"), U.same_site(url, F.concat(F.lit("https://www."), host)).alias("same_as_www"),
        U.is_internal_link(url, F.upper(host)).alias("internal"), U.bare_host(F.concat(F.lit("https://www."), U.bare_host(url), F.lit("/"))).alias("bare"),
        U.is_html_content_type(kind).alias("is_html"),
    )


_HREF = "CASE page_id % 7 WHEN 0 THEN '/x' WHEN 1 THEN 'y.html?q=1' WHEN 2 THEN '../z#f' WHEN 3 THEN '//cdn.example.net/a' WHEN 4 THEN 'https://other.example.org/' WHEN 5 THEN '?p=2' ELSE '' END"


@query("joined_urls", f"""SELECT page_id, href, CASE WHEN href = '' THEN url WHEN href LIKE '?%' THEN regexp_extract(url, '^([^?#]*)', 1) || href ELSE {C.join('url', 'href')} END AS joined
 FROM (SELECT page_id, url, {_HREF} AS href FROM pages)""")
def joined_urls(spark, d):
    rows = X.table(spark, d, "pages").select("page_id", "url", F.expr(_HREF).alias("href"))
    return rows.select("page_id", "href", U.join_url(F.col("url"), F.col("href")).alias("joined"))


_SUFFIXES = ("com", "net", "org", "co.uk", "uk", "*.ck", "!www.ck")


def suffix_table(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(array(" + ", ".join(f"'{s}'" for s in _SUFFIXES) + ")) AS suffix")


_HOST_VARIANT = f"CASE page_id % 6 WHEN 0 THEN {{h}} WHEN 1 THEN 'a.' || {{h}} || '.co.uk' WHEN 2 THEN 'printer.local' WHEN 3 THEN 'intranet' WHEN 4 THEN 'api.corp.com' ELSE 'localhost' END"


@query("registrable_domains", f"""SELECT DISTINCT host, CASE WHEN regexp_matches(host, '\\.co\\.uk$') THEN regexp_extract(host, '([^.]+\\.co\\.uk)$', 1)
 WHEN regexp_matches(host, '\\.(com|net|org)$') THEN regexp_extract(host, '([^.]+\\.(?:com|net|org))$', 1) ELSE host END AS domain
 FROM (SELECT {_HOST_VARIANT.format(h=X.HOST)} AS host FROM pages)""")
def registrable_domains(spark, d):
    rows = X.table(spark, d, "pages").select(F.expr(_HOST_VARIANT.format(h=X.HOST)).alias("host"))
    return hosts.registrable_domains(rows, suffix_table(spark)).select("host", "domain")


@query("target_policy", f"""SELECT page_id, url, allowed, CASE WHEN allowed THEN NULL ELSE reason END AS reason FROM (SELECT *, reason IS NULL AS allowed FROM (
 SELECT page_id, url, CASE WHEN url LIKE 'ftp:%' THEN 'scheme' WHEN host = 'localhost' THEN 'blocked name' WHEN NOT contains(host, '.') THEN 'single label'
 WHEN host LIKE '%.local' THEN 'private suffix' WHEN host = 'api.corp.com' THEN 'private name' END AS reason FROM (
 SELECT page_id, CASE WHEN page_id % 12 = 0 THEN 'ftp://' ELSE 'https://' END || host || '/' AS url, host FROM (SELECT page_id, {_HOST_VARIANT.format(h=X.HOST)} AS host FROM pages))))""")
def target_policy(spark, d):
    rows = X.table(spark, d, "pages").select("page_id", F.expr(_HOST_VARIANT.format(h=X.HOST)).alias("h"))
    urls = rows.select("page_id", F.expr("CASE WHEN page_id % 12 = 0 THEN 'ftp://' ELSE 'https://' END || h || '/'").alias("url"))
    return hosts.target_policy(urls, suffix_table(spark)).select("page_id", "url", "allowed", "reason")


_IP = """CASE page_id % 9 WHEN 0 THEN '10.' WHEN 1 THEN '93.' WHEN 2 THEN '127.' WHEN 3 THEN '172.' WHEN 4 THEN '8.' WHEN 5 THEN '224.' WHEN 6 THEN '1.' WHEN 7 THEN '169.' ELSE '45.' END
 || CAST(CASE page_id % 9 WHEN 3 THEN page_id % 40 WHEN 7 THEN 250 + page_id % 6 ELSE page_id % 256 END AS STRING) || '.' || CAST(page_id * 7 % 256 AS STRING) || '.' || CAST(page_id * 13 % 256 AS STRING)"""


@query("address_policy", f"""SELECT host, count(*) AS addresses, bool_and(NOT (a IN (10, 127, 224) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254))) AS allowed
 FROM (SELECT host, CAST(string_split(ip, '.')[1] AS INT) AS a, CAST(string_split(ip, '.')[2] AS INT) AS b FROM (SELECT {X.HOST} AS host, {_IP} AS ip FROM pages)) GROUP BY host""")
def address_policy(spark, d):
    resolved = X.table(spark, d, "pages").select(F.expr(X.HOST).alias("host"), F.expr(_IP).alias("ip"))
    return hosts.address_policy(resolved.select("host").distinct(), resolved)


_IP6 = "CASE page_id % 6 WHEN 0 THEN '2606:4700::' WHEN 1 THEN 'fe80::' WHEN 2 THEN 'fd00::' WHEN 3 THEN '2a00:1450::' WHEN 4 THEN 'ff02::' ELSE '2001:db8::' END || {n}"


@query("address_policy_ipv6", f"""SELECT host, count(*) AS addresses, bool_and(regexp_matches(ip, '^(2606:4700|2a00:1450)')) AS allowed
 FROM (SELECT 'h' || CAST(page_id AS STRING) AS host, {_IP6.format(n="CAST(page_id % 9999 AS STRING)")} AS ip FROM pages) GROUP BY host""")
def address_policy_ipv6(spark, d):
    resolved = X.table(spark, d, "pages").select(
        F.expr("'h' || CAST(page_id AS STRING)").alias("host"), F.expr(_IP6.format(n="CAST(page_id % 9999 AS STRING)")).alias("ip"))
    return hosts.address_policy(resolved.select("host").distinct(), resolved)


_BODY = """'# rules' || chr(10) || 'Disallow: /early' || chr(10) || 'User-agent: otherbot' || chr(10) || 'Disallow: /' || chr(10) || 'User-Agent: auditbot,foo' || chr(10)
 || 'Disallow: /fr' || chr(10) || 'Allow: /fr/' || CAST(first_page % 9 AS STRING) || chr(10) || 'Crawl-delay: ' || CASE WHEN first_page % 2 = 0 THEN '2.5' ELSE 'soon' END || chr(10)
 || 'Sitemap: /map.xml' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /en/1' || chr(10) || 'Disallow:' || chr(10) || 'Crawl-delay: 9'"""


def _bodies(spark, d):
    sites = X.table(spark, d, "pages").groupBy(F.expr(X.HOST).alias("host")).agg(F.min("page_id").alias("first_page"))
    return sites.select("host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("base_url"), F.expr(_BODY).alias("body"))


_ROBOT_CTES = dict(
    robotsites=f"SELECT {X.HOST} AS host, min(page_id) AS first_page FROM pages GROUP BY 1",
    robotrules="""SELECT host, CAST(r.pos AS BIGINT) AS pos, r.kind, r.value FROM (SELECT host, first_page, unnest([
 {'pos': 5, 'kind': 'disallow', 'value': '/fr'}, {'pos': 6, 'kind': 'allow', 'value': '/fr/' || first_page % 9},
 {'pos': 7, 'kind': 'crawl-delay', 'value': CASE WHEN first_page % 2 = 0 THEN '2.5' END}, {'pos': 8, 'kind': 'sitemap', 'value': 'https://' || host || '/map.xml'},
 {'pos': 10, 'kind': 'disallow', 'value': '/en/1'}]) AS r FROM robotsites) WHERE r.value IS NOT NULL""",
)


@query("robots_rules", "SELECT host, pos, kind, value FROM robotrules", **_ROBOT_CTES)
def robots_rules(spark, d):
    return robots.robots_rules(_bodies(spark, d), "auditbot")


@query("robots_can_fetch", f"""SELECT page_id, path, EXISTS (SELECT 1 FROM robotrules r WHERE r.host = p.host AND kind = 'allow' AND starts_with(path, value))
 OR NOT EXISTS (SELECT 1 FROM robotrules r WHERE r.host = p.host AND kind = 'disallow' AND starts_with(path, value)) AS allowed
 FROM (SELECT page_id, {X.HOST} AS host, regexp_replace(CASE WHEN {X.PATH} = '' THEN '/' ELSE {X.PATH} END, '/+', '/', 'g') AS path FROM pages) p""", **_ROBOT_CTES)
def robots_can_fetch(spark, d):
    rules = robots.robots_rules(_bodies(spark, d), "auditbot")
    return robots.can_fetch(X.table(spark, d, "pages").select("page_id", "url"), rules).select("page_id", "path", "allowed")


# ---------------------------------------------------------------- rules

_CATEGORY_QUERIES = {
    "findings_accessibility": "ACCESSIBILITY", "findings_architecture": "ARCHITECTURE", "findings_content": "CONTENT",
    "findings_performance": "PERFORMANCE", "findings_privacy": "PRIVACY", "findings_security": "SECURITY",
    "findings_seo": "SEO", "findings_ux": "UX",
}
for _name, _category in _CATEGORY_QUERIES.items():
    def _by_category(spark, d, category=_category):
        return flat(audited(spark, d).findings.where(F.col("category") == category))

    query(_name, f"SELECT {FLAT} FROM fnd WHERE category = '{_category}'")(_by_category)


@query("findings_from_html", f"SELECT {FLAT} FROM fnd_html", fnd_html=C.PARTS["fnd"].replace(" UNION ALL SELECT * FROM draft_res", ""))
def findings_from_html(spark, d):
    """All page rules straight from html, without stage tables."""
    from pagequarry.plans.registry import FAMILIES, AuditInputs, all_findings

    profiles = materialize(extract.page_profiles(X.pages(spark, d)), "profiles")
    facts = page_rules.page_facts(profiles)
    wanted = {n: f for n, f in FAMILIES.items() if n not in ("resources", "large files")}
    return flat(all_findings(AuditInputs(profiles, facts, facts), wanted))


@query("performance_metrics", """SELECT b.scan_id, coalesce(total, 0) AS total_resource_bytes, coalesce(js, 0) AS js_bytes, coalesce(css, 0) AS css_bytes, coalesce(img, 0) AS image_bytes,
 CAST(0 AS BIGINT) AS font_bytes, coalesce(total - js - css - img, 0) AS other_bytes, coalesce(n, 0) AS request_count, coalesce(e, 0) AS third_party_request_count, b.pages AS page_count,
 round(avg_load, 3) AS avg_page_load_seconds, redirects AS redirect_count FROM base b LEFT JOIN (
 SELECT scan_id, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total, CAST(coalesce(sum(size_bytes) FILTER (resource_type = 'JS'), 0) AS BIGINT) AS js,
 CAST(coalesce(sum(size_bytes) FILTER (resource_type = 'CSS'), 0) AS BIGINT) AS css, CAST(coalesce(sum(size_bytes) FILTER (resource_type = 'IMAGE'), 0) AS BIGINT) AS img,
 count(*) AS n, count(*) FILTER (is_external) AS e FROM res GROUP BY scan_id) r ON r.scan_id = b.scan_id
 JOIN (SELECT scan_id, avg(load_time) AS avg_load, count(*) FILTER (url <> final_url AND status_code IN (301, 302, 307, 308)) AS redirects FROM px GROUP BY scan_id) l ON l.scan_id = b.scan_id""")
def performance_metrics(spark, d):
    a = audited(spark, d)
    per_scan = resource_rules.resource_facts(resource_rules.domain_facts(a.resources))
    out = resource_rules.performance_metrics(a.facts, per_scan)
    return out.drop("lcp_seconds", "cls_score", "inp_milliseconds", "core_web_vitals_measured")


@query("site_metrics", """SELECT scan_id, CAST(sum(word_count) AS BIGINT) AS total_words, count(*) FILTER (word_count > 0) AS pages_with_content,
 count(*) FILTER (title <> '') AS pages_with_titles, CAST(sum(link_count) AS BIGINT) AS total_internal_links, arg_min(page_id % 4, seq) AS cookie_count FROM prof GROUP BY scan_id""")
def site_metrics(spark, d):
    return resource_rules.site_metrics(audited(spark, d).facts)


@query("external_domains", "SELECT scan_id, domain, count(*) AS resource_count FROM res WHERE is_external AND domain <> '' GROUP BY scan_id, domain")
def external_domains(spark, d):
    return resource_rules.external_domains(resource_rules.domain_facts(X.resources(spark, d))).select("scan_id", "domain", "resource_count")


# ---------------------------------------------------------------- duplicates and similarity

_DOCS = dict(
    docs="SELECT doc_id, source, text FROM documents",
    docwords="SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS w FROM docs",
    docsh="SELECT source, doc_id, len(w) - 5 AS size, s AS shingle, count(*) AS n FROM (SELECT *, unnest(list_transform(range(1, len(w) - 4), lambda k: array_to_string(w[k:k + 5], ' '))) AS s FROM docwords WHERE len(w) >= 20) GROUP BY ALL",
    docprint="SELECT source, doc_id, md5(string_agg(shingle || ':' || n, '|' ORDER BY shingle)) AS f FROM docsh GROUP BY source, doc_id",
    docrep="SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, f) AS representative, count(*) OVER (PARTITION BY source, f) AS copies FROM docprint",
)


@query("shingles", "SELECT source, doc_id, shingle, n FROM docsh", **_DOCS)
def shingles(spark, d):
    return duplicates.shingle_counts(X.documents(spark, d), "source", "doc_id", "text")


@query("copy_groups", "SELECT source, doc_id, representative, copies FROM docrep", **_DOCS)
def copy_groups(spark, d):
    return duplicates.copy_groups(X.documents(spark, d), "source", "doc_id", "text")


@query("similar_pairs", """SELECT p.source, a, b, ra.copies AS copies_a, rb.copies AS copies_b, round(score, 9) AS score FROM (
 SELECT x.source, x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) / (x.size + y.size - sum(least(x.n, y.n))) AS score
 FROM docsh x JOIN docsh y ON x.source = y.source AND x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.source, x.doc_id, y.doc_id, x.size, y.size) p
 JOIN docrep ra ON ra.doc_id = a AND ra.representative = a JOIN docrep rb ON rb.doc_id = b AND rb.representative = b WHERE score >= 0.55""", **_DOCS)
def similar_pairs(spark, d):
    return duplicates.similar_pairs(X.documents(spark, d), "source", "doc_id", "text").withColumn("score", F.round("score", 9))


@query("similar_clusters", """SELECT c.source, c.doc_id, c.cluster, r.representative, round(CASE WHEN r.representative = c.cluster THEN 1.0 ELSE coalesce(p.score, 0) END, 9) AS score,
 r.representative = c.cluster OR coalesce(p.score, 0) >= 0.55 AS similar FROM docroot c JOIN docrep r ON r.doc_id = c.doc_id
 LEFT JOIN docpair p ON p.source = c.source AND p.a = c.cluster AND p.b = r.representative""",
       docpair="""SELECT x.source, x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) / (x.size + y.size - sum(least(x.n, y.n))) AS score
 FROM docsh x JOIN docsh y ON x.source = y.source AND x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.source, x.doc_id, y.doc_id, x.size, y.size""",
       docreach="""SELECT source, a AS doc_id, a AS other FROM docpair WHERE score >= 0.55 UNION SELECT r.source, r.doc_id, p.b FROM docreach r JOIN docpair p ON p.source = r.source AND p.a = r.other WHERE p.score >= 0.55""",
       docroot="SELECT source, doc_id, min(other) AS cluster FROM docreach GROUP BY source, doc_id", **_DOCS)
def similar_clusters(spark, d):
    return duplicates.similar_clusters(X.documents(spark, d), "source", "doc_id", "text").withColumn("score", F.round("score", 9))


def _doc_profiles(spark, d):
    return X.documents(spark, d).select(
        F.col("source").alias("scan_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("/d/"), "doc_id").alias("url"), "text",
        F.sha2(F.substring("text", 1, extract.OPENING_CHARS), 256).alias("opening_sha"), F.substring("text", 1, 20).alias("title"),
    )


@query("first_comparisons", """SELECT source AS scan_id, seq_a, seq_b, '/d/' || seq_a AS url_a, '/d/' || seq_b AS url_b, round(score, 9) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS r FROM (
 SELECT x.source, x.i * x.many - x.i * (x.i + 1) // 2 + (y.i - x.i) AS place, x.doc_id AS seq_a, y.doc_id AS seq_b, sum(least(x.n, y.n)) / (x.size + y.size - sum(least(x.n, y.n))) AS score
 FROM docnum x JOIN docnum y ON x.source = y.source AND x.shingle = y.shingle AND x.i < y.i GROUP BY x.source, x.i, y.i, x.many, x.doc_id, y.doc_id, x.size, y.size)
 WHERE place <= 60 AND score >= 0.55) WHERE r <= 5""",
       docnum="SELECT s.*, o.i, o.many FROM docsh s JOIN (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS many FROM docs WHERE text <> '') o ON o.doc_id = s.doc_id", **_DOCS)
def first_comparisons(spark, d):
    return duplicates.first_comparisons(_doc_profiles(spark, d)).withColumn("score", F.round("score", 9))


@query("duplicate_titles", """SELECT source AS scan_id, count(*) AS duplicates, '/d/' || min(doc_id) AS url, arg_min(title, doc_id) AS title FROM (
 SELECT source, doc_id, substr(text, 1, 20) AS title, row_number() OVER (PARTITION BY source, lower(trim(substr(text, 1, 20))) ORDER BY doc_id) AS r FROM documents WHERE trim(substr(text, 1, 20)) <> '')
 WHERE r > 1 GROUP BY source""")
def duplicate_titles(spark, d):
    return duplicates.duplicate_titles(_doc_profiles(spark, d))


@query("repeated_openings", """SELECT source AS scan_id, count(*) AS copies, '/d/' || min(doc_id) AS url, min(doc_id) AS seq
 FROM documents GROUP BY source, sha256(substr(text, 1, 400)) HAVING count(*) >= 2""")
def repeated_openings(spark, d):
    return duplicates.repeated_openings(_doc_profiles(spark, d))


@query("document_exposure", """SELECT scan_id, kind, shown FROM (
 SELECT source AS scan_id, 'SEC_OBSERVABLE_API' AS kind, string_agg(v, ', ' ORDER BY v) AS shown FROM (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY v) AS r FROM (SELECT DISTINCT source, unnest(regexp_extract_all(text, '/api/v?\\d?/?')) AS v FROM documents)) WHERE r <= 5 GROUP BY source
 UNION ALL SELECT source, 'SEC_PUBLIC_EMAIL', string_agg(v, ', ' ORDER BY v) FROM (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY v) AS r FROM (SELECT DISTINCT source, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS v FROM documents)) WHERE r <= 5 GROUP BY source
 UNION ALL SELECT source, 'SEC_EXPOSED_SECRET_PATTERN', '[' || string_agg('''' || v || '''', ', ' ORDER BY r) || ']' FROM (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS r FROM (
 SELECT source, doc_id, unnest(m) AS v, unnest(range(len(m))) AS i FROM (SELECT source, doc_id, regexp_extract_all(text, '(?i)(api[_-]?key|secret|token|password)\\s*[=:]\\s*[''"][A-Za-z0-9_\\-]{12,}[''"]', 1) AS m FROM documents))) WHERE r <= 3 GROUP BY source)""")
def document_exposure(spark, d):
    t = F.col("text")
    docs = X.documents(spark, d).select(
        F.col("source").alias("scan_id"), F.col("doc_id").alias("seq"),
        extract.api_paths(t).alias("api_paths"), extract.emails(t).alias("emails"), extract.secret_keywords(t).alias("secret_keywords"),
    )
    facts = docs.groupBy("scan_id").agg(F.lit("x").alias("base_url"))
    found = flat(page_rules.exposure(docs, facts))
    return found.select("scan_id", F.col("rule_id").alias("kind"), F.col("evidence_value").alias("shown"))


# ---------------------------------------------------------------- technologies and graph

_TECH = {
    "techhtml": """SELECT scan_id, max(CASE WHEN html LIKE '%/wp-content/%' OR html LIKE '%/wp-includes/%' OR html LIKE '%wp-emoji%' THEN 1 ELSE 0 END) AS wp1,
 max(CASE WHEN html LIKE '%id="wpcontent"%' OR html LIKE '%class="wp-embed%' THEN 1 ELSE 0 END) AS wp2, max(CASE WHEN contains(html, '__NEXT_DATA__') OR contains(html, '/_next/') THEN 1 ELSE 0 END) AS nextjs,
 max(CASE WHEN contains(html, '__NUXT__') OR contains(html, '_nuxt') THEN 1 ELSE 0 END) AS nuxt, max(CASE WHEN contains(html, 'data-reactroot') OR contains(html, 'id="root"') THEN 1 ELSE 0 END) AS react,
 max(CASE WHEN contains(html, '__VUE__') OR contains(html, 'data-v-') THEN 1 ELSE 0 END) AS vue, max(CASE WHEN contains(lower(html), 'bootstrap') THEN 1 ELSE 0 END) AS boot,
 max(CASE WHEN contains(html, 'class="flex items-center') OR contains(html, 'class="grid grid-cols') THEN 1 ELSE 0 END) AS tail, max(CASE WHEN contains(html, 'ng-app') OR contains(html, 'ng-version') THEN 1 ELSE 0 END) AS ng,
 max(CASE WHEN contains(html, 'google-analytics') THEN 1 ELSE 0 END) AS ga, max(CASE WHEN contains(html, '/cdn/shop/') OR contains(lower(html), 'shopify') THEN 1 ELSE 0 END) AS shop,
 max(CASE WHEN contains(html, 'ghost-search') OR contains(html, 'content="Ghost"') THEN 1 ELSE 0 END) AS ghost FROM px GROUP BY scan_id""",
    "techcookie": """SELECT c.scan_id, max(CASE WHEN name LIKE 'wp-%' THEN 1 ELSE 0 END) AS wp, max(CASE WHEN name LIKE '\\_ga%' ESCAPE '\\' THEN 1 ELSE 0 END) AS ga,
 max(CASE WHEN name LIKE 'phpsessid%' THEN 1 ELSE 0 END) AS php, max(CASE WHEN name LIKE 'csrftoken%' THEN 1 ELSE 0 END) AS csrf FROM cookies c
 JOIN home h ON h.scan_id = c.scan_id WHERE h.page_id % 4 = 0 OR c.seq = h.seq GROUP BY c.scan_id""",
    "techhead": """SELECT h.scan_id, lower(coalesce(h.server, l.server, '')) AS server, lower(coalesce(h."x-powered-by", l.powered, '')) AS powered FROM home h
 JOIN (SELECT scan_id, arg_max(server, seq) FILTER (server IS NOT NULL) AS server, arg_max("x-powered-by", seq) FILTER ("x-powered-by" IS NOT NULL) AS powered FROM px GROUP BY scan_id) l ON l.scan_id = h.scan_id""",
    "techres": """SELECT scan_id, max(CASE WHEN resource_type = 'JS' AND contains(lower(url), 'react') THEN 1 ELSE 0 END) AS react, max(CASE WHEN resource_type = 'JS' AND contains(lower(url), 'jquery') THEN 1 ELSE 0 END) AS jquery,
 max(CASE WHEN resource_type = 'JS' AND contains(lower(url), 'bootstrap') THEN 1 ELSE 0 END) AS boot, max(CASE WHEN resource_type = 'JS' AND contains(lower(url), 'tailwind') THEN 1 ELSE 0 END) AS tail,
 max(CASE WHEN resource_type = 'JS' AND contains(lower(url), 'angular') THEN 1 ELSE 0 END) AS ng, max(CASE WHEN resource_type = 'JS' AND (contains(url, 'gtag/js') OR contains(url, 'googletagmanager')) THEN 1 ELSE 0 END) AS gtag,
 max(CASE WHEN contains(url, 'fonts.googleapis.com') OR contains(url, 'fonts.gstatic.com') THEN 1 ELSE 0 END) AS fonts FROM res GROUP BY scan_id""",
    "techsig": """SELECT b.scan_id, unnest([
 {'n': 'WordPress', 'c': 'CMS', 'p': 0.85, 'e': CASE WHEN wp1 = 1 THEN 'wp-content or wp-includes references' WHEN k.wp = 1 THEN 'wp-* cookie' WHEN wp2 = 1 THEN 'wordpress markup' END},
 {'n': 'Next.js', 'c': 'Frontend Framework', 'p': 0.91, 'e': CASE WHEN nextjs = 1 THEN 'next.js markers' END},
 {'n': 'Nuxt.js', 'c': 'Frontend Framework', 'p': 0.9, 'e': CASE WHEN nuxt = 1 THEN 'nuxt markers' END},
 {'n': 'React', 'c': 'Frontend Framework', 'p': 0.7, 'e': CASE WHEN h.react = 1 THEN 'react root markup' WHEN r.react = 1 THEN 'react script' END},
 {'n': 'Vue.js', 'c': 'Frontend Framework', 'p': 0.7, 'e': CASE WHEN vue = 1 THEN 'vue markers' END},
 {'n': 'jQuery', 'c': 'JavaScript Library', 'p': 0.9, 'e': CASE WHEN jquery = 1 THEN 'jquery script' END},
 {'n': 'Bootstrap', 'c': 'CSS Framework', 'p': 0.8, 'e': CASE WHEN r.boot = 1 THEN 'bootstrap script' WHEN h.boot = 1 THEN 'bootstrap markup' END},
 {'n': 'Tailwind CSS', 'c': 'CSS Framework', 'p': 0.65, 'e': CASE WHEN r.tail = 1 THEN 'tailwind script' WHEN h.tail = 1 THEN 'tailwind-style classes' END},
 {'n': 'Angular', 'c': 'Frontend Framework', 'p': 0.75, 'e': CASE WHEN h.ng = 1 THEN 'angular markers' WHEN r.ng = 1 THEN 'angular script' END},
 {'n': 'Google Analytics', 'c': 'Analytics', 'p': 0.85, 'e': CASE WHEN gtag = 1 THEN 'gtag script' WHEN h.ga = 1 THEN 'analytics reference' WHEN k.ga = 1 THEN 'ga cookie' END},
 {'n': 'Cloudflare', 'c': 'CDN / Proxy', 'p': 0.95, 'e': CASE WHEN contains(server, 'cloudflare') THEN 'cloudflare server header' END},
 {'n': 'Nginx', 'c': 'Web Server', 'p': 1.0, 'e': CASE WHEN contains(server, 'nginx') THEN 'nginx server header' END},
 {'n': 'Apache HTTP Server', 'c': 'Web Server', 'p': 1.0, 'e': CASE WHEN contains(server, 'apache') THEN 'apache server header' END},
 {'n': 'PHP', 'c': 'Backend Language', 'p': 0.85, 'e': CASE WHEN php = 1 THEN 'php session cookie' WHEN contains(powered, 'php') THEN 'x-powered-by header' END},
 {'n': 'Django', 'c': 'Backend Framework', 'p': 0.8, 'e': CASE WHEN csrf = 1 THEN 'django csrf cookie' WHEN contains(server, 'django') THEN 'server header' END},
 {'n': 'Flask', 'c': 'Backend Framework', 'p': 0.85, 'e': CASE WHEN contains(server, 'werkzeug') THEN 'werkzeug server header' END},
 {'n': 'Express', 'c': 'Backend Framework', 'p': 0.8, 'e': CASE WHEN contains(powered, 'express') THEN 'x-powered-by header' END},
 {'n': 'Shopify', 'c': 'E-commerce Platform', 'p': 0.8, 'e': CASE WHEN shop = 1 THEN 'shopify markup' END},
 {'n': 'Ghost', 'c': 'CMS', 'p': 0.8, 'e': CASE WHEN contains(server, 'ghost') THEN 'ghost server header' WHEN ghost = 1 THEN 'ghost markup' END},
 {'n': 'Google Fonts', 'c': 'Resource CDN', 'p': 0.9, 'e': CASE WHEN fonts = 1 THEN 'google fonts resource' END}]) AS t
 FROM base b JOIN techhtml h ON h.scan_id = b.scan_id JOIN techhead q ON q.scan_id = b.scan_id LEFT JOIN techcookie k ON k.scan_id = b.scan_id LEFT JOIN techres r ON r.scan_id = b.scan_id""",
    "tech": "SELECT scan_id, t.n AS name, t.c AS category, CAST(t.p AS DOUBLE) AS confidence, t.e AS evidence FROM techsig WHERE t.e IS NOT NULL",
}


@query("technologies", "SELECT scan_id, name, category, confidence, evidence FROM tech", **_TECH)
def technologies(spark, d):
    return technology.technologies(X.pages(spark, d), X.resources(spark, d))


_GRAPH = _TECH | {
    "nodes": f"""SELECT scan_id, 'DOMAIN' AS node_type, {C.host_of('base_url')} AS name, 'Site domain' AS label FROM base
 UNION ALL SELECT scan_id, 'PAGE', url, arg_max(CASE WHEN title <> '' THEN title ELSE url END, seq) FROM prof GROUP BY scan_id, url
 UNION ALL SELECT scan_id, 'TECHNOLOGY', name, category || ' · ' || CAST(round(confidence * 100) AS INT) || '%' FROM tech
 UNION ALL SELECT scan_id, 'THIRD_PARTY', domain, domain FROM (SELECT DISTINCT scan_id, domain FROM res) WHERE domain <> scan_id
 UNION ALL SELECT scan_id, 'RESOURCE', url, arg_max(resource_type, seq * 100 + ord) || ': ' || url FROM res GROUP BY scan_id, url""",
    "edges": f"""SELECT DISTINCT b.scan_id, 'DOMAIN' AS source_type, {C.host_of('base_url')} AS source, 'PAGE' AS target_type, url AS target, 'HOSTS' AS relationship FROM px p JOIN base b ON b.scan_id = p.scan_id
 UNION SELECT r.scan_id, 'PAGE', p.url, 'RESOURCE', r.url, 'REFERENCES' FROM res r JOIN px p ON p.scan_id = r.scan_id AND p.seq = r.seq
 UNION SELECT r.scan_id, 'RESOURCE', r.url, 'THIRD_PARTY', r.domain, 'LOADED_FROM' FROM res r JOIN nodes n ON n.scan_id = r.scan_id AND n.node_type = 'THIRD_PARTY' AND n.name = r.domain WHERE is_external""",
}


@query("graph_nodes", "SELECT scan_id, node_type, name, label FROM nodes", **_GRAPH)
def graph_nodes(spark, d):
    return audited(spark, d).nodes().drop("metadata")


@query("graph_node_facts", """SELECT scan_id, node_type, name, status_code, depth, category, confidence, resource_count, resource_type, size_bytes FROM (
 SELECT scan_id, node_type, name, NULL AS status_code, NULL AS depth, NULL AS category, NULL AS confidence, NULL AS resource_count, NULL AS resource_type, NULL AS size_bytes FROM nodes WHERE node_type = 'DOMAIN'
 UNION ALL SELECT scan_id, 'PAGE', url, CAST(arg_max(status_code, seq) AS BIGINT), CAST(arg_max(depth, seq) AS BIGINT), NULL, NULL, NULL, NULL, NULL FROM px GROUP BY scan_id, url
 UNION ALL SELECT scan_id, 'TECHNOLOGY', name, NULL, NULL, category, CAST(confidence AS DOUBLE), NULL, NULL, NULL FROM tech
 UNION ALL SELECT scan_id, 'THIRD_PARTY', domain, NULL, NULL, NULL, NULL, count(*), NULL, NULL FROM res WHERE domain <> scan_id GROUP BY scan_id, domain
 UNION ALL SELECT scan_id, 'RESOURCE', url, NULL, NULL, NULL, NULL, NULL, arg_max(resource_type, seq * 100 + ord), CAST(arg_max(size_bytes, seq * 100 + ord) AS BIGINT) FROM res GROUP BY scan_id, url)""", **_GRAPH)
def graph_node_facts(spark, d):
    fact = lambda name, kind="bigint": F.try_element_at("metadata", F.lit(name)).cast(kind).alias(name)
    return audited(spark, d).nodes().select(
        "scan_id", "node_type", "name", fact("status_code"), fact("depth"), fact("category", "string"), fact("confidence", "double"),
        fact("resource_count"), fact("resource_type", "string"), fact("size_bytes"))


@query("graph_edges", "SELECT scan_id, source_type, source, target_type, target, relationship FROM edges", **_GRAPH)
def graph_edges(spark, d):
    return audited(spark, d).edges()


_LAYER = "CASE node_type WHEN 'DOMAIN' THEN 0 WHEN 'PAGE' THEN 1 WHEN 'TECHNOLOGY' THEN 0 WHEN 'RESOURCE' THEN 2 ELSE CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.scan_id = n.scan_id AND e.target_type = 'THIRD_PARTY' AND e.target = n.name) THEN 3 ELSE 0 END END"


@query("graph_layers", f"""SELECT scan_id, node_id, layer, row_number() OVER (PARTITION BY scan_id, layer ORDER BY node_id) - 1 AS index FROM (
 SELECT scan_id, node_type || '|' || name AS node_id, CAST({_LAYER} AS BIGINT) AS layer FROM nodes n)""", **_GRAPH)
def graph_layers(spark, d):
    a = audited(spark, d)
    nodes = a.nodes().select("scan_id", F.concat_ws("|", "node_type", "name").alias("node_id"))
    edges = materialize(a.edges().select(
        "scan_id", F.concat_ws("|", "source_type", "source").alias("source"), F.concat_ws("|", "target_type", "target").alias("target")
    ), "edges")
    return graph.index_in_layer(graph.layers(nodes, edges))


# Pages of a host: page k links to 2k+1 and 2k+2, every fourth page back to its grandparent, and page 5 and 6 to one another.
_LINKED = """SELECT a.scan_id, a.url AS source, b.url AS target FROM tree a JOIN tree b ON a.scan_id = b.scan_id
 AND (b.k = 2 * a.k + 1 OR b.k = 2 * a.k + 2 OR (a.k % 4 = 3 AND b.k = ((a.k - 1) // 2 - 1) // 2) OR (a.k = 5 AND b.k = 6) OR (a.k = 6 AND b.k = 5))"""


@query("cyclic_layers", """SELECT c.scan_id, c.source AS node_id, c.component, coalesce(max(p.steps), 0) AS layer FROM comp c
 LEFT JOIN longest p ON p.scan_id = c.scan_id AND p.component = c.component GROUP BY ALL""",
       tree=f"SELECT {X.HOST} AS scan_id, url, row_number() OVER (PARTITION BY {X.HOST} ORDER BY page_id) - 1 AS k FROM pages",
       lnks=_LINKED,
       rch="SELECT scan_id, url AS source, url AS target FROM tree UNION SELECT r.scan_id, r.source, l.target FROM rch r JOIN lnks l ON l.scan_id = r.scan_id AND l.source = r.target",
       comp="SELECT x.scan_id, x.source, min(x.target) AS component FROM rch x JOIN rch y ON x.scan_id = y.scan_id AND x.source = y.target AND x.target = y.source GROUP BY x.scan_id, x.source",
       cond="SELECT DISTINCT l.scan_id, a.component AS a, b.component AS b FROM lnks l JOIN comp a ON a.scan_id = l.scan_id AND a.source = l.source JOIN comp b ON b.scan_id = l.scan_id AND b.source = l.target WHERE a.component <> b.component",
       longest="SELECT scan_id, b AS component, 1::BIGINT AS steps FROM cond UNION SELECT p.scan_id, c.b, p.steps + 1 FROM longest p JOIN cond c ON c.scan_id = p.scan_id AND c.a = p.component")
def cyclic_layers(spark, d):
    """Layers and strong components of page links with cycles."""
    tree = materialize(X.table(spark, d, "pages").select(F.expr(X.HOST).alias("scan_id"), "url", "page_id").withColumn(
        "k", F.row_number().over(Window.partitionBy("scan_id").orderBy("page_id")) - 1), "tree")
    k = F.col("k")
    grandparent = F.floor((F.floor((k - 1) / 2) - 1) / 2)
    out = F.array(2 * k + 1, 2 * k + 2, F.when(k % 4 == 3, grandparent), F.when(k == 5, 6), F.when(k == 6, 5)).cast("array<bigint>")
    links = tree.select("scan_id", F.col("url").alias("source"), F.explode(out).alias("to")).join(
        tree.select("scan_id", F.col("url").alias("target"), k.cast("bigint").alias("to")), ["scan_id", "to"])
    return graph.layers(tree.select("scan_id", F.col("url").alias("node_id")), links).select("scan_id", "node_id", "component", "layer")


# Pages of a host linked as a tree in order of page_id: page k links to 2k+1 and 2k+2.
_TREE = f"SELECT {X.HOST} AS scan_id, url, page_id, row_number() OVER (PARTITION BY {X.HOST} ORDER BY page_id) - 1 AS k FROM pages"


@query("reachable_pages", """SELECT scan_id, url, CAST(floor(log2(k + 1)) AS INT) AS depth FROM tree WHERE floor(log2(k + 1)) <= 3 AND k NOT IN (4)
 AND NOT (k IN (9, 10))""", tree=_TREE)
def reachable_pages(spark, d):
    """Breadth-first reach over links derived from the pages; the fifth page of each host is refused."""
    rows = X.table(spark, d, "pages").select(F.expr(X.HOST).alias("scan_id"), "url", "page_id")
    tree = materialize(rows.withColumn("k", F.row_number().over(Window.partitionBy("scan_id").orderBy("page_id")) - 1), "tree")
    child = tree.select("scan_id", F.col("url").alias("to_url"), F.floor((F.col("k") - 1) / 2).alias("parent"), F.pmod(F.col("k") - 1, F.lit(2)).alias("pos"))
    links = child.join(tree.select("scan_id", F.col("url").alias("from_url"), F.col("k").alias("parent")), ["scan_id", "parent"])
    starts = tree.where("k = 0").select("scan_id", "url")
    refused = tree.where("k = 4").select("scan_id", "url")
    found = graph.reachable(starts, links.select("scan_id", "from_url", "to_url", "pos"), tree.select("scan_id", "url"), 3, refused=refused)
    return found.select("scan_id", "url", "depth")


# ---------------------------------------------------------------- scores, causes, recommendations

_S = "SECURITY PERFORMANCE ACCESSIBILITY PRIVACY SEO CONTENT UX ARCHITECTURE".split()


def _score_ctes(p: str) -> dict[str, str]:
    wide = ", ".join(f"max(score) FILTER (category = '{c}') AS {c.lower()}_score" for c in _S)
    return {
        f"cat{p}": f"""SELECT scan_id, category, round(greatest(CAST(0 AS DECIMAL(18,3)), CAST(100 AS DECIMAL(18,3)) - sum(CAST(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 3 ELSE 0 END AS DECIMAL(4,0)) * CAST(confidence AS DECIMAL(5,3)))), 1) AS score,
 count(*) AS finding_count FROM fnd{p} GROUP BY scan_id, category""",
        f"wide{p}": f"""SELECT b.scan_id, CAST(overall AS DOUBLE) AS overall_score, {', '.join(f'CAST({c.lower()}_score AS DOUBLE) AS {c.lower()}_score' for c in _S)} FROM base{p} b LEFT JOIN (
 SELECT scan_id, round(CAST(sum(CAST(score AS DECIMAL(9,1)) * CASE WHEN category IN ('SECURITY', 'PERFORMANCE') THEN 20 ELSE 10 END) / sum(CASE WHEN category IN ('SECURITY', 'PERFORMANCE') THEN 20 ELSE 10 END) AS DECIMAL(18,6)), 1) AS overall, {wide}
 FROM cat{p} GROUP BY scan_id) s ON s.scan_id = b.scan_id""",
    }


_SCORES = _score_ctes("") | _score_ctes("2")


@query("score_breakdown", f"""SELECT b.scan_id, c.category, CAST(score AS DOUBLE) AS score, coalesce(finding_count, 0) AS finding_count,
 CASE WHEN c.category IN ('SECURITY', 'PERFORMANCE') THEN 20 ELSE 10 END AS weight FROM base b CROSS JOIN (SELECT unnest({_S}) AS category) c LEFT JOIN cat s ON s.scan_id = b.scan_id AND s.category = c.category""", **_SCORES)
def score_breakdown(spark, d):
    a = audited(spark, d)
    return scoring.score_breakdown(a.facts, a.findings)


@query("scan_scores", "SELECT * FROM wide", **_SCORES)
def scan_scores(spark, d):
    return audited(spark, d).scores


@query("analyzer_status", f"""SELECT s.scan_id, c.category, CASE WHEN n IS NULL AND c.category NOT IN ('ARCHITECTURE', 'PRIVACY') THEN 'FAILED' ELSE 'COMPLETED' END AS status
 FROM (SELECT website_id AS scan_id FROM websites UNION ALL SELECT 'empty.' || website_id FROM websites) s CROSS JOIN (SELECT unnest({_S}) AS category) c
 LEFT JOIN (SELECT scan_id, count(*) AS n FROM px GROUP BY scan_id) p ON p.scan_id = s.scan_id""")
def analyzer_status(spark, d):
    sites = X.websites(spark, d).select(F.col("website_id").alias("scan_id"))
    with_empty = sites.unionByName(sites.select(F.concat(F.lit("empty."), "scan_id").alias("scan_id")))
    return scoring.analyzer_status(with_empty, X.pages(spark, d))


_RANKS = dict(
    rk="SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rule_order, key1, key2) AS nth, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS sev FROM fnd",
    causes="""SELECT scan_id, category, source_host, row_number() OVER (PARTITION BY scan_id ORDER BY min(nth)) AS position, count(*) AS finding_count,
 string_agg(rule_id, ',' ORDER BY nth) FILTER (g = 1) AS affected_findings FROM (
 SELECT *, row_number() OVER (PARTITION BY scan_id, category, source_host, rule_id ORDER BY nth) AS g FROM (SELECT scan_id, category, rule_id, nth, CASE WHEN evidence_type IN ('URL', 'RESOURCE', 'SCRIPT') AND evidence_source <> ''
 THEN CASE WHEN contains(evidence_source, '//') THEN string_split(evidence_source, '/')[3] ELSE evidence_source END ELSE 'general' END AS source_host FROM rk)) GROUP BY scan_id, category, source_host""",
    recgroup="""SELECT scan_id, rule_id, min(nth) AS first, arg_min(severity, nth) AS first_severity, arg_min(category, 1000000 * (4 - sev) + nth) AS category, arg_min(title, 1000000 * (4 - sev) + nth) AS p_title,
 arg_min(severity, 1000000 * (4 - sev) + nth) AS p_severity, arg_min(impact, 1000000 * (4 - sev) + nth) AS impact, arg_min(effort, 1000000 * (4 - sev) + nth) AS effort, arg_min(confidence, 1000000 * (4 - sev) + nth) AS confidence FROM rk GROUP BY scan_id, rule_id""",
    recids="""SELECT scan_id, rule_id, string_agg(finding_id, ',' ORDER BY nth) FILTER (g <= 10) AS finding_ids, count(*) AS finding_count, greatest(1, count(DISTINCT affected_url)) AS affected_pages FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY nth) AS g FROM rk) GROUP BY scan_id, rule_id""",
    recs="""SELECT g.*, i.finding_ids, i.finding_count, i.affected_pages, coalesce(t.title, 'Address ' || lower(category) || ' issue: ' || p_title) AS title, CASE WHEN bucket >= 6 THEN 'P0' WHEN bucket >= 4 THEN 'P1' WHEN bucket >= 2 THEN 'P2' ELSE 'P3' END AS preliminary_priority FROM (
 SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY CASE impact WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, first) AS position,
 CASE p_severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END + CASE impact WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS bucket FROM recgroup) g
 JOIN recids i ON i.scan_id = g.scan_id AND i.rule_id = g.rule_id LEFT JOIN rectitles t ON t.rule_id = g.rule_id""",
    ranked="""SELECT *, CASE WHEN priority_score >= 24 THEN 'P0' WHEN priority_score >= 12 THEN 'P1' WHEN priority_score >= 5 THEN 'P2' ELSE 'P3' END AS priority,
 row_number() OVER (PARTITION BY scan_id ORDER BY priority_score DESC, position) AS rank FROM (
 SELECT r.*, round(CASE first_severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END * CASE impact WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END * confidence
 * (1 + 0.5 * least(CAST(affected_pages AS DOUBLE) / pages, 1.0)) / CASE effort WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END, 3) AS priority_score FROM recs r JOIN base b ON b.scan_id = r.scan_id)""",
)


def _with_titles() -> dict[str, str]:
    from pagequarry.operators.templates import TEMPLATES

    rows = ", ".join(f"({C.lit(k)}, {C.lit(v[0])})" for k, v in TEMPLATES.items())
    return _RANKS | {"rectitles": f"SELECT * FROM (VALUES {rows}) t(rule_id, title)"}


_REC = _with_titles()


@query("root_causes", "SELECT scan_id, category, source_host, position, finding_count, affected_findings FROM causes", **_REC)
def root_causes(spark, d):
    return correlate.root_causes(audited(spark, d).findings).select(
        "scan_id", "category", "source_host", "position", "finding_count", F.array_join("affected_findings", ",").alias("affected_findings")
    )


@query("cause_findings", """SELECT scan_id, category, CASE WHEN evidence_type IN ('URL', 'RESOURCE', 'SCRIPT') AND evidence_source <> ''
 THEN CASE WHEN contains(evidence_source, '//') THEN string_split(evidence_source, '/')[3] ELSE evidence_source END ELSE 'general' END AS source_host, rule_id, finding_id FROM rk""", **_REC)
def cause_findings(spark, d):
    return correlate.cause_findings(audited(spark, d).findings).select("scan_id", "category", "source_host", "rule_id", "finding_id")


@query("recommendations", "SELECT scan_id, rule_id, position, title, category, preliminary_priority, impact, effort, confidence, p_title AS root_cause, finding_ids, finding_count, first_severity AS severity, affected_pages FROM recs", **_REC)
def recommendations(spark, d):
    r = correlate.recommendations(audited(spark, d).findings)
    return r.select("scan_id", "rule_id", "position", "title", "category", "preliminary_priority", "impact", "effort", "confidence", "root_cause",
                    F.array_join("finding_ids", ",").alias("finding_ids"), "finding_count", "severity", big("affected_pages").alias("affected_pages"))


@query("ranked_recommendations", """SELECT scan_id, rule_id, rank, priority, priority_score, 'Severity ' || first_severity || ' × impact ' || impact || ' × confidence '
 || CAST(round(confidence * 100) AS INT) || '% ÷ effort ' || effort AS priority_explanation FROM ranked""", **_REC)
def ranked_recommendations(spark, d):
    return audited(spark, d).recommendations.select("scan_id", "rule_id", "rank", "priority", "priority_score", "priority_explanation")


_ASKED = """SELECT scan_id, 'r' || category AS rec_id, category, 'LOW' AS impact, CASE WHEN length(scan_id) % 2 = 0 THEN [min_id, 'nowhere'] ELSE ['nowhere'] END AS finding_ids
 FROM (SELECT scan_id, category, max(finding_id) AS min_id FROM fnd GROUP BY scan_id, category)"""


@query("resolved_references", """SELECT a.scan_id, a.rec_id, f.finding_id AS finding_ids, f.severity, CAST(1 AS BIGINT) AS affected_pages FROM asked a JOIN (
 SELECT scan_id, category, CASE WHEN length(scan_id) % 2 = 0 THEN max(finding_id) ELSE arg_min(finding_id, nth) END AS finding_id,
 CASE WHEN length(scan_id) % 2 = 0 THEN arg_max(severity, finding_id) ELSE arg_min(severity, nth) END AS severity FROM rk GROUP BY scan_id, category) f
 ON f.scan_id = a.scan_id AND f.category = a.category""", asked=_ASKED, **_REC)
def resolved_references(spark, d):
    findings = audited(spark, d).findings
    asked = findings.groupBy("scan_id", "category").agg(F.max("finding_id").alias("id")).select(
        "scan_id", F.concat(F.lit("r"), "category").alias("rec_id"), "category", F.lit("LOW").alias("impact"),
        F.expr("CASE WHEN length(scan_id) % 2 = 0 THEN array(id, 'nowhere') ELSE array('nowhere') END").alias("finding_ids"),
    )
    out = correlate.resolve_references(asked, findings)
    return out.select("scan_id", "rec_id", F.array_join("finding_ids", ",").alias("finding_ids"), "severity", big("affected_pages").alias("affected_pages"))


_SUMMARY = _SCORES | _REC | {
    "worst": f"""SELECT scan_id, string_agg(category || ' ' || CAST(round(score) AS INT), ', ' ORDER BY r) AS worst FROM (SELECT scan_id, category, score,
 row_number() OVER (PARTITION BY scan_id ORDER BY score, list_position({_S}, category)) AS r FROM cat) WHERE r <= 3 GROUP BY scan_id""",
    "risks": "SELECT scan_id, count(*) AS n, string_agg(title, ' / ' ORDER BY r) FILTER (r <= 4) AS risks FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY nth) AS r FROM rk WHERE severity IN ('CRITICAL', 'HIGH')) GROUP BY scan_id",
    "opps": "SELECT scan_id, string_agg(title, ' / ' ORDER BY position) AS opps, string_agg(title, ', ' ORDER BY position) FILTER (o <= 2) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY position) AS o FROM recs WHERE position <= 3 AND impact IN ('HIGH', 'MEDIUM')) GROUP BY scan_id",
    "road": "SELECT scan_id, string_agg(position || '. ' || title, ' / ' ORDER BY position) AS road FROM recs WHERE position <= 5 GROUP BY scan_id",
}


@query("summaries", """SELECT w.scan_id, 'Overall health score is ' || CAST(round(overall_score) AS INT) || '/100.' AS headline,
 'Health score ' || CAST(round(overall_score) AS INT) || '/100. Weakest areas: ' || worst || '. ' || coalesce(n, 0) || ' critical/high issues identified. Highest-impact next steps: ' || coalesce(steps, 'none recorded') || '.' AS executive_summary,
 coalesce(risks, 'No critical or high findings recorded.') AS top_risks, coalesce(opps, 'Not enough measured data to prioritize.') AS biggest_opportunities, road AS roadmap
 FROM wide w JOIN worst o ON o.scan_id = w.scan_id LEFT JOIN risks r ON r.scan_id = w.scan_id LEFT JOIN opps p ON p.scan_id = w.scan_id LEFT JOIN road q ON q.scan_id = w.scan_id""", **_SUMMARY)
def summaries(spark, d):
    listed = [F.array_join(c, " / ").alias(c) for c in ("top_risks", "biggest_opportunities", "roadmap")]
    return audited(spark, d).summaries.select("scan_id", "headline", "executive_summary", *listed)


_ANSWER = """CASE page_id % 5 WHEN 0 THEN '```json' || chr(10) || '{"root_causes": [{"title": "t' || CAST(page_id AS STRING) || '", "confidence": 0.9}]}' || chr(10) || '```'
 WHEN 1 THEN 'Sure: {"root_causes": [{"title": "a"}, {"title": "b", "confidence": 0.25}]} done' WHEN 2 THEN '{"root_causes": [{"title": "x", "confidence": 1.5}]}'
 WHEN 3 THEN 'no json here' ELSE '{"root_causes": []}' END"""


@query("model_output", f"""SELECT page_id, reason, CASE WHEN reason IS NULL THEN CASE page_id % 5 WHEN 0 THEN 't' || page_id ELSE 'a,b' END END AS titles, CASE WHEN reason IS NULL THEN CASE page_id % 5 WHEN 0 THEN 0.9 ELSE 0.75 END END AS total_confidence
 FROM (SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'title missing or confidence outside 0..1' WHEN 3 THEN 'not a JSON object' WHEN 4 THEN 'nothing in it' END AS reason FROM pages)""")
def checked_model_output(spark, d):
    answers = X.table(spark, d, "pages").select("page_id", F.expr(_ANSWER).alias("raw"))
    checked = model_output.validate_lists(answers, "root_causes")
    return checked.select(
        "page_id", "reason", F.array_join(F.transform("items", lambda i: i["title"]), ",").alias("titles"),
        F.aggregate(F.transform("items", lambda i: i["confidence"]), F.lit(0.0), lambda a, b: a + b).alias("total_confidence"),
    )


@query("evidence_context", "SELECT scan_id, count(*) AS finding_count, arg_min(rule_id, nth) AS first_rule, nullif(arg_min(coalesce(substr(evidence_value, 1, 200), '~'), nth), '~') AS first_value FROM rk WHERE nth <= 80 GROUP BY scan_id", **_REC)
def evidence_context(spark, d):
    c = correlate.evidence_context(audited(spark, d).findings, max_chars=1_000_000)
    parsed = F.from_json("context", "struct<findings:array<struct<rule_id:string,evidence:array<struct<value:string>>>>>")
    first = F.get(F.col("p.findings"), F.lit(0))
    return c.withColumn("p", parsed).select(
        "scan_id", "finding_count", first["rule_id"].alias("first_rule"), F.get(first["evidence"], F.lit(0))["value"].alias("first_value"))


@query("evidence_chunks", "SELECT scan_id, category, rule_id, title, affected_url, substr(coalesce(evidence_value, ''), 1, 200) AS first_value FROM fnd WHERE evidence_type IS NOT NULL", **_REC)
def evidence_chunks(spark, d):
    """The findings with evidence as they come back from the texts."""
    entry = "struct<category:string,rule_id:string,title:string,affected_url:string,evidence:array<struct<value:string>>>"
    parsed = F.from_json("context", f"struct<findings:array<{entry}>>")
    chunks = correlate.evidence_chunks(audited(spark, d).findings)
    rows = chunks.select("scan_id", F.inline(parsed["findings"])).where(F.size("evidence") > 0)
    return rows.select("scan_id", "category", "rule_id", "title", "affected_url", F.get("evidence", F.lit(0))["value"].alias("first_value"))


# ---------------------------------------------------------------- reports and listings


@query("executive_reports", """SELECT s.scan_id, normalized_url AS website_url, s.status, overall_score, security_score, (SELECT string_agg(title, ' / ' ORDER BY nth) FROM (
 SELECT title, nth, row_number() OVER (ORDER BY nth) AS r FROM rk k WHERE k.scan_id = s.scan_id AND severity = 'HIGH') WHERE r <= 8) AS top_findings,
 (SELECT string_agg(title || ':' || priority, ' / ' ORDER BY rank) FROM ranked k WHERE k.scan_id = s.scan_id AND rank <= 5) AS top_recommendations
 FROM scans s JOIN websites w ON w.website_id = s.website_id JOIN wide q ON q.scan_id = s.scan_id""", **_SUMMARY)
def executive_reports(spark, d):
    a = audited(spark, d)
    scans = X.scans(spark, d).join(a.facts.select("scan_id"), "scan_id", "left_semi")
    r = reports.executive_reports(scans, X.websites(spark, d), a.scores, a.summaries, a.findings, a.recommendations)
    text = F.array_join(F.transform("top_findings", lambda f: f["title"]), " / ")
    recs = F.array_join(F.transform("top_recommendations", lambda f: F.concat(f["title"], F.lit(":"), f["priority"])), " / ")
    return r.select("scan_id", "website_url", "status", "overall_score", "security_score",
                    F.nullif(text, F.lit("")).alias("top_findings"), F.nullif(recs, F.lit("")).alias("top_recommendations"))


@query("developer_report", """SELECT scan_id, finding_id, severity, rule_id, evidence_value, row_number() OVER (PARTITION BY scan_id ORDER BY CASE severity WHEN 'INFO' THEN 0 ELSE 1 END, severity, rule_order, key1, key2) AS place FROM fnd""")
def developer_report(spark, d):
    from pyspark.sql import Window

    rows = reports.developer_report(audited(spark, d).findings)
    place = Window.partitionBy("scan_id").orderBy((F.col("severity") != "INFO").cast("int"), "severity", "rule_order", "key1", "key2")
    return rows.select("scan_id", "finding_id", "severity", "rule_id", F.get("evidence", F.lit(0))["value"].alias("evidence_value"),
                       big(F.row_number().over(place)).alias("place"))


@query("developer_report_heads", """SELECT b.scan_id, (SELECT count(*) FROM fnd f WHERE f.scan_id = b.scan_id) AS findings_count, b.pages AS pages_analyzed,
 (SELECT string_agg(name, ',' ORDER BY name COLLATE "C") FROM tech t WHERE t.scan_id = b.scan_id) AS technologies FROM base b""".replace(' COLLATE "C"', ""), **_TECH)
def developer_report_heads(spark, d):
    a = audited(spark, d)
    scans = a.facts.select("scan_id", F.lit("COMPLETED").alias("status"))
    heads = reports.developer_report_heads(scans, a.profiles, a.findings, a.technologies)
    return heads.select("scan_id", "findings_count", "pages_analyzed", F.array_join(F.transform("technologies", lambda t: t["name"]), ",").alias("technologies"))


@query("list_findings", "SELECT finding_id, scan_id, severity FROM fnd WHERE category = 'SEO' ORDER BY severity, scan_id, rule_order, key1, key2 LIMIT 500 OFFSET 25")
def list_findings(spark, d):
    return reports.list_findings(audited(spark, d).findings, category="seo", status="open", limit=500, offset=25).select("finding_id", "scan_id", "severity")


@query("rescanned_findings", "SELECT scan_id, finding_id FROM fnd WHERE length(scan_id) % 2 = 1 OR severity = 'HIGH'")
def rescanned_findings(spark, d):
    """Findings stored twice: the second run has half of the scans, and of those the severe findings alone."""
    folder = f"{stage_root(spark).rstrip('/')}/pagequarry-stages/rescan-{uuid.uuid4().hex}"
    a = audited(spark, d)
    again = a.facts.select("scan_id").where("length(scan_id) % 2 = 0")
    severe = a.findings.where("severity = 'HIGH'").join(again, "scan_id", "left_semi")
    write_run({"findings": a.findings}, a.facts, folder)
    write_run({"findings": severe}, again, folder)
    return read_current(spark, folder, "findings").select("scan_id", "finding_id")


@query("list_recommendations", "SELECT scan_id, rule_id, priority_score FROM ranked WHERE priority = 'P3' ORDER BY priority_score DESC, scan_id, position LIMIT 100", **_REC)
def list_recommendations(spark, d):
    return reports.list_recommendations(audited(spark, d).recommendations, priority="p3", limit=100).select("scan_id", "rule_id", "priority_score")


@query("display_order", "SELECT scan_id, rule_id, priority, priority_score FROM ranked ORDER BY priority, priority_score DESC, scan_id, position", **_REC)
def display_order(spark, d):
    return reports.display_order(audited(spark, d).recommendations).select("scan_id", "rule_id", "priority", "priority_score")


@query("count_by_severity", "SELECT scan_id, severity, count(*) AS findings FROM fnd GROUP BY scan_id, severity")
def count_by_severity(spark, d):
    return reports.count_by_severity(audited(spark, d).findings)


@query("severe_per_user", "SELECT user_id, count(*) AS findings FROM fnd f JOIN scans s ON s.scan_id = f.scan_id JOIN websites w ON w.website_id = s.website_id WHERE severity = 'HIGH' AND status = 'COMPLETED' GROUP BY user_id")
def severe_per_user(spark, d):
    return reports.critical_per_user(audited(spark, d).findings, X.scans(spark, d), X.websites(spark, d), severity="HIGH")


@query("top_recommendations_per_user", """SELECT user_id, place, scan_id, rule_id, priority, priority_score FROM (SELECT user_id, r.scan_id, rule_id, priority, priority_score,
 row_number() OVER (PARTITION BY user_id ORDER BY priority_score DESC, r.scan_id, position) AS place FROM ranked r JOIN scans s ON s.scan_id = r.scan_id JOIN websites w ON w.website_id = s.website_id WHERE status = 'COMPLETED') WHERE place <= 5""", **_REC)
def top_recommendations_per_user(spark, d):
    return reports.top_recommendations_per_user(audited(spark, d).recommendations, X.scans(spark, d), X.websites(spark, d))


@query("user_stats", "SELECT user_id, count(DISTINCT w.website_id) AS websites, count(s.scan_id) AS scans FROM websites w LEFT JOIN scans s ON s.website_id = w.website_id GROUP BY user_id")
def user_stats(spark, d):
    return reports.user_stats(X.websites(spark, d), X.scans(spark, d)).select("user_id", "websites", "scans")


@query("newest_scans", "SELECT scan_id, website_id, started_at FROM scans ORDER BY started_at DESC, scan_id LIMIT 20 OFFSET 5")
def newest_scans(spark, d):
    return reports.newest_first(X.scans(spark, d), "started_at", 20, 5, "scan_id").select("scan_id", "website_id", "started_at")


@query("owned_scans", "SELECT scan_id, s.website_id, status FROM scans s JOIN websites w ON w.website_id = s.website_id WHERE user_id = 1")
def owned_scans(spark, d):
    return reports.owned(X.scans(spark, d), X.websites(spark, d), 1).select("scan_id", "website_id", "status")


@query("finding_lookup", f"SELECT {FLAT} FROM fnd f WHERE rule_id = 'SEC_HSTS_MISSING' AND scan_id IN (SELECT s.scan_id FROM scans s JOIN websites w ON w.website_id = s.website_id WHERE user_id = 2)")
def finding_lookup(spark, d):
    found = audited(spark, d).findings.where(F.col("rule_id") == "SEC_HSTS_MISSING")
    return flat(reports.of_owner(found, X.scans(spark, d), X.websites(spark, d), 2))


@query("dashboard", """SELECT w.website_id, s.scan_id, s.started_at, s.status FROM (SELECT website_id FROM websites UNION ALL SELECT 'new.' || website_id FROM websites) w
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY started_at DESC) AS r FROM scans) s ON s.website_id = w.website_id AND r = 1""")
def dashboard(spark, d):
    sites = X.websites(spark, d).select("website_id")
    every = sites.unionByName(sites.select(F.concat(F.lit("new."), "website_id").alias("website_id")))
    return reports.dashboard(every, X.scans(spark, d)).select("website_id", "scan_id", "started_at", "status")


@query("score_bands", "SELECT scan_id, CASE WHEN ux_score IS NULL THEN 'Unmeasured' WHEN ux_score >= 90 THEN 'Excellent' WHEN ux_score >= 75 THEN 'Good' WHEN ux_score >= 60 THEN 'Needs work' ELSE 'Poor' END AS ux_band, CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 75 THEN 'Good' WHEN overall_score >= 60 THEN 'Needs work' ELSE 'Poor' END AS band FROM wide", **_SCORES)
def score_bands(spark, d):
    return audited(spark, d).scores.select("scan_id", scoring.score_band(F.col("ux_score")).alias("ux_band"), scoring.score_band(F.col("overall_score")).alias("band"))


@query("confidence_bands", "SELECT CASE WHEN round(confidence * 100) >= 80 THEN 'high' WHEN round(confidence * 100) >= 50 THEN 'medium' ELSE 'low' END AS band, count(*) AS findings FROM fnd GROUP BY 1")
def confidence_bands(spark, d):
    return audited(spark, d).findings.groupBy(scoring.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("findings"))


@query("findings_with_evidence", "SELECT scan_id, finding_id, rule_id, CASE WHEN evidence_type IS NULL THEN NULL ELSE evidence_type || '=' || evidence_value END AS evidence FROM fnd")
def findings_with_evidence(spark, d):
    findings = audited(spark, d).findings
    joined = reports.attach_evidence(findings, reports.flat_evidence(findings))
    one = F.get("evidence", F.lit(0))
    return joined.select("scan_id", "finding_id", "rule_id", F.concat(one["evidence_type"], F.lit("="), one["value"]).alias("evidence"))


@query("scan_progress", """SELECT scan_id, status, stage, CASE WHEN status = 'COMPLETED' THEN 100 WHEN stage = 'ANALYZING_SEO' THEN 70 ELSE 50 END AS progress_percent FROM scans""")
def scan_progress(spark, d):
    return reports.scan_progress(X.scans(spark, d))


@query("first_websites", "SELECT user_id, normalized_url, website_id FROM websites")
def first_websites(spark, d):
    sites = X.websites(spark, d).select("user_id", "normalized_url", "website_id", "created_at")
    again = sites.select("user_id", "normalized_url", F.concat("website_id", F.lit("#2")).alias("website_id"), F.expr("created_at + INTERVAL 1 DAY").alias("created_at"))
    return reports.first_websites(sites.unionByName(again)).select("user_id", "normalized_url", "website_id")


# ---------------------------------------------------------------- comparing sites

_LATEST = {
    "done": "SELECT website_id, scan_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY started_at DESC) AS r FROM scans WHERE status = 'COMPLETED') WHERE r = 1",
    "scores2": "SELECT * FROM wide UNION ALL SELECT * FROM wide2",
    "long": "SELECT scan_id, 'overall' AS label, overall_score AS score FROM scores2 WHERE overall_score IS NOT NULL " + " ".join(
        f"UNION ALL SELECT scan_id, '{c}', {c.lower()}_score FROM scores2 WHERE {c.lower()}_score IS NOT NULL" for c in _S),
} | _SCORES


@query("latest_completed", "SELECT website_id, scan_id, started_at FROM done", **_LATEST)
def latest_completed(spark, d):
    return compare.latest_completed(X.scans(spark, d)).select("website_id", "scan_id", "started_at")


@query("latest_finished", "SELECT website_id, arg_max(scan_id, started_at) AS scan_id, arg_max(status, started_at) AS status FROM scans GROUP BY website_id")
def latest_finished(spark, d):
    return compare.latest_finished(X.scans(spark, d)).select("website_id", "scan_id", "status")


def _bare(url: str) -> str:
    return f"regexp_replace({C.host_of(url)}, '^www\\.', '')"


_RESOLVED = _LATEST | {
    "candidates": f"""SELECT c.competitor_id, d.scan_id, w.normalized_url = c.normalized_url AS exact, w.created_at, w.website_id AS site FROM competitors c JOIN websites o ON o.website_id = c.website_id
 JOIN websites w ON w.user_id = o.user_id AND (w.normalized_url = c.normalized_url OR {_bare('w.normalized_url')} = {_bare('c.normalized_url')}) JOIN done d ON d.website_id = w.website_id""",
    "resolved": """SELECT c.competitor_id, c.website_id, k.scan_id, CASE WHEN k.exact THEN 'exact' WHEN NOT k.exact THEN 'host' END AS matched_by FROM competitors c
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY exact DESC, created_at DESC, site) AS r FROM candidates) k ON k.competitor_id = c.competitor_id AND k.r = 1""",
}


@query("competitor_scans", "SELECT competitor_id, website_id, scan_id, matched_by FROM resolved", **_RESOLVED)
def competitor_scans(spark, d):
    return compare.resolve_competitors(X.competitors(spark, d), X.websites(spark, d), X.scans(spark, d))


@query("site_competitors", "SELECT website_id, competitor_id, c.normalized_url FROM competitors c JOIN websites w USING (website_id) WHERE user_id = 1")
def site_competitors(spark, d):
    return reports.competitors_of_owner(X.competitors(spark, d), X.websites(spark, d), 1).select("website_id", "competitor_id", "normalized_url")


@query("compared_sites", """SELECT comparison_id, key, scan_id, label AS dimension, score FROM (
 SELECT q.website_id AS comparison_id, 'you' AS key, d.scan_id FROM websites q LEFT JOIN done d ON d.website_id = q.website_id
 UNION ALL SELECT website_id, 'competitor_' || competitor_id, scan_id FROM resolved WHERE competitor_id NOT LIKE 'same:%'
 UNION ALL SELECT w.website_id, 'website_' || n.other, d.scan_id FROM websites w JOIN nextsite n ON n.website_id = w.website_id LEFT JOIN done d ON d.website_id = n.other WHERE n.same_user) s LEFT JOIN long l USING (scan_id)""",
       nextsite="SELECT w.website_id, f.other, true AS same_user FROM websites w JOIN (SELECT user_id, min(website_id) AS other FROM websites GROUP BY user_id) f ON f.user_id = w.user_id WHERE f.other <> w.website_id", **_RESOLVED)
def compared_sites(spark, d):
    """Each site against its competitors, its owner's first site, and a site of another owner, which is refused."""
    sites, scans = X.websites(spark, d), X.scans(spark, d)
    rivals = X.competitors(spark, d).where(~F.startswith("competitor_id", F.lit("same:")))
    firsts = sites.groupBy("user_id").agg(F.min("website_id").alias("other_website_id"))
    foreign = firsts.select(F.pmod(F.col("user_id") + 1, F.lit(3)).alias("user_id"), "other_website_id")
    ordered = sites.select("user_id", "website_id").join(firsts.unionByName(foreign), "user_id")
    requests = rivals.select(F.col("website_id").alias("comparison_id"), "website_id", "competitor_id", F.lit(None).cast("string").alias("other_website_id")).unionByName(
        ordered.select(F.col("website_id").alias("comparison_id"), "website_id", F.lit(None).cast("string").alias("competitor_id"), "other_website_id"))
    resolved = compare.resolve_competitors(X.competitors(spark, d), sites, scans)
    return compare.compared_sites(requests, sites, scans, both(spark, d, "scores"), resolved)


_GAPS = _LATEST | {
    "gaps": f"""SELECT a.scan_id AS pair_id, a.label AS dimension, a.score AS you, b.score AS competitor, round(CAST(a.score AS DECIMAL(6,1)) - CAST(b.score AS DECIMAL(6,1)), 1)::DOUBLE AS gap
 FROM long a JOIN long b ON b.scan_id = a.scan_id || '@2' AND b.label = a.label WHERE a.label <> 'overall'""",
}


@query("score_gaps", """SELECT pair_id, dimension, you, competitor, gap, CASE WHEN gap < 0 THEN dimension || ' is ' || CAST(round(-gap) AS INT) || ' points behind the competitor.'
 WHEN gap > 0 THEN dimension || ' is ' || CAST(round(gap) AS INT) || ' points ahead of the competitor.' ELSE dimension || ' is level with the competitor.' END AS explanation FROM gaps""", **_GAPS)
def score_gaps(spark, d):
    return compare.score_gaps(_gap_pairs(spark, d), both(spark, d, "scores"))


def _gap_pairs(spark, d):
    return audited(spark, d).facts.select(
        F.col("scan_id").alias("pair_id"), F.col("scan_id").alias("self_scan_id"), F.concat("scan_id", F.lit("@2")).alias("other_scan_id"))


@query("gap_summaries", f"""SELECT b.scan_id AS pair_id, coalesce(behind, 'nothing') AS behind, coalesce(ahead, 'nothing') AS ahead, coalesce('Improve ' || first || ' first (gap ' || CAST(round(gap) AS INT) || ' points).', 'Insufficient measured data to compare.') AS summary
 FROM base b LEFT JOIN (SELECT pair_id, string_agg(dimension, ', ' ORDER BY i) FILTER (gap < -1) AS behind, string_agg(dimension, ', ' ORDER BY i) FILTER (gap > 1) AS ahead,
 arg_min(dimension, gap * 100 + i) AS first, min(gap) AS gap FROM (SELECT *, list_position({_S}, dimension) AS i, row_number() OVER (PARTITION BY pair_id, gap < -1 ORDER BY list_position({_S}, dimension)) AS rb,
 row_number() OVER (PARTITION BY pair_id, gap > 1 ORDER BY list_position({_S}, dimension)) AS ra FROM gaps) GROUP BY pair_id) g ON g.pair_id = b.scan_id""", **_GAPS)
def gap_summaries(spark, d):
    pairs = _gap_pairs(spark, d)
    return compare.gap_summaries(pairs, compare.score_gaps(pairs, both(spark, d, "scores")))


# ---------------------------------------------------------------- changes between scans

_P = "website_id, base_scan_id, compare_scan_id"
_DIFF = _LATEST | _TECH | C.suffixed(_TECH, "2") | {
    "pairs": "SELECT website_id, website_id AS base_scan_id, website_id || '@2' AS compare_scan_id FROM websites",
    "techdiff": """SELECT website_id, base_scan_id, compare_scan_id, 'added' AS type, a.name AS label FROM pairs JOIN tech2 a ON a.scan_id = compare_scan_id WHERE NOT EXISTS (SELECT 1 FROM tech b WHERE b.scan_id = base_scan_id AND b.name = a.name)
 UNION ALL SELECT website_id, base_scan_id, compare_scan_id, 'removed', b.name FROM pairs JOIN tech b ON b.scan_id = base_scan_id WHERE NOT EXISTS (SELECT 1 FROM tech2 a WHERE a.scan_id = compare_scan_id AND a.name = b.name)""",
    "labels": """SELECT scan_id, 'pages' AS category, url AS label FROM px UNION SELECT scan_id, 'pages', url FROM px2
 UNION SELECT scan_id, 'resources', url FROM res UNION SELECT scan_id, 'resources', url FROM res2
 UNION SELECT scan_id, 'third_party', domain FROM res WHERE is_external UNION SELECT scan_id, 'third_party', domain FROM res2 WHERE is_external""",
    "setdiff": """SELECT website_id, base_scan_id, compare_scan_id, category, 'added' AS type, label FROM pairs p JOIN labels l ON l.scan_id = p.compare_scan_id WHERE NOT EXISTS (SELECT 1 FROM labels k WHERE k.scan_id = p.base_scan_id AND k.category = l.category AND k.label = l.label)
 UNION ALL SELECT website_id, base_scan_id, compare_scan_id, category, 'removed', label FROM pairs p JOIN labels l ON l.scan_id = p.base_scan_id WHERE NOT EXISTS (SELECT 1 FROM labels k WHERE k.scan_id = p.compare_scan_id AND k.category = l.category AND k.label = l.label)""",
    "headlong": " UNION ALL ".join(f"""SELECT scan_id, '{h}' AS label, "{h}" AS value FROM home WHERE "{h}" IS NOT NULL UNION ALL SELECT scan_id, '{h}', "{h}" FROM home2 WHERE "{h}" IS NOT NULL""" for h in X.HEADERS),
    "headdiff": """SELECT website_id, base_scan_id, compare_scan_id, label, coalesce(b.value, '(removed)') || ' -> ' || coalesce(a.value, '(removed)') AS detail FROM pairs
 JOIN (SELECT DISTINCT regexp_replace(scan_id, '@2$', '') AS w, label FROM headlong) k ON k.w = website_id LEFT JOIN headlong b ON b.scan_id = base_scan_id AND b.label = k.label LEFT JOIN headlong a ON a.scan_id = compare_scan_id AND a.label = k.label
 WHERE b.value IS DISTINCT FROM a.value""".replace("base_scan_id, compare_scan_id, label,", "base_scan_id, compare_scan_id, k.label AS label,"),
    "scorediff": "SELECT website_id, base_scan_id, compare_scan_id, b.label, b.score AS before, a.score AS after, (CAST(a.score AS DECIMAL(6,1)) - CAST(b.score AS DECIMAL(6,1)))::DOUBLE AS delta FROM pairs JOIN long b ON b.scan_id = base_scan_id JOIN long a ON a.scan_id = compare_scan_id AND a.label = b.label",
    "perrule": "SELECT scan_id, rule_id, arg_max(title, CAST(rule_order AS HUGEINT) * 1000000000000 + key1 * 1000 + key2) AS title, arg_max(severity, CAST(rule_order AS HUGEINT) * 1000000000000 + key1 * 1000 + key2) AS severity FROM (SELECT * FROM fnd UNION ALL SELECT * FROM fnd2) GROUP BY scan_id, rule_id",
    "finddiff": """SELECT website_id, base_scan_id, compare_scan_id, 'fixed' AS type, rule_id, title, severity FROM pairs p JOIN perrule l ON l.scan_id = p.base_scan_id WHERE NOT EXISTS (SELECT 1 FROM perrule k WHERE k.scan_id = p.compare_scan_id AND k.rule_id = l.rule_id)
 UNION ALL SELECT website_id, base_scan_id, compare_scan_id, 'new', rule_id, title, severity FROM pairs p JOIN perrule l ON l.scan_id = p.compare_scan_id WHERE NOT EXISTS (SELECT 1 FROM perrule k WHERE k.scan_id = p.base_scan_id AND k.rule_id = l.rule_id)""",
    "changes": """SELECT website_id, base_scan_id, compare_scan_id, category, type, label FROM setdiff UNION ALL SELECT website_id, base_scan_id, compare_scan_id, 'header', 'changed', label FROM headdiff
 UNION ALL SELECT website_id, base_scan_id, compare_scan_id, 'scores', 'delta', label FROM scorediff UNION ALL SELECT website_id, base_scan_id, compare_scan_id, 'findings', type, rule_id FROM finddiff""",
}


def _pairs(spark, d):
    return diff.consecutive_pairs(X.scans(spark, d))


def _set_changes(spark, d):
    rows = X.pages(spark, d).select("scan_id", "url").unionByName(X.second_pages(spark, d).select("scan_id", "url"))
    res = X.resources(spark, d).unionByName(X.second_resources(spark, d))
    none = technology.technologies(X.pages(spark, d), X.resources(spark, d)).where("false")
    return diff.set_changes(diff.labels(rows, res, none), _pairs(spark, d))


@query("consecutive_pairs", f"SELECT {_P} FROM pairs", **_DIFF)
def consecutive_pairs(spark, d):
    return _pairs(spark, d)


@query("set_changes", f"SELECT {_P}, category, type, label FROM setdiff", **_DIFF)
def set_changes(spark, d):
    return _set_changes(spark, d)


@query("technology_changes", f"SELECT {_P}, 'technologies' AS category, type, label FROM techdiff", **_DIFF)
def technology_changes(spark, d):
    """Technologies need no other part of an audit: pages and resources of both scans are enough."""
    pages, found = X.pages(spark, d), X.resources(spark, d)
    known = technology.technologies(pages, found).unionByName(
        technology.technologies(X.second_pages(spark, d), X.second_resources(spark, d)))
    return diff.set_changes(diff.labels(pages.where("false"), found.where("false"), known), _pairs(spark, d))


def _header_changes(spark, d):
    homes = extract.home_pages(X.pages(spark, d).select("scan_id", "seq", "headers")).unionByName(
        extract.home_pages(X.second_pages(spark, d).select("scan_id", "seq", "headers")))
    return diff.header_changes(homes, _pairs(spark, d))


@query("header_changes", f"SELECT {_P}, 'header' AS category, 'changed' AS type, label, detail FROM headdiff", **_DIFF)
def header_changes(spark, d):
    return _header_changes(spark, d)


@query("score_changes", f"SELECT {_P}, label, before, after, delta FROM scorediff", **_DIFF)
def score_changes(spark, d):
    return diff.score_changes(both(spark, d, "scores"), _pairs(spark, d))


@query("finding_changes", f"SELECT {_P}, type, rule_id, title, severity FROM finddiff", **_DIFF)
def finding_changes(spark, d):
    return diff.finding_changes(both(spark, d, "findings"), _pairs(spark, d))


def _all_changes(spark, d):
    pairs = _pairs(spark, d)
    return diff.all_changes(
        _set_changes(spark, d), _header_changes(spark, d), diff.score_changes(both(spark, d, "scores"), pairs),
        diff.finding_changes(both(spark, d, "findings"), pairs))


@query("change_counts", f"SELECT {_P}, category, count(*) AS changes FROM changes GROUP BY {_P}, category", **_DIFF)
def change_counts(spark, d):
    return diff.change_counts(_all_changes(spark, d))


@query("change_texts", f"""SELECT p.website_id, p.base_scan_id, p.compare_scan_id, 'Change summary (deterministic):' || coalesce(chr(10) || lines, '') || coalesce(chr(10) || listed, '') AS explanation FROM pairs p
 LEFT JOIN (SELECT website_id, string_agg('  ' || label || ': ' || CAST(round(before) AS INT) || ' -> ' || CAST(round(after) AS INT) || ' (' || CASE WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'worsened' ELSE 'unchanged' END
 || ' by ' || CAST(round(abs(delta)) AS INT) || ').', chr(10) ORDER BY list_position(['overall', 'SECURITY', 'PERFORMANCE', 'ACCESSIBILITY', 'PRIVACY', 'SEO'], label)) AS lines FROM scorediff
 WHERE label IN ('overall', 'SECURITY', 'PERFORMANCE', 'ACCESSIBILITY', 'PRIVACY', 'SEO') GROUP BY website_id) s ON s.website_id = p.website_id
 LEFT JOIN (SELECT website_id, string_agg('  [' || type || '] ' || category || ': ' || label, chr(10) ORDER BY r) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY category, type, label) AS r FROM changes WHERE category <> 'scores') WHERE r <= 10 GROUP BY website_id) l ON l.website_id = p.website_id""", **_DIFF)
def change_texts(spark, d):
    scores = diff.score_changes(both(spark, d, "scores"), _pairs(spark, d))
    return diff.change_texts(scores, _all_changes(spark, d).where(F.col("category") != "scores"))


_UPDATES = "CASE page_id % 3 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'BOGUS' ELSE 'VERIFIED' END"


def _updates(spark, d):
    return X.table(spark, d, "pages").select(
        F.expr(f"{X.HOST} || '|SECURITY|SEC_HSTS_MISSING|0|0'").alias("finding_id"), F.expr(_UPDATES).alias("status"), F.col("page_id").alias("updated_at"))


@query("status_updates", f"""SELECT f.finding_id, coalesce(u.status, 'OPEN') AS status FROM fnd f LEFT JOIN (SELECT {X.HOST} || '|SECURITY|SEC_HSTS_MISSING|0|0' AS finding_id, arg_max({_UPDATES}, page_id) AS status
 FROM pages WHERE {_UPDATES} <> 'BOGUS' GROUP BY 1) u ON u.finding_id = f.finding_id""")
def status_updates(spark, d):
    return diff.apply_status_updates(audited(spark, d).findings, _updates(spark, d), "finding_id").select("finding_id", "status")


@query("rejected_updates", f"SELECT finding_id, status, updated_at FROM (SELECT {X.HOST} || '|SECURITY|SEC_HSTS_MISSING|0|0' AS finding_id, {_UPDATES} AS status, page_id AS updated_at FROM pages) WHERE status = 'BOGUS'")
def rejected_updates(spark, d):
    return diff.rejected_updates(_updates(spark, d))


@query("change_history", f"SELECT {_P}, started_at AS created_at FROM pairs p JOIN (SELECT scan_id, started_at FROM scans) s ON s.scan_id = p.compare_scan_id", **_DIFF)
def change_history(spark, d):
    started = X.scans(spark, d).select(F.col("scan_id").alias("compare_scan_id"), F.col("started_at").alias("created_at"))
    return diff.change_history(_pairs(spark, d).join(started, "compare_scan_id")).select("website_id", "base_scan_id", "compare_scan_id", "created_at")


# ---------------------------------------------------------------- admission

_ADMISSION_SECONDS = 12 * 3600


@query("admission", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 run AS (SELECT user_id, n, event_id, true AS admitted, [us] AS kept FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.event_id, len(list_filter(kept, lambda k: e.us - k <= 43200000000)) < 2,
 CASE WHEN len(list_filter(kept, lambda k: e.us - k <= 43200000000)) < 2 THEN list_append(list_filter(kept, lambda k: e.us - k <= 43200000000), e.us) ELSE list_filter(kept, lambda k: e.us - k <= 43200000000) END
 FROM run JOIN e ON e.user_id = run.user_id AND e.n = run.n + 1)
 SELECT CAST(user_id AS STRING) AS key, event_id, admitted FROM run""")
def admission(spark, d):
    """Two events per user and twelve hours: the supplied events span thirty days."""
    return admit(X.table(spark, d, "events"), key="user_id", limit=2, window_seconds=_ADMISSION_SECONDS).select("key", "event_id", "admitted")
