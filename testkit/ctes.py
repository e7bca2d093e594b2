"""DuckDB building blocks of the oracle SQL, put together by name."""

from __future__ import annotations

import re

from pagequarry.operators.rules.catalog import RULES, rule
from testkit import fixtures as X

_RAW = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>"
)
_NOT_MARKUP = r"(?is)<!--.*?-->|(<script\b[^>]*>).*?(</script\s*>)|(<style\b[^>]*>).*?(</style\s*>)"
_TOKEN = r"""</?[a-zA-Z][a-zA-Z0-9:\-]*(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*>[^<]*"""
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def decode(expr: str) -> str:
    for ref, char in _NAMED:
        expr = f"replace({expr}, {lit(ref)}, {lit(char)})"
    return expr


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def attr(name: str, source: str = "attrs") -> str:
    pattern = rf'(?:^|\s){name}\s*=\s*"([^"]*)"'
    return decode(f"regexp_extract({source}, {lit(pattern)}, 1)")


def has_attr(name: str, source: str = "attrs") -> str:
    return f"regexp_matches({source}, {lit(rf'(?:^|\s){name}(?:[\s=]|$)')})"


def join(base: str, href: str) -> str:
    """Link resolution for the kinds of link the data holds."""
    root = f"regexp_extract({base}, '^(https?://[^/?#]+)', 1)"
    path = f"regexp_extract({base}, '^https?://[^/?#]+([^?#]*)', 1)"
    folder = f"(CASE WHEN {path} = '' THEN '/' ELSE regexp_extract({path}, '^(.*/)', 1) END)"
    return (
        f"(CASE WHEN {href} LIKE 'http%' THEN {href}"
        f" WHEN {href} LIKE '//%' THEN regexp_extract({base}, '^(https?:)', 1) || {href}"
        f" WHEN {href} LIKE '/%' THEN {root} || {href}"
        f" WHEN {href} LIKE '../%' THEN {root} || regexp_replace({folder}, '[^/]+/$', '') || substr({href}, 4)"
        f" ELSE {root} || {folder} || {href} END)"
    )


def host_of(expr: str) -> str:
    return f"lower(regexp_extract({expr}, '^https?://([^/?#:]+)', 1))"


def _page_select(scan: str, url: str, final_url: str, suffix: str, where: str) -> str:
    headers = ", ".join(
        (f"CASE WHEN page_id % 4 = 1 THEN ({v}) || '{suffix}' ELSE {v} END" if suffix else v) + f' AS "{k}"'
        for k, v in X.HEADERS.items()
    )
    return (
        f"SELECT {scan} AS scan_id, page_id AS seq, {url} AS url, {final_url} AS final_url, {X.STATUS} AS status_code,"
        f" {X.DEPTH} AS depth, {X.LOAD} AS load_time, {headers}, {X.HTML_AFTER if suffix else X.HTML} AS html, page_id FROM pages {where}"
    )


def _res_select(scan: str, where: str) -> str:
    return f"""SELECT {scan} AS scan_id, page_id AS seq, CAST(n AS BIGINT) AS ord,
 scheme || '://' || domain || '/r' || CAST(page_id % 50 AS STRING) || '_' || CAST(n AS STRING) AS url,
 resource_type, domain <> scan_id AS is_external, domain, size_bytes FROM (
 SELECT scan_id, page_id, n, {X.RESOURCE_DOMAIN} AS domain, {X.RESOURCE_SCHEME} AS scheme, {X.RESOURCE_TYPE} AS resource_type,
 {X.RESOURCE_SIZE} AS size_bytes FROM (
 SELECT page_id, {X.HOST} AS scan_id, unnest(range(0, page_id % 15)) AS n FROM pages {where}))"""


_CHANGED = "CASE WHEN page_id % 9 = 0 THEN url || '/new' ELSE url END"


def _page_ctes(p: str) -> dict[str, str]:
    """Token table, page profiles and scan facts for the pages CTE ``px{p}``."""
    opened = "NOT is_close"
    field = f"({opened} AND tag IN ('input','select','textarea') AND {attr('type')} NOT IN ('hidden','submit','button','reset'))"
    blank_txt = squeeze(decode("txt"))
    return {
        f"tok{p}": f"""SELECT scan_id, seq, CAST(pos AS BIGINT) AS pos, substr(t, 2, 1) = '/' AS is_close,
 lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9:\\-]*)', 1)) AS tag,
 regexp_extract(t, '(?s)^</?[a-zA-Z][a-zA-Z0-9:\\-]*([^>]*)>', 1) AS attrs,
 regexp_extract(t, '(?s)^<[^>]*>(.*)$', 1) AS txt
 FROM (SELECT scan_id, seq, unnest(a) AS t, unnest(range(len(a))) AS pos FROM (
 SELECT scan_id, seq, regexp_extract_all(regexp_replace(html, {lit(_NOT_MARKUP)}, '\\1\\2\\3\\4', 'g'), {lit(_TOKEN)}) AS a FROM px{p}))""",
        f"run{p}": f"""SELECT *, {blank_txt} <> '' AS says,
 sum(CASE WHEN tag = 'nav' THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END) OVER w AS nav_d,
 sum(CASE WHEN tag = 'label' THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END) OVER w AS label_d,
 sum(CASE WHEN tag = 'form' THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END) OVER w AS form_d,
 sum(CASE WHEN tag = 'form' AND {opened} THEN 1 ELSE 0 END) OVER w AS form_no,
 last_value(CASE WHEN tag = 'a' THEN CASE WHEN is_close THEN -1 ELSE pos END END IGNORE NULLS) OVER w AS a_no,
 last_value(CASE WHEN tag = 'button' THEN CASE WHEN is_close THEN -1 ELSE pos END END IGNORE NULLS) OVER w AS b_no,
 sum(CASE WHEN tag IN ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr') THEN 0
 WHEN is_close THEN -1 ELSE 1 END) OVER w AS d,
 {field} AS is_field
 FROM tok{p} WINDOW w AS (PARTITION BY scan_id, seq ORDER BY pos)""",
        f"alinks{p}": f"""SELECT seq, scan_id, a_no, bool_or(says OR {attr('aria-label')} <> '' OR {attr('title')} <> '') AS named,
 max(CASE WHEN pos = a_no THEN {attr('href')} END) AS href FROM run{p} WHERE a_no >= 0 AND NOT (tag = 'a' AND is_close)
 GROUP BY scan_id, seq, a_no""",
        f"buttons{p}": f"""SELECT seq, scan_id, b_no, bool_or(says OR (tag = 'button' AND {attr('aria-label')} <> '')) AS named
 FROM run{p} WHERE b_no >= 0 AND NOT (tag = 'button' AND is_close) GROUP BY scan_id, seq, b_no""",
        f"heads{p}": f"""SELECT scan_id, seq, pos, level, prev FROM (SELECT scan_id, seq, pos, CAST(substr(tag, 2, 1) AS INT) AS level,
 lag(CAST(substr(tag, 2, 1) AS INT)) OVER (PARTITION BY scan_id, seq ORDER BY pos) AS prev
 FROM tok{p} WHERE NOT is_close AND tag IN ('h1','h2','h3','h4','h5','h6')) WHERE level > prev + 1""",
        f"unlab{p}": f"""SELECT r.scan_id, r.seq, r.pos, substr(CASE WHEN {attr('name')} <> '' THEN {attr('name')}
 WHEN {attr('type')} <> '' THEN {attr('type')} ELSE 'input' END, 1, 120) AS name FROM run{p} r
 WHERE is_field AND label_d = 0 AND {attr('aria-label')} = '' AND {attr('aria-labelledby')} = ''
 AND NOT EXISTS (SELECT 1 FROM tok{p} l WHERE l.scan_id = r.scan_id AND l.seq = r.seq AND l.tag = 'label' AND NOT l.is_close
 AND {attr('for', 'l.attrs')} = {attr('id', 'r.attrs')} AND {attr('id', 'r.attrs')} <> '')""",
        f"hidden{p}": f"""SELECT DISTINCT h.scan_id, h.seq FROM run{p} h JOIN run{p} r ON r.scan_id = h.scan_id AND r.seq = h.seq AND r.pos > h.pos
 WHERE NOT h.is_close AND {attr('aria-hidden', 'h.attrs')} = 'true' AND NOT r.is_close AND {has_attr('role', 'r.attrs')}
 AND NOT EXISTS (SELECT 1 FROM run{p} k WHERE k.scan_id = h.scan_id AND k.seq = h.seq AND k.pos > h.pos AND k.pos < r.pos AND k.d < h.d)""",
        f"forms{p}": f"""SELECT scan_id, seq, max(n) AS form_max FROM (SELECT scan_id, seq, form_no, count(*) AS n FROM run{p}
 WHERE is_field AND form_d > 0 GROUP BY scan_id, seq, form_no) GROUP BY scan_id, seq""",
        f"lnk{p}": f"""SELECT scan_id, seq, link, row_number() OVER (PARTITION BY scan_id, seq ORDER BY min(pos)) - 1 AS pos FROM (
 SELECT t.scan_id, t.seq, t.pos, regexp_replace({join('x.final_url', 't.href')}, '#.*$', '') AS link, x.url FROM (
 SELECT scan_id, seq, pos, trim({attr('href')}) AS href FROM tok{p} WHERE tag = 'a' AND NOT is_close AND {has_attr('href')}) t
 JOIN px{p} x ON x.scan_id = t.scan_id AND x.seq = t.seq
 WHERE t.href <> '' AND NOT regexp_matches(t.href, '^(#|mailto:|tel:|javascript:|data:)'))
 WHERE {host_of('link')} = {host_of('url')} GROUP BY scan_id, seq, link""",
        f"tagsum{p}": f"""SELECT scan_id, seq, count(*) FILTER ({opened} AND tag = 'h1') AS h1_count,
 count(*) FILTER ({opened} AND tag IN ('h1','h2')) AS h1_h2_count,
 count(*) FILTER ({opened} AND tag = 'img' AND NOT {has_attr('alt')} AND {attr('role')} <> 'presentation') AS img_no_alt,
 min_by(substr({attr('src')}, 1, 200), pos) FILTER ({opened} AND tag = 'img' AND NOT {has_attr('alt')} AND {attr('role')} <> 'presentation') AS img_no_alt_first,
 coalesce(bool_or({opened} AND tag = 'img' AND {attr('src')} <> '' AND {attr('width')} = '' AND {attr('height')} = ''), false) AS has_unsized_img,
 coalesce(bool_or({opened} AND tag = 'html' AND {attr('lang')} <> ''), false) AS has_html_lang,
 coalesce(bool_or({opened} AND (tag = 'button' OR (tag = 'a' AND contains({attr('class')}, 'btn')))), false) AS has_button,
 coalesce(min_by({attr('content')}, pos) FILTER ({opened} AND tag = 'meta' AND {attr('name')} = 'viewport'), '') <> '' AS has_viewport,
 min_by(substr(trim({attr('content')}), 1, 500), pos) FILTER ({opened} AND tag = 'meta' AND {attr('name')} = 'description') AS description,
 min_by({attr('href')}, pos) FILTER ({opened} AND tag = 'link' AND {attr('rel')} = 'canonical') AS canonical_href,
 coalesce(sum(nav_d) FILTER ({opened} AND tag = 'a'), 0) AS nav_links
 FROM run{p} GROUP BY scan_id, seq""",
        f"text{p}": f"""SELECT scan_id, seq, {squeeze(decode("regexp_replace(regexp_replace(html, " + lit(_RAW) + ", ' ', 'g'), '</?[a-zA-Z][^>]*>|<[!?][^>]*>', ' ', 'g')"))} AS text,
 CASE WHEN html LIKE '%<title>%' THEN {squeeze(decode("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} END AS title,
 regexp_extract_all(html, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1) AS json_ld,
 len(list_filter(regexp_extract_all(html, '(?i)<meta\\s+name="robots"\\s+content="([^"]*)"', 1), lambda c: contains(lower(c), 'noindex'))) AS noindex_metas,
 list_filter(list_transform(list_filter(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>'),
 lambda s: NOT regexp_matches(s, '(?is)^<script\\b[^>]*\\ssrc\\s*=')),
 lambda s: trim(regexp_extract(s, '(?is)^<script\\b[^>]*>(.*?)</script\\s*>$', 1))), lambda b: b <> '') AS inline_scripts
 FROM px{p}""",
        f"prof{p}": f"""SELECT x.*, t.text, t.title, t.json_ld, t.noindex_metas, t.inline_scripts, g.* EXCLUDE (scan_id, seq),
 octet_length(encode(x.html)) AS html_size, CASE WHEN t.text = '' THEN 0 ELSE len(string_split(t.text, ' ')) END AS word_count,
 CASE WHEN t.text <> '' THEN sha256(substr(t.text, 1, 400)) END AS opening_sha,
 CASE WHEN g.canonical_href <> '' THEN {join('x.final_url', 'g.canonical_href')} END AS canonical_url,
 CASE WHEN g.description <> '' THEN g.description END AS meta_description,
 (SELECT count(*) FROM lnk{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq) AS link_count,
 (SELECT count(*) FROM unlab{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq) AS unlabeled,
 (SELECT min_by(name, pos) FROM unlab{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq) AS unlabeled_first,
 (SELECT count(*) FROM heads{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq) AS heading_skips,
 (SELECT min_by('h' || prev || ' -> h' || level, pos) FROM heads{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq) AS heading_skip_first,
 (SELECT count(*) FROM alinks{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq AND NOT named) AS empty_links,
 (SELECT min_by(href, a_no) FROM alinks{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq AND NOT named) AS empty_link_first,
 (SELECT count(*) FROM buttons{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq AND NOT named) AS empty_buttons,
 (SELECT count(*) FROM hidden{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq) > 0 AS hidden_role,
 coalesce((SELECT max(form_max) FROM forms{p} l WHERE l.scan_id = x.scan_id AND l.seq = x.seq), 0) AS form_max,
 regexp_matches(lower(t.text), 'get started|sign up|signup|buy now|start free|download|register|subscribe|try for free|join') AS has_cta_text
 FROM px{p} x JOIN text{p} t ON t.scan_id = x.scan_id AND t.seq = x.seq JOIN tagsum{p} g ON g.scan_id = x.scan_id AND g.seq = x.seq""",
        f"home{p}": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS rn FROM prof{p}) WHERE rn = 1",
        f"base{p}": f"SELECT scan_id, min_by(url, seq) AS base_url, count(*) AS pages FROM px{p} GROUP BY scan_id",
    }


def _hit(p: str, category: str, rule_id: str, where: str, title: str, kind: str, value: str, weight: str = "1", least: int = 1,
         base: bool = False) -> str:
    """A page rule as SQL: ``title`` and ``value`` may use n (count) and v (the first page's value)."""
    url = "b.base_url" if base else "f.url"
    return (
        f"SELECT f.scan_id, {lit(category)} AS category, {lit(rule_id)} AS rule_id, 0 AS key1, 0 AS key2, {title} AS title,"
        f" {url} AS affected_url, {lit(kind)} AS evidence_type, {url} AS evidence_source, {value} AS evidence_value, CAST(NULL AS DOUBLE) AS conf"
        f" FROM (SELECT scan_id, CAST(sum({weight}) AS BIGINT) AS n, arg_min(url, seq) AS url, arg_min(seq, seq) AS fseq"
        f" FROM prof{p} WHERE {where} GROUP BY scan_id) f JOIN prof{p} x ON x.scan_id = f.scan_id AND x.seq = f.fseq"
        f" JOIN base{p} b ON b.scan_id = f.scan_id WHERE n >= {least}"
    )


def _home(p: str, category: str, rule_id: str, where: str, title: str, kind: str | None, source: str, value: str, affected: str = "NULL") -> str:
    shown = (f"{lit(kind)} AS evidence_type, {source} AS evidence_source, {value} AS evidence_value" if kind
             else "NULL AS evidence_type, NULL AS evidence_source, NULL AS evidence_value")
    return (
        f"SELECT scan_id, {lit(category)} AS category, {lit(rule_id)} AS rule_id, 0 AS key1, 0 AS key2, {title} AS title,"
        f" {affected} AS affected_url, {shown}, CAST(NULL AS DOUBLE) AS conf FROM home{p} WHERE {where}"
    )


def _rule_ctes(p: str) -> dict[str, str]:
    a, s, u = "ACCESSIBILITY", "SEO", "UX"
    h = '"strict-transport-security"'
    c = '"content-security-policy"'
    resp = "'response headers'"

    def header(rid: str, where: str, title: str, source: str, value: str) -> str:
        return _home(p, "SECURITY", rid, where, lit(title), "HTTP_HEADER", source, value)

    absent = lambda name: lit(f"{name}: (absent)")
    skip = dict(where="heading_skips > 0", title="'Heading hierarchy skips levels (' || n || ' instance(s))'", kind="HTML_ELEMENT",
                value="x.heading_skip_first", weight="heading_skips")
    page_rules = [
        _hit(p, a, "A11Y_IMG_MISSING_ALT", "img_no_alt > 0", "'Images missing alt text (' || n || ' found)'", "HTML_ELEMENT", "x.img_no_alt_first", "img_no_alt"),
        _hit(p, a, "A11Y_FORM_FIELD_NO_LABEL", "unlabeled > 0", "'Form fields without labels (' || n || ' found)'", "HTML_ELEMENT", "x.unlabeled_first", "unlabeled"),
        _hit(p, a, "A11Y_HEADING_ORDER", **skip),
        _hit(p, s, "A11Y_HEADING_ORDER", **skip),
        _hit(p, a, "A11Y_HTML_LANG_MISSING", "NOT has_html_lang", "'Document language is not declared'", "HTML_ELEMENT", "'html[lang] missing'"),
        _hit(p, a, "A11Y_EMPTY_LINK", "empty_links > 0", "'Links without accessible names (' || n || ' found)'", "HTML_ELEMENT", "x.empty_link_first", "empty_links"),
        _hit(p, a, "A11Y_EMPTY_BUTTON", "empty_buttons > 0", "'Buttons without accessible names (' || n || ' found)'", "HTML_ELEMENT", "'<button></button>'", "empty_buttons"),
        _hit(p, a, "A11Y_ARIA_HIDDEN_FOCUSABLE", "hidden_role", "'Focusable elements inside aria-hidden containers'", "HTML_ELEMENT", "'focusable content inside aria-hidden'"),
        _hit(p, "CONTENT", "CONTENT_NO_HEADINGS", "h1_h2_count = 0", "'Pages without heading structure (' || n || ')'", "PAGE", "'no h1/h2 found'"),
        _hit(p, "PERFORMANCE", "PERF_IMAGES_NO_DIMENSIONS", "has_unsized_img", "'Images missing width/height attributes on ' || n || ' page(s)'", "HTML_ELEMENT", "'pages=' || n", least=2),
        _hit(p, s, "SEO_TITLE_MISSING", "coalesce(trim(title), '') = ''", "'Missing page title on ' || n || ' page(s)'", "PAGE", "'no <title> tag'"),
        _hit(p, s, "SEO_TITLE_TOO_LONG", "length(title) > 65", "'Title exceeds recommended length on ' || n || ' page(s)'", "PAGE", "x.title"),
        _hit(p, s, "SEO_META_DESCRIPTION_MISSING", "coalesce(meta_description, '') = ''", "'Missing meta description on ' || n || ' page(s)'", "PAGE", "'no meta description'"),
        _hit(p, s, "SEO_CANONICAL_MISSING", "canonical_url IS NULL", "'No canonical URL on ' || n || ' page(s)'", "PAGE", "'no canonical link'", least=2),
        _hit(p, s, "SEO_URL_STRUCTURE", "regexp_matches(regexp_extract(url, '^([^?#]*)', 1), '[A-Z\\s_]')", "'URLs with uppercase characters/underscores (' || n || ')'", "URL", "'uppercase or underscore in path'"),
        _hit(p, s, "SEO_BROKEN_PAGES", "status_code >= 400", "'Pages returning errors (' || n || ')'", "PAGE", "'status ' || x.status_code"),
        _hit(p, s, "SEO_NOINDEX_PAGES", "noindex_metas > 0", "n || ' page(s) blocked from indexing (noindex)'", "HTML_ELEMENT", "'noindex count=' || n", "noindex_metas", base=True),
        _hit(p, u, "UX_MULTIPLE_H1", "h1_count > 1", "'Multiple H1 headings on ' || n || ' page(s)'", "HTML_ELEMENT", "'multiple h1'"),
        _hit(p, u, "UX_CONTENT_DENSITY", "word_count > 4000", "'Very dense content on ' || n || ' page(s)'", "PAGE", "'words=' || x.word_count"),
        _hit(p, u, "UX_UNCLEAR_PURPOSE", "h1_count = 0 AND coalesce(title, '') = ''",
             "'Unclear page purpose on ' || n || ' page(s)'", "PAGE", "'no title and no h1'"),
        _hit(p, "CONTENT", "CONTENT_THIN", "word_count < 150", "'Thin content on ' || n || ' page(s)'", "PAGE",
             f"(SELECT substr(string_agg(e, ', ' ORDER BY seq), 1, 1000) FROM (SELECT scan_id, seq, url || ' (' || word_count || 'w)' AS e, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS r FROM prof{p} WHERE word_count < 150) q WHERE q.scan_id = f.scan_id AND r <= 5)"),
    ]
    cookie_names = lambda cond: (
        f"(SELECT string_agg(name, ', ' ORDER BY n) FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, seq ORDER BY n) AS r FROM cookies{p} WHERE {cond}) k"
        f" WHERE k.scan_id = home{p}.scan_id AND k.seq = home{p}.seq AND r <= 8)"
    )
    cookie_count = lambda cond: f"(SELECT count(*) FROM cookies{p} k WHERE k.scan_id = home{p}.scan_id AND k.seq = home{p}.seq AND {cond})"
    home_rules = [
        _home(p, "SECURITY", "SEC_HTTPS_ABSENT", "url LIKE 'http://%'", "'Site is served over unencrypted HTTP'", "URL", "url", "'http:// scheme observed'", "url"),
        header("SEC_HSTS_MISSING", f"{h} IS NULL", "HTTP Strict Transport Security (HSTS) header is missing", resp, absent("strict-transport-security")),
        header("SEC_HSTS_NO_SUBDOMAINS", f"{h} NOT LIKE '%includeSubDomains%'", "HSTS does not include subdomains", "'strict-transport-security'", h),
        header("SEC_HSTS_SHORT_MAXAGE", f"TRY_CAST(regexp_extract({h}, 'max-age=([0-9]+)', 1) AS BIGINT) < 15552000", "HSTS max-age is shorter than recommended (180 days)", "'strict-transport-security'", h),
        header("SEC_CSP_MISSING", f"{c} IS NULL", "Content Security Policy (CSP) header is missing", resp, absent("content-security-policy")),
        header("SEC_CSP_UNSAFE_INLINE", f"{c} LIKE '%unsafe-inline%'", "CSP allows 'unsafe-inline'", "'content-security-policy'", c),
        header("SEC_CSP_UNSAFE_EVAL", f"{c} LIKE '%unsafe-eval%'", "CSP allows 'unsafe-eval'", "'content-security-policy'", c),
        header("SEC_XCTO_MISSING", "coalesce(\"x-content-type-options\", '') <> 'nosniff'", "X-Content-Type-Options header is missing or not 'nosniff'", resp, absent("x-content-type-options")),
        header("SEC_REFERRER_POLICY_MISSING", '"referrer-policy" IS NULL', "Referrer-Policy header is missing", resp, absent("referrer-policy")),
        header("SEC_PERMISSIONS_POLICY_MISSING", '"permissions-policy" IS NULL AND "feature-policy" IS NULL', "Permissions-Policy header is missing", resp, absent("permissions-policy")),
        header("SEC_FRAME_PROTECTION_MISSING", f"coalesce({c}, '') NOT LIKE '%frame-ancestors%' AND \"x-frame-options\" IS NULL", "No frame protection (X-Frame-Options / CSP frame-ancestors)", resp, lit("x-frame-options: (absent); csp frame-ancestors: (absent)")),
        header("SEC_TECH_DISCLOSURE", '"x-powered-by" IS NOT NULL', "Server technology disclosed via X-Powered-By header", "'x-powered-by'", '"x-powered-by"'),
        header("SEC_SERVER_VERSION_DISCLOSURE", "server <> 'cloudflare' AND regexp_matches(server, '[0-9]+\\.[0-9]+')", "Web server version disclosed", "'server'", "server"),
        _home(p, "SECURITY", "SEC_COOKIE_MISSING_SECURE", f"{cookie_count('NOT secure')} > 0", "'Cookies set without the Secure attribute'", "COOKIE", "url", cookie_names("NOT secure")),
        _home(p, "SECURITY", "SEC_COOKIE_MISSING_HTTPONLY", f"{cookie_count('NOT httponly')} > 0", "'Cookies without the HttpOnly attribute'", "COOKIE", "url", cookie_names("NOT httponly")),
        _home(p, "PRIVACY", "PRIV_THIRD_PARTY_COOKIES", f"{cookie_count(lit('') + ' <> domain')} > 0", f"'Potential third-party cookies observed (' || {cookie_count(lit('') + ' <> domain')} || ')'", "COOKIE", "url", cookie_names("domain <> ''"), "url"),
        _home(p, s, "SEO_OG_MISSING", "html NOT LIKE '%og:title%'", "'Open Graph tags not found on the homepage'", "HTML_ELEMENT", "url", "'og:title missing'", "url"),
        _home(p, u, "UX_NAV_COMPLEXITY", "nav_links >= 12", "'Navigation contains ' || nav_links || ' links'", "HTML_ELEMENT", "url", "'nav_links=' || nav_links", "url"),
        _home(p, u, "UX_NO_CTA", "NOT has_cta_text AND NOT has_button", "'No clear call-to-action detected on the homepage'", "HTML_ELEMENT", "url", "'no CTA found'", "url"),
        _home(p, u, "UX_NO_VIEWPORT", "NOT has_viewport", "'Mobile viewport meta tag is missing'", "HTML_ELEMENT", "url", "'no viewport meta'", "url"),
    ]

    def site(category: str, rule_id: str, body: str, where: str, title: str, kind: str | None, source: str, value: str, affected: str, key1: str = "0", key2: str = "0", conf: str = "NULL") -> str:
        shown = (f"{lit(kind)} AS evidence_type, {source} AS evidence_source, {value} AS evidence_value" if kind
                 else "NULL AS evidence_type, NULL AS evidence_source, NULL AS evidence_value")
        return (
            f"SELECT q.scan_id, {lit(category)} AS category, {lit(rule_id)} AS rule_id, {key1} AS key1, {key2} AS key2, {title} AS title,"
            f" {affected} AS affected_url, {shown}, CAST({conf} AS DOUBLE) AS conf FROM ({body}) q JOIN base{p} b ON b.scan_id = q.scan_id WHERE {where}"
        )

    agg = f"""SELECT scan_id, sum(html_size) AS bytes, sum(len(json_ld)) AS blocks, sum(len(list_filter(json_ld, lambda j: json_valid(j)))) AS valid,
 sum(link_count) AS links, avg(depth) AS mean_depth, bool_or(lower(html) LIKE '%privacy%') AS privacy, bool_or(lower(html) LIKE '%cookie%') AS cookie,
 bool_or(regexp_matches(lower(html), 'cookie consent|cookiepolicy|cookie-policy|accept cookies|consent|onetrust|cookiebot|cmp-widget')) AS consent,
 max(form_max) AS form_max, arg_max(url, form_max * 1000000000 - seq) AS form_url FROM prof{p} GROUP BY scan_id"""
    def found(pattern: str) -> str:
        return (f"SELECT scan_id, string_agg(v, ', ' ORDER BY v) AS shown FROM (SELECT scan_id, v, row_number() OVER (PARTITION BY scan_id ORDER BY v) AS r"
                f" FROM (SELECT DISTINCT scan_id, unnest(regexp_extract_all(html, {lit(pattern)})) AS v FROM px{p})) WHERE r <= 5 GROUP BY scan_id")

    secret = "(?i)(api[_-]?key|secret|token|password)\\s*[=:]\\s*['\"][A-Za-z0-9_\\-]{12,}['\"]"
    keys = (f"SELECT scan_id, '[' || string_agg('''' || k || '''', ', ' ORDER BY r) || ']' AS shown FROM (SELECT scan_id, k, row_number() OVER (PARTITION BY scan_id ORDER BY seq, i) AS r"
            f" FROM (SELECT scan_id, seq, unnest(m) AS k, unnest(range(len(m))) AS i FROM (SELECT scan_id, seq, regexp_extract_all(html, {lit(secret)}, 1) AS m FROM px{p}))) WHERE r <= 3 GROUP BY scan_id")
    bad = (f"SELECT scan_id, seq, i FROM (SELECT scan_id, seq, unnest(json_ld) AS j, unnest(range(len(json_ld))) AS i FROM prof{p}) WHERE NOT json_valid(j)")
    dup = (f"SELECT scan_id, count(*) AS n, arg_min(url, seq) AS url, arg_min(title, seq) AS title FROM (SELECT scan_id, seq, url, title,"
           f" row_number() OVER (PARTITION BY scan_id, lower(trim(title)) ORDER BY seq) AS r FROM prof{p} WHERE trim(title) <> '') WHERE r > 1 GROUP BY scan_id")
    rep = (f"SELECT scan_id, count(*) AS n, min(seq) AS first_seq, arg_min(url, seq) AS url FROM prof{p} WHERE opening_sha IS NOT NULL"
           f" GROUP BY scan_id, opening_sha HAVING count(*) >= 2")
    site_rules = [
        site("PERFORMANCE", "PERF_LARGE_HTML", agg, "bytes > 1572864", "'Large HTML payload'", "METRIC", "'pages'", "'html_bytes=' || bytes", "NULL"),
        site("PRIVACY", "PRIV_PRIVACY_POLICY_MISSING", agg, "NOT privacy", "'No privacy policy reference detected'", "HTML_ELEMENT", "base_url", "'no privacy policy reference found'", "base_url"),
        site("PRIVACY", "PRIV_CONSENT_UI_NOT_OBSERVED", agg, "cookie AND NOT consent", "'Cookies observed but no consent UI signals detected'", "COOKIE", "base_url", "'cookie signals present'", "base_url"),
        site(s, "SEO_NO_INTERNAL_LINKS", agg, "links = 0 AND pages = 1", "'No internal links detected'", None, "", "", "base_url"),
        site(s, "SEO_STRUCTURED_DATA_MISSING", agg, "blocks = 0", "'No structured data (JSON-LD) detected'", None, "", "", "base_url"),
        site(s, "SEO_STRUCTURED_DATA_PRESENT", agg, "valid > 0", "'Valid structured data detected'", None, "", "", "base_url"),
        site(s, "SEO_STRUCTURED_DATA_INVALID", bad, "true", "'Invalid JSON-LD structured data'", "HTML_ELEMENT", "base_url", "'invalid application/ld+json'", "base_url", "seq", "i"),
        site(u, "UX_FORM_COMPLEXITY", agg, "form_max >= 8", "'Long form with ' || form_max || ' fields'", "HTML_ELEMENT", "form_url", "'field_count=' || form_max", "form_url"),
        site("ARCHITECTURE", "ARCH_SINGLE_PAGE", agg, "pages <= 1", "'Site appears to consist of a single page'", None, "", "", "base_url"),
        site("ARCHITECTURE", "ARCH_DEEP_NESTING", agg, "mean_depth > 2.5", "'Pages require deep navigation (average depth ' || printf('%.1f', round(mean_depth, 1)) || ')'", None, "", "", "NULL"),
        site("SECURITY", "SEC_OBSERVABLE_API", found(r"/api/v?\d?/?"), "true", "'Observable API endpoints referenced in page code'", "URL", "base_url", "shown", "base_url"),
        site("SECURITY", "SEC_PUBLIC_EMAIL", found(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), "true", "'Public email address(es) exposed on the site'", "HTML_ELEMENT", "base_url", "shown", "base_url"),
        site("SECURITY", "SEC_EXPOSED_SECRET_PATTERN", keys, "true", "'Possible API key or secret pattern in page code'", "SCRIPT", "base_url", "shown", "base_url"),
        site(s, "SEO_DUPLICATE_TITLES", dup, "true", "'Duplicate page titles (' || n || ' page(s))'", "PAGE", "q.url", "q.title", "q.url"),
        site("CONTENT", "CONTENT_REPEATED", rep, "true", "'Repeated content across ' || n || ' page(s)'", "PAGE", "q.url", "n || ' pages share identical text prefix'", "q.url", "first_seq"),
        site("CONTENT", "CONTENT_POTENTIAL_SIMILARITY", f"SELECT * FROM simfirst{p}", "true", "'Potential content similarity between two pages'", "METRIC", "q.url_a",
             "'similarity_score=' || printf('%.2f', round(score, 2)) || ' vs ' || q.url_b", "q.url_a", "seq_a", "seq_b", "round(score, 2)"),
    ]
    ext = f"SELECT scan_id, domain, count(*) AS n, min(seq * 100 + ord) AS o FROM res{p} WHERE is_external AND domain <> '' GROUP BY scan_id, domain"
    analytics = ("google-analytics.com|googletagmanager.com|googleadservices.com|doubleclick.net|facebook.net|connect.facebook.net|analytics.tiktok.com"
                 "|ads.linkedin.com|snap.licdn.com|x.com|twitter.com|criteo.com|hotjar.com|clarity.ms|matomo.cloud|plausible.io|posthog.com|mixpanel.com"
                 "|segment.com|segment.io|amplitude.com|heap.io|mouseflow.com|fullstory.com|cookiebot.com|onetrust.com|consent.").replace(".", "\\.")
    social = "facebook.com|instagram.com|youtube.com|linkedin.com|pinterest.com|tiktok.com|x.com|twitter.com".replace(".", "\\.")

    def domains(pattern: str, keep: int) -> str:
        return (f"SELECT scan_id, count(*) AS n, substr(string_agg(domain, ', ' ORDER BY o) FILTER (r <= {keep}), 1, 1000) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY o) AS r"
                f" FROM ({ext}) WHERE regexp_matches(domain, {lit(pattern)})) GROUP BY scan_id")

    def urls(where: str, size: int) -> str:
        return (f"SELECT scan_id, count(*) AS n, substr(string_agg(url, ', ' ORDER BY seq, ord) FILTER (r <= 10), 1, {size}) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq, ord) AS r"
                f" FROM res{p} WHERE {where}) GROUP BY scan_id")

    counts = f"SELECT scan_id, count(*) AS n, count(*) FILTER (is_external) AS e FROM res{p} GROUP BY scan_id"
    cdn = f"SELECT b.scan_id, (SELECT count(*) FROM res{p} r WHERE r.scan_id = b.scan_id AND is_external AND regexp_matches(domain, 'cdn|cloudfront')) AS n FROM base{p} b"
    hints = ("gtag", "googletagmanager", "google-analytics", "fbevents", "fbq(", "fbq", "clarity", "hotjar", "analytics", "track", "segment",
             "amplitude", "mixpanel", "posthog", "plausible", "cookieconsent", "onetrust", "cmp")
    hint_rows = ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(hints))
    tracker = (f"SELECT scan_id, count(*) AS n, string_agg(h, ', ' ORDER BY i) AS shown FROM (SELECT DISTINCT scan_id, i, h FROM prof{p}, (VALUES {hint_rows}) v(i, h)"
               f" WHERE contains(lower(list_aggregate(inline_scripts, 'string_agg', chr(10))), h)) WHERE scan_id IN (SELECT scan_id FROM res{p} WHERE is_external AND domain <> '') GROUP BY scan_id")

    def large(rule_id: str, where: str, title: str) -> str:
        return site("PERFORMANCE", rule_id, f"SELECT * FROM res{p} WHERE {where}", "true", title, "RESOURCE", "q.url", "'size_bytes=' || size_bytes", "q.url", "seq", "ord")

    kib = "CAST(round(size_bytes / 1024) AS BIGINT)"
    resource_rules = [
        site("ARCHITECTURE", "ARCH_MANY_THIRD_PARTIES", domains(".", 15), "n >= 8", "'High number of third-party domains (' || n || ')'", "URL", "base_url", "shown", "NULL"),
        site("ARCHITECTURE", "ARCH_NO_CDN", cdn, "n = 0 AND pages > 1", "'No CDN usage detected'", None, "", "", "NULL"),
        site("PERFORMANCE", "PERF_TOO_MANY_REQUESTS", counts, "n >= 60", "'High number of resource requests (' || n || ')'", "METRIC", "'resources'", "'count=' || n", "NULL"),
        site("PERFORMANCE", "PERF_MANY_THIRD_PARTY_REQUESTS", counts, "e >= 10", "'High third-party request count (' || e || ')'", "METRIC", "'resources'", "'external_count=' || e", "NULL"),
        site("PERFORMANCE", "PERF_RENDER_BLOCKING_SCRIPTS", urls("resource_type = 'JS' AND NOT is_external", 100000), "n >= 4", "n || ' local scripts without async/defer detected'", "SCRIPT", "'html'", "shown", "NULL"),
        site("PRIVACY", "PRIV_ANALYTICS_THIRD_PARTIES", domains(analytics, 10), "true", "'Potential analytics-related third parties (' || n || ')'", "URL", "base_url", "shown", "NULL"),
        site("PRIVACY", "PRIV_SOCIAL_WIDGETS", domains(social, 10), "true", "'Potential social media widgets (' || n || ')'", "URL", "base_url", "shown", "NULL"),
        site("PRIVACY", "PRIV_TRACKER_SCRIPT_PATTERNS", tracker, "n >= 2", "'Potential tracking-related script patterns observed'", "SCRIPT", "base_url", "shown", "NULL"),
        site("SECURITY", "SEC_MIXED_CONTENT", urls("url LIKE 'http://%' AND url NOT LIKE 'http://localhost%'", 1000), "base_url LIKE 'https://%'", "'Mixed content: HTTP resources loaded by an HTTPS page'", "URL", "base_url", "shown", "NULL"),
        large("PERF_HUGE_RESOURCE", "size_bytes >= 2097152", "'Very large ' || lower(resource_type) || ' resource (' || printf('%.1f', round(size_bytes / 1048576, 1)) || ' MB)'"),
        large("PERF_LARGE_JS", "resource_type = 'JS' AND size_bytes >= 409600", f"'Large JavaScript file (' || {kib} || ' KB)'"),
        large("PERF_LARGE_CSS", "resource_type = 'CSS' AND size_bytes >= 204800", f"'Large CSS file (' || {kib} || ' KB)'"),
        large("PERF_LARGE_IMAGE", "resource_type = 'IMAGE' AND size_bytes >= 307200", f"'Oversized image (' || {kib} || ' KB)'"),
    ]
    shingle_source = f"SELECT scan_id, seq, url, regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') AS w FROM prof{p} WHERE text <> ''"
    return {
        f"cookies{p}": f"SELECT scan_id, seq, n, {X.COOKIE_NAME} AS name, {X.COOKIE_DOMAIN} AS domain, {X.COOKIE_SECURE} AS secure, {X.COOKIE_HTTPONLY} AS httponly FROM (SELECT scan_id, seq, page_id, unnest(range(0, page_id % 4)) AS n FROM px{p})",
        f"simwords{p}": shingle_source,
        f"simsh{p}": f"SELECT scan_id, seq, url, len(w) - 5 AS size, s, count(*) AS n FROM (SELECT *, unnest(list_transform(range(1, len(w) - 4), lambda k: array_to_string(w[k:k + 5], ' '))) AS s FROM simwords{p} WHERE len(w) >= 20) GROUP BY ALL",
        f"simpair{p}": f"""SELECT * FROM (SELECT a.scan_id, a.seq AS seq_a, b.seq AS seq_b, a.url AS url_a, b.url AS url_b, sum(least(a.n, b.n)) / (a.size + b.size - sum(least(a.n, b.n))) AS score
 FROM simsh{p} a JOIN simsh{p} b ON a.scan_id = b.scan_id AND a.s = b.s AND a.seq <> b.seq GROUP BY a.scan_id, a.seq, b.seq, a.url, b.url, a.size, b.size) WHERE score >= 0.55""",
        f"simreach{p}": f"SELECT scan_id, seq_a AS seq, seq_a AS other FROM simpair{p} UNION SELECT r.scan_id, r.seq, p.seq_b FROM simreach{p} r JOIN simpair{p} p ON p.scan_id = r.scan_id AND p.seq_a = r.other",
        f"simroot{p}": f"SELECT scan_id, seq, min(other) AS root FROM simreach{p} GROUP BY scan_id, seq",
        f"simfirst{p}": f"SELECT p.* FROM simpair{p} p JOIN simroot{p} r ON r.scan_id = p.scan_id AND r.seq = p.seq_b AND r.root = p.seq_a",
        f"draft_pages{p}": " UNION ALL ".join(page_rules),
        f"draft_home{p}": " UNION ALL ".join(home_rules),
        f"draft_site{p}": " UNION ALL ".join(site_rules),
        f"draft_res{p}": " UNION ALL ".join(resource_rules),
        f"fnd{p}": f"""SELECT d.scan_id, d.category, d.rule_id, c.rule_order, CAST(d.key1 AS BIGINT) AS key1, CAST(d.key2 AS BIGINT) AS key2, substr(d.title, 1, 500) AS title,
 c.severity, CAST(coalesce(d.conf, c.confidence) AS DOUBLE) AS confidence, c.impact, c.effort, d.affected_url, d.evidence_type, d.evidence_source, d.evidence_value,
 d.scan_id || '|' || d.category || '|' || d.rule_id || '|' || CAST(d.key1 AS BIGINT) || '|' || CAST(d.key2 AS BIGINT) AS finding_id, c.description
 FROM (SELECT * FROM draft_pages{p} UNION ALL SELECT * FROM draft_home{p} UNION ALL SELECT * FROM draft_site{p} UNION ALL SELECT * FROM draft_res{p}) d
 JOIN rulecat c ON c.category = d.category AND c.rule_id = d.rule_id""",
    }


def suffixed(ctes: dict[str, str], p: str) -> dict[str, str]:
    """The same building blocks over the pages of the second scan."""
    names = set(PARTS) | set(ctes)

    def rename(match: re.Match) -> str:
        return match.group(1) + (match.group(2) + p if match.group(2) in names else match.group(2))

    return {name + p: re.sub(r"((?:FROM|JOIN)\s+)(\w+)", rename, text) for name, text in ctes.items()}


def _build() -> dict[str, str]:
    catalog = ", ".join(
        f"({lit(r.category)}, {lit(r.rule_id)}, {r.order}, {lit(r.severity)}, {'NULL' if r.confidence is None else r.confidence},"
        f" {lit(r.impact)}, {lit(r.effort)}, {lit(r.description)})" for r in RULES.values()
    )
    parts = {
        "rulecat": f"SELECT * FROM (VALUES {catalog}) c(category, rule_id, rule_order, severity, confidence, impact, effort, description)",
        "px": _page_select(X.HOST, "url", X.FINAL_URL, "", ""),
        "px2": _page_select(f"{X.HOST} || '@2'", _CHANGED, _CHANGED, "; v2", ""),
        "res": _res_select("scan_id", ""),
        "res2": _res_select("scan_id || '@2'", ""),
        "websites": f"SELECT scan_id AS website_id, length(scan_id) % 3 AS user_id, 'https://' || scan_id || '/' AS normalized_url, {X.STARTED} + to_minutes(min(seq)) AS created_at FROM px GROUP BY scan_id",
        "scans": f"""SELECT website_id AS scan_id, website_id, {X.STARTED} AS started_at, 'COMPLETED' AS status, 'COMPLETED' AS stage FROM websites
 UNION ALL SELECT website_id || '@2', website_id, {X.RESTARTED}, CASE WHEN length(website_id) % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END,
 CASE WHEN length(website_id) % 5 = 0 THEN 'ANALYZING_SEO' ELSE 'COMPLETED' END FROM websites""",
        "competitors": """SELECT 'www:' || website_id AS competitor_id, website_id, 'https://www.' || website_id || '/' AS normalized_url FROM websites
 UNION ALL SELECT 'same:' || website_id, website_id, 'https://' || website_id || '/' FROM websites
 UNION ALL SELECT 'none:' || website_id, website_id, 'https://nobody.' || website_id || '/' FROM websites""",
    }
    for p in ("", "2"):
        parts |= _page_ctes(p) | _rule_ctes(p)
    return parts


PARTS = _build()
_HEAVY = re.compile(r"^(px|tok|run|text|prof|fnd|home|lnk|simsh|simpair|res)2?$")


def sql(final: str, **extra: str) -> str:
    """``final`` with the building blocks it names, and those they name, as CTEs."""
    if final.startswith("WITH"):
        return final
    parts = PARTS | extra
    names = re.compile(r"\b(" + "|".join(sorted(map(re.escape, parts), key=len, reverse=True)) + r")\b")
    done: dict[str, None] = {}
    opened: set[str] = set()

    def add(text: str) -> None:
        bare = re.sub(r"'(?:[^']|'')*'", "''", text)
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", bare)):
            if name in parts and name not in opened:  # a recursive part names itself
                opened.add(name)
                add(parts[name])
                done.setdefault(name)

    add(final)
    if not done:
        return final
    assert names
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS {'MATERIALIZED ' if _HEAVY.match(n) else ''}({parts[n]})" for n in done
    ) + "\n" + final


__all__ = ["sql", "join", "attr", "has_attr", "host_of", "lit", "rule", "PARTS"]
