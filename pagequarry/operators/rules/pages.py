"""Rules over page profiles: one fused aggregate per scan, then one projection.

The aggregate is partial before the shuffle, so a scan holding a third of all
pages sends one row per task. Every "first page with ..." is a ``min_by`` on the
crawl order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.extract import TRACKER_HINTS
from pagequarry.operators.rules.base import ScanRule, emit, evidence, text, when
from pagequarry.operators.rules.catalog import rule

THIN_WORDS = 150
DENSE_WORDS = 4000
LONG_TITLE = 65
LARGE_HTML_BYTES = 1.5 * 1024 * 1024
LONG_FORM_FIELDS = 8
NAV_LINKS = 12
HSTS_SECONDS = 15_552_000
HEADER_CHARS = 2000
COOKIE_NAMES = 8


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _page_tests() -> dict[str, tuple[Column, Column, Column]]:
    """Name -> (pages it holds for, how much each counts, text kept from the first)."""
    one, nothing = F.lit(1), F.lit("")
    url_stem = F.regexp_extract(F.col("url"), r"(?s)^([^?#]*)", 1)
    return {
        "no_title": (_blank(F.col("title")), one, nothing),
        "long_title": (~_blank(F.col("title")) & (F.length("title") > LONG_TITLE), one, F.col("title")),
        "no_description": (_blank(F.col("meta_description")), one, nothing),
        "no_canonical": (_blank(F.col("canonical_url")), one, nothing),
        "messy_url": (url_stem.rlike(r"(?U)[A-Z\s_]"), one, nothing),
        "broken": (F.col("status_code") >= 400, one, F.col("status_code").cast("string")),
        "noindex": (F.col("noindex_metas") > 0, F.col("noindex_metas"), nothing),
        "thin": (F.col("word_count") < THIN_WORDS, one, nothing),
        "no_headings": (F.col("has_html") & (F.col("h1_h2_count") == 0), one, nothing),
        "many_h1": (F.col("h1_count") > 1, one, nothing),
        "dense": (F.col("word_count") > DENSE_WORDS, one, F.col("word_count").cast("string")),
        "no_alt": (F.col("img_no_alt") > 0, F.col("img_no_alt"), F.col("img_no_alt_first")),
        "no_label": (F.col("unlabeled") > 0, F.col("unlabeled"), F.col("unlabeled_first")),
        "heading_skip": (F.col("heading_skips") > 0, F.col("heading_skips"), F.col("heading_skip_first")),
        "no_lang": (F.col("has_html") & ~F.col("has_html_lang"), one, nothing),
        "empty_link": (F.col("empty_links") > 0, F.col("empty_links"), F.col("empty_link_first")),
        "empty_button": (F.col("empty_buttons") > 0, F.col("empty_buttons"), nothing),
        "hidden_role": (F.col("hidden_role"), one, nothing),
        "unsized_img": (F.col("has_unsized_img"), one, nothing),
    }


def page_facts(profiles: DataFrame) -> DataFrame:
    """One row per scan with all counts, firsts and home-page facts the rules need."""
    home = F.struct(
        "url", "headers", "cookies", "has_html", "has_og_title", "nav_links", "has_cta_text", "has_button", "has_viewport",
    )
    sums = [
        F.count(F.lit(1)).alias("pages"),
        F.min_by(home, F.col("seq")).alias("home"),
        F.sum(F.size("internal_links")).alias("link_count"),
        F.sum(F.col("depth").cast("bigint")).alias("depth_sum"),
        F.sum("html_size").alias("html_bytes"),
        F.sum("json_ld_count").alias("json_ld_count"),
        F.sum(F.col("json_ld_count") - F.size("json_ld_bad")).alias("json_ld_valid"),
        F.max(F.col("mentions_privacy")).alias("mentions_privacy"),
        F.max(F.col("mentions_cookie")).alias("mentions_cookie"),
        F.max(F.col("mentions_consent")).alias("mentions_consent"),
        F.bit_or("tracker_mask").alias("tracker_mask"),
        F.sum(F.coalesce("word_count", F.lit(0))).alias("total_words"),
        F.count_if(F.coalesce("word_count", F.lit(0)) > 0).alias("pages_with_content"),
        F.count_if(F.coalesce("title", F.lit("")) != "").alias("pages_with_titles"),
        F.max("form_max").alias("form_max"),
        F.max_by("url", F.struct("form_max", (-F.col("seq")).alias("r"))).alias("form_url"),
        F.avg("load_time").alias("avg_load"),
        F.count_if((F.col("url") != F.col("final_url")) & F.col("status_code").isin(301, 302, 307, 308)).alias("redirects"),
    ]
    for name, (holds, weight, kept) in _page_tests().items():
        first = F.struct(F.col("url").alias("url"), kept.alias("value"))
        sums.append(
            F.struct(
                F.coalesce(F.sum(F.when(holds, weight)), F.lit(0)).cast("bigint").alias("n"),
                F.min_by(F.when(holds, first), F.when(holds, F.col("seq"))).alias("first"),
            ).alias(name)
        )
    return profiles.groupBy("scan_id").agg(*sums).withColumn("base_url", F.col("home.url"))


def _counted(
    rule_id: str, test: str, title: list, kind: str, value: Column | None = None, least: int = 1,
    category: str | None = None, counted: bool = False, site_wide: bool = False,
) -> ScanRule:
    n, first = F.col(test)["n"], F.col(test)["first"]
    url = F.col("base_url") if site_wide else first["url"]
    shown = F.coalesce(first["value"] if value is None else value, F.lit(""))
    meta = {"count": n} if counted else {}
    parts = [n if p is None else p for p in title]
    return when(rule(rule_id, category), n >= least, text(*parts), url, evidence(kind, url, shown, **meta))


def accessibility_rules() -> list[ScanRule]:
    el = "HTML_ELEMENT"
    return [
        _counted("A11Y_IMG_MISSING_ALT", "no_alt", ["Images missing alt text (", None, " found)"], el, counted=True),
        _counted("A11Y_FORM_FIELD_NO_LABEL", "no_label", ["Form fields without labels (", None, " found)"], el, counted=True),
        _counted("A11Y_HEADING_ORDER", "heading_skip", ["Heading hierarchy skips levels (", None, " instance(s))"], el,
                 counted=True, category="ACCESSIBILITY"),
        _counted("A11Y_HTML_LANG_MISSING", "no_lang", ["Document language is not declared"], el, F.lit("html[lang] missing")),
        _counted("A11Y_EMPTY_LINK", "empty_link", ["Links without accessible names (", None, " found)"], el, counted=True),
        _counted("A11Y_EMPTY_BUTTON", "empty_button", ["Buttons without accessible names (", None, " found)"], el,
                 F.lit("<button></button>"), counted=True),
        _counted("A11Y_ARIA_HIDDEN_FOCUSABLE", "hidden_role", ["Focusable elements inside aria-hidden containers"], el,
                 F.lit("focusable content inside aria-hidden")),
    ]


def content_rules() -> list[ScanRule]:
    return [
        _counted("CONTENT_NO_HEADINGS", "no_headings", ["Pages without heading structure (", None, ")"], "PAGE",
                 F.lit("no h1/h2 found")),
    ]


def performance_rules() -> list[ScanRule]:
    size = F.col("html_bytes")
    unsized = F.col("unsized_img")
    return [
        when(rule("PERF_LARGE_HTML"), size > LARGE_HTML_BYTES, F.lit("Large HTML payload"),
                    evidence=evidence("METRIC", F.lit("pages"), text("html_bytes=", size), bytes=size, pages=F.col("pages"))),
        _counted("PERF_IMAGES_NO_DIMENSIONS", "unsized_img",
                 ["Images missing width/height attributes on ", None, " page(s)"], "HTML_ELEMENT",
                 text("pages=", unsized["n"]), least=2),
    ]


def privacy_rules() -> list[ScanRule]:
    base = F.col("base_url")
    third = F.filter(F.col("home.cookies"), lambda c: F.coalesce(c["domain"] != "", F.lit(False)))
    return [
        when(rule("PRIV_PRIVACY_POLICY_MISSING"), ~F.col("mentions_privacy"), F.lit("No privacy policy reference detected"), base,
                    evidence("HTML_ELEMENT", base, F.lit("no privacy policy reference found"))),
        when(rule("PRIV_CONSENT_UI_NOT_OBSERVED"), F.col("mentions_cookie") & ~F.col("mentions_consent"), F.lit("Cookies observed but no consent UI signals detected"), base,
                    evidence("COOKIE", base, F.lit("cookie signals present"))),
        when(rule("PRIV_THIRD_PARTY_COOKIES"), F.size(third) > 0, text("Potential third-party cookies observed (", F.size(third), ")"), base,
                    evidence("COOKIE", base, _cookie_names(third), count=F.size(third))),
    ]


def _cookie_names(cookies: Column) -> Column:
    names = F.transform(F.slice(cookies, 1, COOKIE_NAMES), lambda c: c["name"])
    return F.substring(F.array_join(names, ", "), 1, 500)


def _header(name: str) -> Column:
    return F.nullif(F.try_element_at(F.col("home.headers"), F.lit(name)), F.lit(""))


def security_rules() -> list[ScanRule]:
    base = F.col("base_url")
    hsts, csp = _header("strict-transport-security"), _header("content-security-policy")
    powered, server = _header("x-powered-by"), _header("server")
    response = F.lit("response headers")

    def seen(header: str, value: Column) -> Column:
        return evidence("HTTP_HEADER", F.lit(header), F.substring(value, 1, HEADER_CHARS))

    def absent(what: str) -> Column:
        return evidence("HTTP_HEADER", response, F.lit(what))

    def cookie_rule(rule_id: str, title: str, flag: str) -> ScanRule:
        lacking = F.filter(F.col("home.cookies"), lambda c: ~F.coalesce(c[flag], F.lit(False)))
        return when(rule(rule_id), F.size(lacking) > 0, F.lit(title), evidence=evidence("COOKIE", base, _cookie_names(lacking), count=F.size(lacking)))

    max_age = F.regexp_extract(hsts, r"max-age=\s*([+-]?[0-9]+)\s*(?:;|$)", 1).try_cast("decimal(38,0)")
    frames = F.coalesce(F.contains(F.lower(csp), F.lit("frame-ancestors")), F.lit(False))
    return [
        when(rule("SEC_HTTPS_ABSENT"), F.startswith(base, F.lit("http://")), F.lit("Site is served over unencrypted HTTP"), base,
                         evidence("URL", base, F.lit("http:// scheme observed"))),
        when(rule("SEC_HSTS_MISSING"), hsts.isNull(), F.lit("HTTP Strict Transport Security (HSTS) header is missing"),
                         evidence=absent("strict-transport-security: (absent)")),
        when(rule("SEC_HSTS_NO_SUBDOMAINS"), ~F.contains(hsts, F.lit("includeSubDomains")), F.lit("HSTS does not include subdomains"),
                         evidence=seen("strict-transport-security", hsts)),
        when(rule("SEC_HSTS_SHORT_MAXAGE"), max_age < HSTS_SECONDS, F.lit("HSTS max-age is shorter than recommended (180 days)"),
                         evidence=seen("strict-transport-security", hsts)),
        when(rule("SEC_CSP_MISSING"), csp.isNull(), F.lit("Content Security Policy (CSP) header is missing"),
                         evidence=absent("content-security-policy: (absent)")),
        when(rule("SEC_CSP_UNSAFE_INLINE"), F.contains(F.lower(csp), F.lit("unsafe-inline")), F.lit("CSP allows 'unsafe-inline'"),
                         evidence=seen("content-security-policy", csp)),
        when(rule("SEC_CSP_UNSAFE_EVAL"), F.contains(F.lower(csp), F.lit("unsafe-eval")), F.lit("CSP allows 'unsafe-eval'"),
                         evidence=seen("content-security-policy", csp)),
        when(rule("SEC_XCTO_MISSING"), ~_header("x-content-type-options").eqNullSafe("nosniff"), F.lit("X-Content-Type-Options header is missing or not 'nosniff'"),
                         evidence=absent("x-content-type-options: (absent)")),
        when(rule("SEC_REFERRER_POLICY_MISSING"), _header("referrer-policy").isNull(), F.lit("Referrer-Policy header is missing"),
                         evidence=absent("referrer-policy: (absent)")),
        when(rule("SEC_PERMISSIONS_POLICY_MISSING"), _header("permissions-policy").isNull() & _header("feature-policy").isNull(), F.lit("Permissions-Policy header is missing"),
                         evidence=absent("permissions-policy: (absent)")),
        when(rule("SEC_FRAME_PROTECTION_MISSING"), ~frames & _header("x-frame-options").isNull(),
                         F.lit("No frame protection (X-Frame-Options / CSP frame-ancestors)"),
                         evidence=absent("x-frame-options: (absent); csp frame-ancestors: (absent)")),
        when(rule("SEC_TECH_DISCLOSURE"), powered.isNotNull(), F.lit("Server technology disclosed via X-Powered-By header"),
                         evidence=seen("x-powered-by", powered)),
        when(rule("SEC_SERVER_VERSION_DISCLOSURE"), (F.lower(server) != "cloudflare") & server.rlike(r"[0-9]+\.[0-9]+"), F.lit("Web server version disclosed"),
                         evidence=seen("server", server)),
        cookie_rule("SEC_COOKIE_MISSING_SECURE", "Cookies set without the Secure attribute", "secure"),
        cookie_rule("SEC_COOKIE_MISSING_HTTPONLY", "Cookies without the HttpOnly attribute", "httponly"),
    ]


def seo_rules() -> list[ScanRule]:
    base = F.col("base_url")
    blocks = F.col("json_ld_count")
    return [
        _counted("SEO_TITLE_MISSING", "no_title", ["Missing page title on ", None, " page(s)"], "PAGE", F.lit("no <title> tag")),
        _counted("SEO_TITLE_TOO_LONG", "long_title", ["Title exceeds recommended length on ", None, " page(s)"], "PAGE"),
        _counted("SEO_META_DESCRIPTION_MISSING", "no_description", ["Missing meta description on ", None, " page(s)"], "PAGE",
                 F.lit("no meta description")),
        _counted("SEO_CANONICAL_MISSING", "no_canonical", ["No canonical URL on ", None, " page(s)"], "PAGE",
                 F.lit("no canonical link"), least=2),
        when(rule("SEO_OG_MISSING"), F.col("home.has_html") & ~F.col("home.has_og_title"), F.lit("Open Graph tags not found on the homepage"), base,
                         evidence("HTML_ELEMENT", base, F.lit("og:title missing"))),
        when(rule("SEO_NO_INTERNAL_LINKS"), (F.col("link_count") == 0) & (F.col("pages") == 1), F.lit("No internal links detected"), base),
        _counted("SEO_URL_STRUCTURE", "messy_url", ["URLs with uppercase characters/underscores (", None, ")"], "URL",
                 F.lit("uppercase or underscore in path")),
        _counted("A11Y_HEADING_ORDER", "heading_skip", ["Heading hierarchy skips levels (", None, " instance(s))"],
                 "HTML_ELEMENT", counted=True, category="SEO"),
        when(rule("SEO_STRUCTURED_DATA_MISSING"), blocks == 0, F.lit("No structured data (JSON-LD) detected"), base),
        when(rule("SEO_STRUCTURED_DATA_PRESENT"), F.col("json_ld_valid") > 0, F.lit("Valid structured data detected"), base),
        _counted("SEO_NOINDEX_PAGES", "noindex", [None, " page(s) blocked from indexing (noindex)"], "HTML_ELEMENT",
                 text("noindex count=", F.col("noindex")["n"]), site_wide=True),
    ]


def ux_rules() -> list[ScanRule]:
    base = F.col("base_url")
    home = F.col("home")
    return [
        when(rule("UX_NAV_COMPLEXITY"), home["has_html"] & (home["nav_links"] >= NAV_LINKS), text("Navigation contains ", home["nav_links"], " links"), base,
                         evidence("HTML_ELEMENT", base, text("nav_links=", home["nav_links"]))),
        when(rule("UX_NO_CTA"), home["has_html"] & ~home["has_cta_text"] & ~home["has_button"], F.lit("No clear call-to-action detected on the homepage"), base,
                         evidence("HTML_ELEMENT", base, F.lit("no CTA found"))),
        when(rule("UX_FORM_COMPLEXITY"), F.col("form_max") >= LONG_FORM_FIELDS, text("Long form with ", F.col("form_max"), " fields"), F.col("form_url"),
                         evidence("HTML_ELEMENT", F.col("form_url"), text("field_count=", F.col("form_max")))),
        when(rule("UX_NO_VIEWPORT"), home["has_html"] & ~home["has_viewport"], F.lit("Mobile viewport meta tag is missing"), base,
                         evidence("HTML_ELEMENT", base, F.lit("no viewport meta"))),
        _counted("UX_MULTIPLE_H1", "many_h1", ["Multiple H1 headings on ", None, " page(s)"], "HTML_ELEMENT", F.lit("multiple h1")),
        _counted("UX_CONTENT_DENSITY", "dense", ["Very dense content on ", None, " page(s)"], "PAGE",
                 text("words=", F.col("dense")["first"]["value"])),
    ]


def architecture_rules() -> list[ScanRule]:
    base = F.col("base_url")
    mean_depth = F.col("depth_sum") / F.col("pages")
    return [
        when(rule("ARCH_SINGLE_PAGE"), F.col("pages") <= 1, F.lit("Site appears to consist of a single page"), base),
        when(rule("ARCH_DEEP_NESTING"), mean_depth > 2.5,
                         text("Pages require deep navigation (average depth ",
                              F.format_string("%.1f", F.round(mean_depth, 1)), ")")),
    ]


def page_rule_findings(facts: DataFrame) -> DataFrame:
    """Findings of every rule that page facts alone decide."""
    return emit(
        facts,
        accessibility_rules() + architecture_rules() + content_rules() + performance_rules()
        + privacy_rules() + security_rules() + seo_rules() + ux_rules(),
    )


def tracker_hints_in(mask: Column) -> Column:
    """The hints whose bits are set, in their fixed order."""
    found = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(h)) for i, h in enumerate(TRACKER_HINTS)])
    return F.filter(found, lambda h: h.isNotNull())


def unclear_purpose(profiles: DataFrame, most: int | None = None) -> DataFrame:
    """Pages with neither title nor first-level heading; with ``most``, among a scan's first pages."""
    pages = profiles.select("scan_id", "seq", "url", "title", "h1_count", "has_html")
    if most is not None:
        pages = pages.withColumn("nth", F.row_number().over(Window.partitionBy("scan_id").orderBy("seq"))).where(F.col("nth") <= most)
    unclear = F.col("has_html") & (F.col("h1_count") == 0) & (F.coalesce("title", F.lit("")) == "")
    per_scan = pages.where(unclear).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("url", "seq").alias("url")
    )
    url = F.col("url")
    return emit(per_scan, [
        when(rule("UX_UNCLEAR_PURPOSE"), True, text("Unclear page purpose on ", F.col("n"), " page(s)"), url,
             evidence("PAGE", url, F.lit("no title and no h1"))),
    ])


def _ranked(hits: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` hits of each scan and kind, as one ordered list."""
    order = Window.partitionBy("scan_id", "kind").orderBy("seq", "pos")
    top = hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)
    listed = top.groupBy("scan_id", "kind").agg(
        F.sort_array(F.collect_list(F.struct("rn", "value"))).alias("rows")
    )
    return listed.withColumn("items", F.transform("rows", lambda r: r["value"])).drop("rows")


def listed_pages(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """Thin and broken page findings; their metadata names the first ten pages."""
    entries = F.filter(
        F.array(
            F.when(
                F.col("word_count") < THIN_WORDS,
                F.struct(F.lit("thin").alias("kind"), text(F.col("url"), " (", F.col("word_count"), "w)").alias("value")),
            ),
            F.when(
                F.col("status_code") >= 400,
                F.struct(F.lit("broken").alias("kind"), text(F.col("url"), " ", F.col("status_code")).alias("value")),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    hits = profiles.select("scan_id", "seq", F.inline(entries)).withColumn("pos", F.lit(0))
    joined = facts.select("scan_id", "thin", "broken").join(_ranked(hits, 10), "scan_id")
    kind, listed = F.col("kind"), F.array_join("items", ", ")
    named = F.substring(F.array_join(F.slice("items", 1, 5), ", "), 1, 1000)
    thin, broken = F.col("thin"), F.col("broken")
    thin_url, broken_url = thin["first"]["url"], broken["first"]["url"]
    return emit(
        joined,
        [
            when(rule("CONTENT_THIN"), kind == "thin", text("Thin content on ", thin["n"], " page(s)"), thin_url,
                             evidence("PAGE", thin_url, named, pages=listed)),
            when(rule("SEO_BROKEN_PAGES"), kind == "broken", text("Pages returning errors (", broken["n"], ")"), broken_url,
                             evidence("PAGE", broken_url, text("status ", broken["first"]["value"]), urls=listed)),
        ],
    )


def exposure(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """API paths, e-mail addresses and key-like text found anywhere in a site's html."""
    values = profiles.select(
        "scan_id",
        F.explode(
            F.concat(
                F.transform("api_paths", lambda v: F.struct(F.lit("api").alias("kind"), v.alias("value"))),
                F.transform("emails", lambda v: F.struct(F.lit("email").alias("kind"), v.alias("value"))),
            )
        ).alias("x"),
    ).select("scan_id", "x.*")
    order = Window.partitionBy("scan_id", "kind").orderBy("value")
    top = (
        values.distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 5)
        .groupBy("scan_id", "kind").agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("shown"))
    )
    secrets = profiles.select("scan_id", "seq", F.posexplode("secret_keywords").alias("pos", "value")).select(
        "scan_id", F.lit("secret").alias("kind"), "seq", "pos", "value"
    )
    listed = _ranked(secrets, 3)
    quoted = F.transform("items", lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    keys = listed.select("scan_id", "kind", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("shown"))
    hits = top.unionByName(keys).join(facts.select("scan_id", "base_url"), "scan_id")
    base, shown, kind = F.col("base_url"), F.col("shown"), F.col("kind")
    return emit(
        hits,
        [
            when(rule("SEC_OBSERVABLE_API"), kind == "api",
                     F.lit("Observable API endpoints referenced in page code"), base, evidence("URL", base, shown)),
            when(rule("SEC_PUBLIC_EMAIL"), kind == "email",
                     F.lit("Public email address(es) exposed on the site"), base, evidence("HTML_ELEMENT", base, shown)),
            when(rule("SEC_EXPOSED_SECRET_PATTERN"), kind == "secret",
                     F.lit("Possible API key or secret pattern in page code"), base, evidence("SCRIPT", base, shown)),
        ],
    )


def invalid_json_ld(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """One finding per JSON-LD block that is not JSON."""
    bad = profiles.select("scan_id", "seq", F.explode("json_ld_bad").alias("block"))
    joined = bad.join(facts.select("scan_id", "base_url"), "scan_id")
    base = F.col("base_url")
    return emit(joined, [
        when(rule("SEO_STRUCTURED_DATA_INVALID"), True, F.lit("Invalid JSON-LD structured data"), base,
             evidence("HTML_ELEMENT", base, F.lit("invalid application/ld+json")), key1=F.col("seq"), key2=F.col("block")),
    ])
