"""Rules over resources: counts, external domains, largest files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.rules.base import emit, evidence, text, when
from pagequarry.operators.rules.catalog import rule
from pagequarry.operators.rules.pages import _ranked, tracker_hints_in

KIB = 1024
MANY_REQUESTS = 60
MANY_EXTERNAL_REQUESTS = 10
MANY_LOCAL_SCRIPTS = 4
MANY_DOMAINS = 8

# Domain parts that point to analytics and to social platforms.
ANALYTICS_NEEDLES = (
    "google-analytics.com", "googletagmanager.com", "googleadservices.com",
    "doubleclick.net", "facebook.net", "connect.facebook.net", "analytics.tiktok.com",
    "ads.linkedin.com", "snap.licdn.com", "x.com", "twitter.com", "criteo.com",
    "hotjar.com", "clarity.ms", "matomo.cloud", "plausible.io", "posthog.com",
    "mixpanel.com", "segment.com", "segment.io", "amplitude.com", "heap.io",
    "mouseflow.com", "fullstory.com", "cookiebot.com", "onetrust.com", "consent.",
)
SOCIAL_NEEDLES = (
    "facebook.com", "instagram.com", "youtube.com", "linkedin.com",
    "pinterest.com", "tiktok.com", "x.com", "twitter.com",
)

# Large-file rules as (rule id, type or any, least bytes).
LARGE_FILES = (
    ("PERF_HUGE_RESOURCE", None, 2 * KIB * KIB),
    ("PERF_LARGE_JS", "JS", 400 * KIB),
    ("PERF_LARGE_CSS", "CSS", 200 * KIB),
    ("PERF_LARGE_IMAGE", "IMAGE", 300 * KIB),
)


def matches_needle(domain: Column, needles: tuple[str, ...], strict: bool = False) -> Column:
    """Whether a domain contains a needle; ``strict`` asks for whole domain labels instead."""
    body = "|".join(re.escape(n) for n in needles)
    return domain.rlike(rf"(^|\.)({body})($|\.)" if strict else body)


def domain_facts(resources: DataFrame) -> DataFrame:
    """Counts per scan, domain and side: the first, skew-proof step of all resource counts."""
    size = F.coalesce("size_bytes", F.lit(0))

    def bytes_of(kind: str) -> Column:
        return F.sum(F.when(F.col("resource_type") == kind, size).otherwise(0))

    insecure = F.startswith("url", F.lit("http://")) & ~F.startswith("url", F.lit("http://localhost"))
    return resources.groupBy("scan_id", "domain", "is_external").agg(
        F.count(F.lit(1)).alias("requests"),
        F.min(F.struct("seq", "ord")).alias("first_seen"),
        F.sum(size).alias("total_bytes"),
        bytes_of("JS").alias("js_bytes"),
        bytes_of("CSS").alias("css_bytes"),
        bytes_of("IMAGE").alias("image_bytes"),
        bytes_of("FONT").alias("font_bytes"),
        F.count_if(F.col("resource_type") == "JS").alias("scripts"),
        F.count_if(insecure).alias("insecure"),
    )


def resource_facts(domains: DataFrame) -> DataFrame:
    """One row per scan from the per-domain counts; distinct domains need no second shuffle of resources."""
    named = F.col("is_external") & (F.coalesce("domain", F.lit("")) != "")
    external = F.col("is_external")
    return domains.groupBy("scan_id").agg(
        F.sum("requests").alias("requests"),
        F.sum(F.when(external, F.col("requests")).otherwise(0)).alias("external_requests"),
        F.sum(F.when(~external, F.col("scripts")).otherwise(0)).alias("local_scripts"),
        F.sum("insecure").alias("insecure"),
        F.count_if(named).alias("external_domains"),
        F.count_if(named & F.col("domain").rlike("cloudfront|cdn")).alias("cdn_domains"),
        F.count_if(named & matches_needle(F.col("domain"), ANALYTICS_NEEDLES)).alias("analytics_domains"),
        F.count_if(named & matches_needle(F.col("domain"), SOCIAL_NEEDLES)).alias("social_domains"),
        *[F.sum(c).alias(c) for c in ("total_bytes", "js_bytes", "css_bytes", "image_bytes", "font_bytes")],
    )


def external_domains(domains: DataFrame) -> DataFrame:
    """External domains of each scan with how many requests they got."""
    return domains.where(F.col("is_external") & (F.coalesce("domain", F.lit("")) != "")).select(
        "scan_id", "domain", F.col("requests").alias("resource_count"), "first_seen"
    )


def _lists(resources: DataFrame, domains: DataFrame) -> DataFrame:
    """Ordered value lists that findings show, as one map per scan."""
    insecure = F.startswith("url", F.lit("http://")) & ~F.startswith("url", F.lit("http://localhost"))
    local_js = (F.col("resource_type") == "JS") & ~F.col("is_external")
    kinds = F.filter(
        F.array(F.when(insecure, F.lit("insecure")), F.when(local_js, F.lit("local_js"))), lambda k: k.isNotNull()
    )
    urls = resources.select(
        "scan_id", "seq", F.col("ord").alias("pos"), F.col("url").alias("value"), F.explode(kinds).alias("kind")
    )
    name = F.col("domain")
    domain_kinds = F.filter(
        F.array(
            F.lit("domains"),
            F.when(matches_needle(name, ANALYTICS_NEEDLES), F.lit("analytics")),
            F.when(matches_needle(name, SOCIAL_NEEDLES), F.lit("social")),
        ),
        lambda k: k.isNotNull(),
    )
    names = external_domains(domains).select(
        "scan_id", F.col("first_seen.seq").alias("seq"), F.col("first_seen.ord").alias("pos"),
        F.col("domain").alias("value"), F.explode(domain_kinds).alias("kind"),
    )
    columns = ("scan_id", "kind", "seq", "pos", "value")
    ranked = _ranked(urls.select(*columns).unionByName(names.select(*columns)), 15)
    return ranked.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "items"))).alias("lists"))


def resource_rule_findings(resources: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings of the counting rules; ``facts`` are the page facts of the same scans."""
    domains = domain_facts(resources)
    per_scan = resource_facts(domains)
    joined = (
        facts.select("scan_id", "base_url", "pages", "tracker_mask")
        .join(per_scan, "scan_id", "left")
        .join(_lists(resources, domains), "scan_id", "left")
    )
    base = F.col("base_url")

    def items(kind: str, keep: int, limit: int = 1000) -> Column:
        return F.substring(F.array_join(F.slice(F.try_element_at("lists", F.lit(kind)), 1, keep), ", "), 1, limit)

    requests, external = F.col("requests"), F.col("external_requests")
    local, insecure = F.col("local_scripts"), F.col("insecure")
    domain_count = F.col("external_domains")
    hints = tracker_hints_in(F.col("tracker_mask"))
    resources_label = F.lit("resources")
    return emit(
        joined,
        [
            when(rule("ARCH_MANY_THIRD_PARTIES"), domain_count >= MANY_DOMAINS, text("High number of third-party domains (", domain_count, ")"),
                             evidence=evidence("URL", base, items("domains", 15, 10_000), count=domain_count)),
            when(rule("ARCH_NO_CDN"), (F.coalesce(F.col("cdn_domains"), F.lit(0)) == 0) & (F.col("pages") > 1), F.lit("No CDN usage detected")),
            when(rule("PERF_TOO_MANY_REQUESTS"), requests >= MANY_REQUESTS, text("High number of resource requests (", requests, ")"),
                             evidence=evidence("METRIC", resources_label, text("count=", requests), count=requests)),
            when(rule("PERF_MANY_THIRD_PARTY_REQUESTS"), external >= MANY_EXTERNAL_REQUESTS, text("High third-party request count (", external, ")"),
                             evidence=evidence("METRIC", resources_label, text("external_count=", external), count=external)),
            when(rule("PERF_RENDER_BLOCKING_SCRIPTS"), local >= MANY_LOCAL_SCRIPTS, text(local, " local scripts without async/defer detected"),
                             evidence=evidence("SCRIPT", F.lit("html"), items("local_js", 10, 100_000), count=local)),
            when(rule("PRIV_ANALYTICS_THIRD_PARTIES"), F.col("analytics_domains") > 0,
                             text("Potential analytics-related third parties (", F.col("analytics_domains"), ")"),
                             evidence=evidence("URL", base, items("analytics", 10))),
            when(rule("PRIV_SOCIAL_WIDGETS"), F.col("social_domains") > 0,
                             text("Potential social media widgets (", F.col("social_domains"), ")"),
                             evidence=evidence("URL", base, items("social", 10))),
            when(rule("PRIV_TRACKER_SCRIPT_PATTERNS"), (domain_count > 0) & (F.size(hints) >= 2), F.lit("Potential tracking-related script patterns observed"),
                             evidence=evidence("SCRIPT", base, F.array_join(F.slice(hints, 1, 10), ", "))),
            when(rule("SEC_MIXED_CONTENT"), F.startswith(base, F.lit("https://")) & (insecure > 0), F.lit("Mixed content: HTTP resources loaded by an HTTPS page"),
                             evidence=evidence("URL", base, items("insecure", 10), count=insecure)),
        ],
    )


def large_files(resources: DataFrame, most: int | None = None) -> DataFrame:
    """A finding for every large file of a scan, in crawl order; with ``most``, for the largest of each rule only.

    Without a limit nothing is ranked or shuffled. A limit is applied before the shuffle too.
    """
    size = F.coalesce("size_bytes", F.lit(0))
    classes = F.filter(
        F.array(*[
            F.when((size >= least) & (F.lit(kind is None) | (F.col("resource_type") == F.lit(kind))), F.lit(name))
            for name, kind, least in LARGE_FILES
        ]),
        lambda c: c.isNotNull(),
    )
    found = resources.select("scan_id", "seq", "ord", "url", "resource_type", "size_bytes", F.explode(classes).alias("rule"))
    if most is not None:
        order = Window.partitionBy("scan_id", "rule").orderBy(F.desc("size_bytes"), "seq", "ord")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    kib = F.round(F.col("size_bytes") / KIB).cast("bigint")
    mib = F.format_string("%.1f", F.round(F.col("size_bytes") / (KIB * KIB), 1))
    titles = {
        "PERF_HUGE_RESOURCE": text("Very large ", F.lower("resource_type"), " resource (", mib, " MB)"),
        "PERF_LARGE_JS": text("Large JavaScript file (", kib, " KB)"),
        "PERF_LARGE_CSS": text("Large CSS file (", kib, " KB)"),
        "PERF_LARGE_IMAGE": text("Oversized image (", kib, " KB)"),
    }
    shown = evidence("RESOURCE", F.col("url"), text("size_bytes=", F.col("size_bytes")),
                     size_bytes=F.col("size_bytes"), type=F.col("resource_type"))
    return emit(
        found,
        [when(rule(name), F.col("rule") == name, titles[name], F.col("url"), shown, key1=F.col("seq"), key2=F.col("ord")) for name, *_ in LARGE_FILES],
    )


def performance_metrics(facts: DataFrame, per_scan: DataFrame) -> DataFrame:
    """Byte and request totals of each scan; web vitals stay null since nothing measures them."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    joined = facts.join(per_scan, "scan_id", "left")
    other = zero("total_bytes") - zero("js_bytes") - zero("css_bytes") - zero("image_bytes") - zero("font_bytes")
    return joined.select(
        "scan_id",
        zero("total_bytes").alias("total_resource_bytes"), zero("js_bytes").alias("js_bytes"),
        zero("css_bytes").alias("css_bytes"), zero("image_bytes").alias("image_bytes"),
        zero("font_bytes").alias("font_bytes"), other.alias("other_bytes"),
        zero("requests").alias("request_count"), zero("external_requests").alias("third_party_request_count"),
        F.col("pages").alias("page_count"), F.round("avg_load", 3).alias("avg_page_load_seconds"),
        F.col("redirects").alias("redirect_count"),
        F.lit(None).cast("double").alias("lcp_seconds"), F.lit(None).cast("double").alias("cls_score"),
        F.lit(None).cast("double").alias("inp_milliseconds"), F.lit(False).alias("core_web_vitals_measured"),
    )


def site_metrics(facts: DataFrame) -> DataFrame:
    """Content, SEO and cookie totals of each scan."""
    return facts.select(
        "scan_id", F.col("total_words").cast("bigint").alias("total_words"), "pages_with_content", "pages_with_titles",
        F.col("link_count").cast("bigint").alias("total_internal_links"),
        F.size("home.cookies").cast("bigint").alias("cookie_count"),
    )
