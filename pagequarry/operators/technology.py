"""Technology detection from a table of signatures.

Signatures are data; each signal becomes one bit. Pages and resources turn into
bit masks row by row, masks combine with ``bit_or`` in a partial-then-final
aggregate, and names are read off the mask once per scan. Nothing is joined to the
signature table, so its size never meets the size of the crawl.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 60


@dataclass(frozen=True)
class Signature:
    """``clues`` are tried in order; each is (evidence text, ((signal, needle), ...)).

    Signals: html, html_ci, script, script_ci, url, cookie (name prefix),
    header:NAME (value contains, any case), has_header:NAME.
    """

    name: str
    category: str
    confidence: float
    clues: tuple[tuple[str, tuple[tuple[str, str], ...]], ...]


# Technologies, categories, confidences and what gives them away.
SIGNATURES: tuple[Signature, ...] = (
    Signature("WordPress", "CMS", 0.85, (
        ("wp-content or wp-includes references", (("html", "/wp-content/"), ("html", "/wp-includes/"), ("html", "wp-emoji"))),
        ("wp-* cookie", (("cookie", "wp-"),)),
        ("wordpress markup", (("html", 'id="wpcontent"'), ("html", 'class="wp-embed'))),
    )),
    Signature("Next.js", "Frontend Framework", 0.91, (("next.js markers", (("html", "__NEXT_DATA__"), ("html", "/_next/"))),)),
    Signature("Nuxt.js", "Frontend Framework", 0.9, (("nuxt markers", (("html", "__NUXT__"), ("html", "_nuxt"))),)),
    Signature("React", "Frontend Framework", 0.7, (
        ("react root markup", (("html", "data-reactroot"), ("html", 'id="root"'))),
        ("react script", (("script_ci", "react"),)),
    )),
    Signature("Vue.js", "Frontend Framework", 0.7, (("vue markers", (("html", "__VUE__"), ("html", "data-v-"))),)),
    Signature("jQuery", "JavaScript Library", 0.9, (("jquery script", (("script_ci", "jquery"),)),)),
    Signature("Bootstrap", "CSS Framework", 0.8, (
        ("bootstrap script", (("script_ci", "bootstrap"),)),
        ("bootstrap markup", (("html_ci", "bootstrap"),)),
    )),
    Signature("Tailwind CSS", "CSS Framework", 0.65, (
        ("tailwind script", (("script_ci", "tailwind"),)),
        ("tailwind-style classes", (("html", 'class="flex items-center'), ("html", 'class="grid grid-cols'))),
    )),
    Signature("Angular", "Frontend Framework", 0.75, (
        ("angular markers", (("html", "ng-app"), ("html", "ng-version"))),
        ("angular script", (("script_ci", "angular"),)),
    )),
    Signature("Google Analytics", "Analytics", 0.85, (
        ("gtag script", (("script", "gtag/js"), ("script", "googletagmanager"))),
        ("analytics reference", (("html", "google-analytics"), ("header_cs:set-cookie", "_ga"))),
        ("ga cookie", (("cookie", "_ga"),)),
    )),
    Signature("Cloudflare", "CDN / Proxy", 0.95, (
        ("cloudflare server header", (("header:server", "cloudflare"), ("has_header:cf-ray", ""))),)),
    Signature("Nginx", "Web Server", 1.0, (("nginx server header", (("header:server", "nginx"),)),)),
    Signature("Apache HTTP Server", "Web Server", 1.0, (("apache server header", (("header:server", "apache"),)),)),
    Signature("PHP", "Backend Language", 0.85, (
        ("php session cookie", (("cookie", "phpsessid"),)),
        ("x-powered-by header", (("header:x-powered-by", "php"),)),
    )),
    Signature("Django", "Backend Framework", 0.8, (
        ("django csrf cookie", (("cookie", "csrftoken"),)),
        ("server header", (("header:server", "django"),)),
    )),
    Signature("Flask", "Backend Framework", 0.85, (("werkzeug server header", (("header:server", "werkzeug"),)),)),
    Signature("Express", "Backend Framework", 0.8, (("x-powered-by header", (("header:x-powered-by", "express"),)),)),
    Signature("Shopify", "E-commerce Platform", 0.8, (
        ("shopify markup", (("html", "/cdn/shop/"), ("html_ci", "shopify"))),
        ("shopify header", (("filled_header:x-shopid", ""),)),
    )),
    Signature("Ghost", "CMS", 0.8, (
        ("ghost server header", (("header:server", "ghost"),)),
        ("ghost markup", (("html", "ghost-search"), ("html", 'content="Ghost"'))),
    )),
    Signature("ASP.NET", "Backend Framework", 0.8, (
        ("asp.net headers", (("has_header:aspnet", ""), ("filled_header:x-aspnet-version", ""))),
        ("asp.net session cookie", (("cookie", "asp.net_sessionid"),)),
    )),
    Signature("Amazon CloudFront", "CDN", 0.9, (
        ("cloudfront headers", (("header:via", "cloudfront"), ("header:server", "cloudfront"))),)),
    Signature("Google Fonts", "Resource CDN", 0.9, (
        ("google fonts resource", (("url", "fonts.googleapis.com"), ("url", "fonts.gstatic.com"))),)),
)


def _signals(signatures: tuple[Signature, ...], kinds: tuple[str, ...]) -> list[tuple[str, str]]:
    seen = dict.fromkeys(
        s for sig in signatures for _, signals in sig.clues for s in signals if s[0].split(":")[0] in kinds
    )
    return list(seen)


def _masks(tests: list[Column]) -> list[Column]:
    """Tests packed into bigint masks of 60 bits each."""
    out = []
    for start in range(0, len(tests), BITS):
        mask = F.lit(0).cast("bigint")
        for i, test in enumerate(tests[start:start + BITS]):
            mask = mask.bitwiseOR(F.when(test, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
        out.append(mask)
    return out


def _html_tests(signals: list[tuple[str, str]]) -> list[Column]:
    html, lower = F.coalesce("html", F.lit("")), F.lower(F.coalesce("html", F.lit("")))
    return [
        F.contains(lower, F.lit(n.lower())) if kind == "html_ci" else F.contains(html, F.lit(n)) for kind, n in signals
    ]


def _cookie_tests(signals: list[tuple[str, str]]) -> list[Column]:
    def has(prefix: str) -> Column:
        return F.exists("cookies", lambda c: F.startswith(F.lower(F.coalesce(c["name"], F.lit(""))), F.lit(prefix.lower())))

    return [has(n) for _, n in signals]


def _resource_tests(signals: list[tuple[str, str]]) -> list[Column]:
    is_script, lower = F.col("resource_type") == "JS", F.lower("url")
    tests = {
        "script": lambda n: is_script & F.contains(F.col("url"), F.lit(n)),
        "script_ci": lambda n: is_script & F.contains(lower, F.lit(n.lower())),
        "url": lambda n: F.contains(F.col("url"), F.lit(n)),
    }
    return [tests[kind](n) for kind, n in signals]


def _bit_of(prefix: str, position: int) -> Column:
    mask = F.coalesce(F.col(f"{prefix}_{position // BITS}"), F.lit(0).cast("bigint"))
    return mask.bitwiseAND(F.lit(1 << (position % BITS)).cast("bigint")) != 0


def technologies(pages: DataFrame, resources: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """One row per scan and technology: category, confidence, evidence.

    Header values are the home page's, else those of the last page that sent the
    header. Cookies are the home page's, or all pages' when the home page set none.
    """
    html = _signals(signatures, ("html", "html_ci"))
    cookies = _signals(signatures, ("cookie",))
    urls = _signals(signatures, ("script", "script_ci", "url"))
    headers = sorted({s[0].split(":")[1] for sig in signatures for _, ss in sig.clues for s in ss if ":" in s[0]})

    html_masks = _masks(_html_tests(html))
    cookie_masks = _masks(_cookie_tests(cookies))
    per_page = pages.select(
        "scan_id", "seq",
        *[m.alias(f"html_{i}") for i, m in enumerate(html_masks)],
        *[m.alias(f"cookie_{i}") for i, m in enumerate(cookie_masks)],
        (F.size("cookies") > 0).alias("sets_cookies"),
        *[F.try_element_at("headers", F.lit(h)).alias(f"header_{i}") for i, h in enumerate(headers)],
    )
    seq = F.col("seq")
    aggregated = per_page.groupBy("scan_id").agg(
        F.min_by("sets_cookies", seq).alias("home_cookies"),
        *[F.bit_or(f"html_{i}").alias(f"html_{i}") for i in range(len(html_masks))],
        *[F.bit_or(f"cookie_{i}").alias(f"all_cookie_{i}") for i in range(len(cookie_masks))],
        *[F.min_by(f"cookie_{i}", seq).alias(f"home_cookie_{i}") for i in range(len(cookie_masks))],
        *[F.min_by(f"header_{i}", seq).alias(f"home_header_{i}") for i in range(len(headers))],
        *[
            F.max_by(f"header_{i}", F.when(F.col(f"header_{i}").isNotNull(), seq)).alias(f"last_header_{i}")
            for i in range(len(headers))
        ],
    )
    resource_masks = _masks(_resource_tests(urls))
    by_resource = resources.select("scan_id", *[m.alias(f"url_{i}") for i, m in enumerate(resource_masks)]).groupBy(
        "scan_id"
    ).agg(*[F.bit_or(f"url_{i}").alias(f"url_{i}") for i in range(len(resource_masks))])
    merged = aggregated.join(by_resource, "scan_id", "left").select(
        "*",
        *[
            F.when(F.col("home_cookies"), F.col(f"home_cookie_{i}")).otherwise(F.col(f"all_cookie_{i}")).alias(f"cookie_{i}")
            for i in range(len(cookie_masks))
        ],
        *[F.coalesce(f"home_header_{i}", f"last_header_{i}").alias(f"header_{i}") for i in range(len(headers))],
    )

    def holds(signal: tuple[str, str]) -> Column:
        kind, _, name = signal[0].partition(":")
        if kind in ("html", "html_ci"):
            return _bit_of("html", html.index(signal))
        if kind == "cookie":
            return _bit_of("cookie", cookies.index(signal))
        if kind in ("script", "script_ci", "url"):
            return _bit_of("url", urls.index(signal))
        value = F.coalesce(F.col(f"header_{headers.index(name)}"), F.lit(""))
        if kind == "has_header":
            return F.col(f"header_{headers.index(name)}").isNotNull()
        if kind == "filled_header":
            return value != ""
        if kind == "header_cs":
            return F.contains(value, F.lit(signal[1]))
        return F.contains(F.lower(value), F.lit(signal[1].lower()))

    def detected(sig: Signature) -> Column:
        found = []
        for clue, signals in sig.clues:
            any_signal = holds(signals[0])
            for other in signals[1:]:
                any_signal = any_signal | holds(other)
            found.append(F.when(any_signal, F.lit(clue)))
        first = F.coalesce(*found)
        row = F.struct(
            F.lit(sig.name).alias("name"), F.lit(sig.category).alias("category"),
            F.lit(sig.confidence).alias("confidence"), first.alias("evidence"),
        )
        return F.when(first.isNotNull(), row)

    rows = F.filter(F.array(*[detected(s) for s in signatures]), lambda r: r.isNotNull())
    return merged.select("scan_id", F.inline(rows))
