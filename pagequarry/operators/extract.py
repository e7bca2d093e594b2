"""From raw pages to page profiles, links, resources, metas and scripts.

Everything here is row-local: one input page gives one profile row (or an
exploded list), and no step needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import markup as M
from pagequarry.functions import text as TX
from pagequarry.functions import urls as U
from pagequarry.functions.binding import let
from pagequarry.operators import dom

# What a resource URL's ending says, link relations that load
# something, and link targets that are not pages.
CSS_ENDING = r"(?i)\.css($|\?)"
FONT_ENDING = r"(?i)\.(woff2?|ttf|otf|eot)($|\?)"
LOADING_RELATIONS = ("stylesheet", "preload", "prefetch", "modulepreload", "icon")
SKIPPED_TARGETS = r"^(#|mailto:|tel:|javascript:|data:)"
JSON_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
# Strings, numbers, words, brackets, blanks; any other character is a token that fits nowhere.
JSON_TOKEN = (
    r"""(?s)"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+\""""
    r"""|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null|NaN|-?Infinity|[ \t\n\r]++|."""
)
ROBOTS_META = r'(?i)<meta\s+name="robots"\s+content="([^"]*)"'
API_PATH = r"/api/v?\d?/?"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SECRET = r"""(?i)(api[_-]?key|secret|token|password)\s*[=:]\s*['"][A-Za-z0-9_\-]{12,}['"]"""
INLINE_SCRIPT = r"(?is)<script\b((?:(?!\ssrc\s*=)[^>])*)>(.*?)</script\s*>"

DESCRIPTION_CHARS = 500
OPENING_CHARS = 400


def _last_of_name(entries: Column) -> Callable[[Column, Column], Column]:
    """Of header names that differ in case alone, the last counts."""
    return lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])


COOKIE_FIELDS = {"name": "string", "domain": "string", "secure": "boolean", "httponly": "boolean"}


def _cookies(raw: DataFrame) -> Column:
    """Cookies by field name, whatever other fields they have and in whatever order; missing fields are null."""
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in COOKIE_FIELDS.items()) + ">>"
    if "cookies" not in raw.columns:
        return F.array().cast(kind)
    given = {f.name.lower(): f.name for f in getattr(getattr(raw.schema["cookies"].dataType, "elementType", None), "fields", [])}
    if not given:
        return F.col("cookies").cast(kind)

    def field(cookie: Column, name: str) -> Column:
        return (cookie[given[name]] if name in given else F.lit(None)).cast(COOKIE_FIELDS[name]).alias(name)

    return F.transform("cookies", lambda c: F.struct(*[field(c, n) for n in COOKIE_FIELDS])).cast(kind)


def page_rows(raw: DataFrame) -> DataFrame:
    """Build page rows: lower-case header names; only html content is kept for parsing.

    ``raw`` has scan_id, seq, url and html; status_code, content_type, depth,
    load_time, headers, cookies and final_url are optional.
    """
    have = set(raw.columns)

    def column(name: str, kind: str, default: Column) -> Column:
        return (F.col(name) if name in have else default).cast(kind).alias(name)

    headers = (
        let(
            F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))),
            lambda entries: F.map_from_entries(F.filter(entries, _last_of_name(entries))),
        )
        if "headers" in have
        else F.create_map().cast("map<string,string>")
    )
    is_html = U.is_html_content_type(F.col("content_type")) if "content_type" in have else F.lit(True)
    return raw.select(
        F.col("scan_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("url"),
        column("final_url", "string", F.col("url")),
        column("status_code", "int", F.lit(200)),
        column("content_type", "string", F.lit("text/html")),
        column("depth", "int", F.lit(0)),
        column("load_time", "double", F.lit(None)),
        headers.alias("headers"),
        _cookies(raw).alias("cookies"),
        F.octet_length("html").cast("bigint").alias("html_size"),
        F.when(is_html, F.col("html")).alias("html"),
    )


def title(html: Column) -> Column:
    """First title, entities decoded and white space collapsed; null when there is no title tag."""
    found = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.when(
        html.rlike(r"(?i)<title\b"), TX.normalize_whitespace(TX.decode_entities(found))
    )


def meta_description(tokens: Column) -> Column:
    first = F.get(F.filter(tokens, lambda t: M.opens(t, "meta") & (M.attr(t, "name") == "description")), F.lit(0))
    value = F.substring(F.trim(M.attr(first, "content")), 1, DESCRIPTION_CHARS)
    return F.when(M.filled(M.attr(first, "content")), value)


def canonical_url(tokens: Column, page_url: Column) -> Column:
    first = F.get(
        F.filter(
            tokens,
            lambda t: M.opens(t, "link")
            & F.coalesce(F.array_contains(F.split(F.lower(M.attr(t, "rel")), r"\s+"), "canonical"), F.lit(False)),
        ),
        F.lit(0),
    )
    return F.when(M.filled(M.attr(first, "href")), U.join_url(page_url, M.attr(first, "href")))


def internal_links(tokens: Column, page_url: Column) -> Column:
    """Distinct same-host page links in order of appearance, fragments cut."""
    hrefs = F.transform(
        F.filter(tokens, lambda t: M.opens(t, "a") & M.attr(t, "href").isNotNull()),
        lambda t: U.clean_link(M.attr(t, "href")),
    )
    wanted = F.filter(hrefs, lambda h: (h != "") & ~h.rlike(SKIPPED_TARGETS))

    def of(base: Column) -> Column:
        resolved = F.transform(wanted, lambda h: U.strip_fragment(U.resolve(base["parts"], h)))
        return F.array_distinct(
            F.filter(
                resolved,
                lambda u: U.scheme_of(u).isin("http", "https")
                & let(U.hostname_of(u), lambda host: (host != "") & (host == base["host"])),
            )
        )

    return let(F.struct(U.base_parts(page_url).alias("parts"), U.hostname_of(page_url).alias("host")), of)


# Elements that load something, in the order their resources are
# listed: rank, attribute, type.
_RESOURCE_TAGS = {
    "link": (0, "href", None),
    "script": (1, "src", "JS"),
    "img": (2, "src", "IMAGE"),
    "source": (3, "src", "IMAGE"),
    "video": (4, "src", "VIDEO"),
    "audio": (5, "src", "VIDEO"),
    "iframe": (6, "src", "OTHER"),
}


def _relation(t: Column) -> Column:
    return F.lower(F.coalesce(F.get(F.split(M.attr(t, "rel"), r"\s+"), F.lit(0)), F.lit("")))


def _resource_row(t: Column, pos: Column, parts: Column) -> Column:
    """Struct (rank, pos, url, resource_type) of one resource-loading tag, else null."""
    tag = t["tag"]
    rank = F.coalesce(*[F.when(tag == name, F.lit(r)) for name, (r, _, _) in _RESOURCE_TAGS.items()])
    source = U.clean_link(F.when(tag == "link", M.attr(t, "href")).otherwise(M.attr(t, "src")))

    def of(url: Column) -> Column:
        kind = (
            F.when((tag == "link") & (_relation(t) == "icon"), "IMAGE")
            .when((tag == "link") & ((_relation(t) == "stylesheet") | url.rlike(CSS_ENDING)), "CSS")
            .when(tag.isin("img", "source") & url.rlike(FONT_ENDING), "FONT")
            .when(tag == "script", "JS")
            .when(tag.isin("img", "source"), "IMAGE")
            .when(tag.isin("video", "audio"), "VIDEO")
            .otherwise("OTHER")
        )
        row = F.struct(rank.alias("rank"), pos.alias("pos"), url.alias("url"), kind.alias("resource_type"))
        return F.when(U.hostname_of(url) != "", row)

    loads = ~t["is_close"] & (source != "") & ~F.startswith(source, F.lit("data:"))
    wanted = (tag != "link") | _relation(t).isin(*LOADING_RELATIONS)
    return F.when(loads & wanted, let(U.resolve(parts, source), of))


def resource_list(tokens: Column, page_url: Column) -> Column:
    """Resources of a page; the first type seen for a URL wins, in the fixed order of element kinds."""
    tagged = F.filter(tokens, lambda t: t["tag"].isin(*_RESOURCE_TAGS))
    rows = let(
        U.base_parts(page_url),
        lambda parts: F.transform(tagged, lambda t, i: _resource_row(t, i, parts)),
    )
    ordered = F.array_sort(F.filter(rows, lambda r: r.isNotNull()))
    start = F.struct(
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<struct<url:string,resource_type:string>>").alias("kept"),
    )

    def keep_first(acc: Column, r: Column) -> Column:
        new = ~F.array_contains(acc["seen"], r["url"])
        row = F.struct(r["url"].alias("url"), r["resource_type"].alias("resource_type"))
        return F.struct(
            F.when(new, F.array_append(acc["seen"], r["url"])).otherwise(acc["seen"]).alias("seen"),
            F.when(new, F.array_append(acc["kept"], row)).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(ordered, start, keep_first, lambda acc: acc["kept"])


def inline_scripts(html: Column) -> Column:
    """Bodies of scripts without src, stripped, blanks dropped."""
    bodies = F.regexp_extract_all(html, F.lit(INLINE_SCRIPT), F.lit(2))
    stripped = F.transform(bodies, lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda b: b != "")


def _found(text: Column, pattern: str, group: int, possible: Column) -> Column:
    """All matches of a pattern, searched for only where a cheap test says there can be any."""
    return F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def api_paths(text: Column) -> Column:
    return F.array_distinct(_found(text, API_PATH, 0, F.contains(text, F.lit("/api"))))


def emails(text: Column) -> Column:
    return F.array_distinct(_found(text, EMAIL, 0, F.contains(text, F.lit("@"))))


def secret_keywords(text: Column) -> Column:
    """Keywords of key-like assignments, in order; the values themselves are not kept."""
    return _found(text, SECRET, 1, let(F.lower(text), lambda t: TX.contains_any(t, ("api", "secret", "token", "password"))))


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))


def json_is_valid(block: Column) -> Column:
    """Whether the whole text is one JSON value. Keys may repeat, and NaN and the infinities count as numbers.

    The text is cut into tokens, and a fold over them carries the open brackets and what may come next: a value (v), an
    element or the end of the list (f), a key or the end of the object (k), a key (K), a colon (c), or the end of a
    value (e). Whatever fits nowhere ends in x.
    """
    found = F.filter(F.regexp_extract_all(block, F.lit(JSON_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^[ \t\n\r]"))
    first = F.struct(F.lit("").alias("open"), F.lit("v").alias("next"))

    def after(s: Column, t: Column) -> Column:
        head, now, top = F.substring(t, 1, 1), s["next"], F.substring(s["open"], -1, 1)
        outer = F.left(s["open"], F.length(s["open"]) - 1)
        value = now.isin("v", "f")
        text = (head == '"') & (F.length(t) > 1)
        plain = t.rlike(r"^(-?[0-9]|true$|false$|null$|NaN$|-?Infinity$)")
        opens = value & head.isin("{", "[")
        closes = ((head == "}") & (top == "{") & now.isin("k", "e")) | ((head == "]") & (top == "[") & now.isin("f", "e"))
        following = (
            F.when(opens, F.when(head == "{", "k").otherwise("f"))
            .when(closes | (value & (text | plain)), "e")
            .when(text & now.isin("k", "K"), "c")
            .when((head == ":") & (now == "c"), "v")
            .when((head == ",") & (now == "e") & (top == "{"), "K")
            .when((head == ",") & (now == "e") & (top == "["), "v")
            .otherwise("x")
        )
        return F.struct(F.when(opens, F.concat(s["open"], head)).when(closes, outer).otherwise(s["open"]).alias("open"), following.alias("next"))

    return F.aggregate(found, first, after, lambda s: (s["open"] == "") & (s["next"] == "e"))


def page_profiles(pages: DataFrame) -> DataFrame:
    """One row per page with every fact the rules read. ``html`` stays behind here."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # Columns used several times are projected first, so each is computed once.
    staged = pages.select(
        "*", M.tokens(F.col("html")).alias("tokens"), F.lower(html).alias("lower_html"),
        F.lower(F.array_join(inline_scripts(html), "\n")).alias("lower_scripts"),
    ).withColumn("scoped", dom.scoped_facts("tokens"))
    tok, lower = F.col("tokens"), F.col("lower_html")
    has_html = F.coalesce(F.col("html") != "", F.lit(False))
    noindex = F.filter(
        _found(html, ROBOTS_META, 1, F.contains(lower, F.lit("robots"))), lambda c: F.contains(F.lower(c), F.lit("noindex"))
    )
    first = staged.select(
        "scan_id", "seq", "url", "final_url", "status_code", "content_type", "depth", "load_time",
        "headers", "cookies", "html_size", has_html.alias("has_html"),
        F.when(has_html, title(html)).alias("title"),
        meta_description(tok).alias("meta_description"),
        canonical_url(tok, F.col("final_url")).alias("canonical_url"),
        F.when(has_html, TX.visible_text(html)).alias("text"),
        internal_links(tok, F.col("final_url")).alias("internal_links"),
        *[value.alias(name) for name, value in dom.flat_facts("tokens").items()],
        F.col("scoped"),
        F.when(F.contains(lower, F.lit("application/ld+json")), json_ld_blocks(html))
        .otherwise(F.array().cast("array<string>")).alias("json_ld"),
        F.size(noindex).alias("noindex_metas"),
        F.contains(html, F.lit("og:title")).alias("has_og_title"),
        F.contains(lower, F.lit("privacy")).alias("mentions_privacy"),
        F.contains(lower, F.lit("cookie")).alias("mentions_cookie"),
        TX.contains_any(lower, CONSENT_HINTS).alias("mentions_consent"),
        api_paths(html).alias("api_paths"),
        emails(html).alias("emails"),
        secret_keywords(html).alias("secret_keywords"),
        hint_mask(F.col("lower_scripts"), TRACKER_HINTS).alias("tracker_mask"),
    )
    validity = F.transform(F.col("json_ld"), json_is_valid)
    return first.select(
        *[c for c in first.columns if c not in ("scoped", "json_ld")],
        "scoped.*",
        F.when(F.col("has_html"), TX.words_of_normalized(F.col("text"))).alias("word_count"),
        F.when(F.coalesce(F.col("text") != "", F.lit(False)), F.sha2(F.substring("text", 1, OPENING_CHARS), 256)).alias("opening_sha"),
        F.size("json_ld").alias("json_ld_count"),
        F.filter(
            F.transform(validity, lambda ok, i: F.when(~ok, i)), lambda i: i.isNotNull()
        ).alias("json_ld_bad"),
        let(F.lower(F.coalesce("text", F.lit(""))), lambda t: TX.contains_any(t, CTA_HINTS)).alias("has_cta_text"),
    )


# Phrases looked for in page text, html and scripts.
CTA_HINTS = (
    "get started", "sign up", "signup", "buy now", "start free", "download",
    "register", "subscribe", "try for free", "join",
)
CONSENT_HINTS = (
    "cookie consent", "cookiepolicy", "cookie-policy", "accept cookies",
    "consent", "onetrust", "cookiebot", "cmp-widget",
)
TRACKER_HINTS = (
    "gtag", "googletagmanager", "google-analytics", "fbevents", "fbq(",
    "fbq", "clarity", "hotjar", "analytics", "track", "segment", "amplitude",
    "mixpanel", "posthog", "plausible", "cookieconsent", "onetrust", "cmp",
)


def hint_mask(text: Column, hints: tuple[str, ...]) -> Column:
    """Bit i is set when ``hints[i]`` occurs; masks of pages combine with bit_or."""
    mask = F.lit(0).cast("bigint")
    for i, hint in enumerate(hints):
        mask = mask.bitwiseOR(F.when(F.contains(text, F.lit(hint)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return mask


def elements(pages: DataFrame) -> DataFrame:
    """The token table: one row per tag, in page order."""
    return pages.select("scan_id", "seq", F.posexplode(M.tokens(F.col("html"))).alias("pos", "t")).select(
        "scan_id", "seq", F.col("pos").cast("bigint").alias("pos"), "t.is_close", "t.tag", "t.attrs", "t.text"
    )


def links(pages: DataFrame) -> DataFrame:
    """One row per distinct internal link of a page, ``pos`` giving the order."""
    base = F.coalesce(F.col("final_url"), F.col("url"))
    found = pages.withColumn("tokens", M.tokens(F.col("html"))).select(
        "scan_id", "seq", "url", F.posexplode(internal_links(F.col("tokens"), base)).alias("pos", "link")
    )
    return found.withColumn("pos", F.col("pos").cast("bigint"))


def resources(pages: DataFrame, inline_per_page: int | None = None) -> DataFrame:
    """Referenced resources, then inline scripts (the first ``inline_per_page``, if given) as JS rows carrying the page's own URL."""
    base = F.coalesce(F.col("final_url"), F.col("url"))
    listed = F.transform(
        resource_list(F.col("tokens"), base),
        lambda r: F.struct(r["url"].alias("url"), r["resource_type"].alias("resource_type"), F.lit(False).alias("is_inline")),
    )
    scripts = inline_scripts(F.coalesce(F.col("html"), F.lit("")))
    inline = F.transform(
        scripts if inline_per_page is None else F.slice(scripts, 1, inline_per_page),
        lambda _b: F.struct(F.col("url").alias("url"), F.lit("JS").alias("resource_type"), F.lit(True).alias("is_inline")),
    )
    staged = pages.withColumn("tokens", M.tokens(F.col("html")))
    out = staged.select(
        "scan_id", "seq", U.hostname_of(F.col("url")).alias("page_host"),
        F.posexplode(F.concat(listed, inline)).alias("ord", "r"),
    )
    domain = U.hostname_of(F.col("r.url"))
    return out.select(
        "scan_id", "seq", F.col("ord").cast("bigint").alias("ord"), F.col("r.url").alias("url"),
        F.col("r.resource_type").alias("resource_type"), F.col("r.is_inline").alias("is_inline"),
        domain.alias("domain"), (~F.col("r.is_inline") & (domain != F.col("page_host"))).alias("is_external"),
    )


def script_urls(pages: DataFrame) -> DataFrame:
    """Every script src, resolved, repeats kept."""
    staged = pages.withColumn("tokens", M.tokens(F.col("html")))
    tags = F.filter(F.col("tokens"), lambda t: M.opens(t, "script") & M.filled(M.attr(t, "src")))
    sources = let(
        U.base_parts(F.col("url")),
        lambda parts: F.transform(tags, lambda t: U.resolve(parts, U.clean_link(M.attr(t, "src")))),
    )
    return staged.select("scan_id", "seq", F.posexplode(sources).alias("pos", "script_url")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def meta_tags(pages: DataFrame) -> DataFrame:
    """(name or http-equiv, content, property) of every meta tag; '' where absent."""
    staged = pages.withColumn("tokens", M.tokens(F.col("html")))

    def triple(t: Column) -> Column:
        name = F.coalesce(F.nullif(M.attr(t, "name"), F.lit("")), M.attr(t, "http-equiv"), F.lit(""))
        return F.struct(
            name.alias("name"),
            F.coalesce(M.attr(t, "content"), F.lit("")).alias("content"),
            F.coalesce(M.attr(t, "property"), F.lit("")).alias("property"),
        )

    metas = F.transform(F.filter(F.col("tokens"), lambda t: M.opens(t, "meta")), triple)
    return staged.select("scan_id", "seq", F.posexplode(metas).alias("pos", "m")).select(
        "scan_id", "seq", F.col("pos").cast("bigint").alias("pos"), "m.*"
    )


def with_responses(resources: DataFrame, responses: DataFrame, per_page: int | None = None) -> DataFrame:
    """Join probe results onto non-inline resources: status, mime type, load time, size.

    ``size_bytes`` is set only when the content-length header is all digits.
    ``per_page`` limits how many resources of a page are looked up; by default all are.
    """
    probes = responses.select(
        F.col("url").alias("probe_url"), "status_code", "mime_type", "load_time",
        F.when(F.col("content_length").rlike(r"^[0-9]+$"), F.col("content_length").try_cast("bigint")).alias("size_bytes"),
    )
    inline = F.col("is_inline") if "is_inline" in resources.columns else F.lit(False)
    looked_up = ~inline if per_page is None else ~inline & (F.col("ord") < per_page)
    base = resources.drop("status_code", "mime_type", "load_time", "size_bytes")
    keyed = base.withColumn("probe_key", F.when(looked_up, F.col("url")))
    return keyed.join(probes, F.col("probe_key") == F.col("probe_url"), "left").drop("probe_key", "probe_url")


def home_pages(pages: DataFrame) -> DataFrame:
    """The first page of each scan, by one partial-then-final aggregate."""
    others = [c for c in pages.columns if c not in ("scan_id", "seq")]
    packed = pages.groupBy("scan_id").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(*others), "seq").alias("home")
    )
    return packed.select("scan_id", "seq", "home.*")
