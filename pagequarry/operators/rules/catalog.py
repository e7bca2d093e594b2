"""The rules: fixed ids, categories and weights, with a sentence for each.

Order matters: categories are alphabetical and rules keep their place inside a
category, which gives every finding a stable position without numbering rows.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    confidence: float | None
    impact: str
    effort: str
    description: str
    order: int = 0


# Rule id, severity, confidence, impact, effort (a confidence of None
# is computed per finding), and our own description.
_A11Y = (
    ("A11Y_IMG_MISSING_ALT", "MEDIUM", 0.95, "MEDIUM", "LOW", "Images carry no alt attribute, so screen readers skip or misread them."),
    ("A11Y_FORM_FIELD_NO_LABEL", "HIGH", 0.95, "MEDIUM", "MEDIUM", "Form fields have no label, so their purpose is not announced."),
    ("A11Y_HEADING_ORDER", "MEDIUM", 0.9, "LOW", "LOW", "A heading is more than one level below the heading before it."),
    ("A11Y_HTML_LANG_MISSING", "HIGH", 0.95, "MEDIUM", "LOW", "The html element does not say which language the page is in."),
    ("A11Y_EMPTY_LINK", "LOW", 0.95, "LOW", "LOW", "Links have neither text nor an accessible name."),
    ("A11Y_EMPTY_BUTTON", "LOW", 0.95, "LOW", "LOW", "Buttons have neither text nor an accessible name."),
    ("A11Y_ARIA_HIDDEN_FOCUSABLE", "MEDIUM", 0.6, "MEDIUM", "LOW", "A hidden element holds something that can take focus."),
)
_ARCH = (
    ("ARCH_SINGLE_PAGE", "LOW", 0.9, "LOW", "LOW", "Only one page was found."),
    ("ARCH_MANY_THIRD_PARTIES", "MEDIUM", 0.85, "MEDIUM", "MEDIUM", "Resources come from many other domains."),
    ("ARCH_NO_CDN", "INFO", 0.6, "LOW", "MEDIUM", "No resource seems to come from a content delivery network."),
    ("ARCH_DEEP_NESTING", "LOW", 0.7, "LOW", "MEDIUM", "Pages lie many clicks away from the home page."),
)
_CONTENT = (
    ("CONTENT_THIN", "LOW", 0.9, "LOW", "MEDIUM", "Pages hold fewer than 150 words."),
    ("CONTENT_NO_HEADINGS", "LOW", 0.9, "LOW", "LOW", "Pages have no first or second level heading."),
    ("CONTENT_REPEATED", "LOW", 0.8, "LOW", "MEDIUM", "Several pages open with the same text."),
    ("CONTENT_POTENTIAL_SIMILARITY", "LOW", None, "LOW", "MEDIUM", "Two pages share much of their wording; a person should look at them."),
)
_PERF = (
    ("PERF_LARGE_HTML", "MEDIUM", 0.9, "MEDIUM", "MEDIUM", "The pages' html is large in total."),
    ("PERF_HUGE_RESOURCE", "MEDIUM", 0.95, "MEDIUM", "LOW", "A single resource weighs two megabytes or more."),
    ("PERF_TOO_MANY_REQUESTS", "MEDIUM", 0.9, "MEDIUM", "MEDIUM", "The pages ask for many resources."),
    ("PERF_MANY_THIRD_PARTY_REQUESTS", "MEDIUM", 0.9, "HIGH", "HIGH", "Many requests go to other domains."),
    ("PERF_RENDER_BLOCKING_SCRIPTS", "LOW", 0.65, "MEDIUM", "MEDIUM", "Several local scripts may hold up rendering."),
    ("PERF_LARGE_IMAGE", "MEDIUM", 0.95, "MEDIUM", "LOW", "An image weighs 300 kilobytes or more."),
    ("PERF_IMAGES_NO_DIMENSIONS", "LOW", 0.85, "LOW", "LOW", "Images state neither width nor height, so the layout can jump."),
    ("PERF_LARGE_JS", "MEDIUM", 0.95, "MEDIUM", "MEDIUM", "A script file weighs 400 kilobytes or more."),
    ("PERF_LARGE_CSS", "LOW", 0.95, "LOW", "MEDIUM", "A style sheet weighs 200 kilobytes or more."),
)
_PRIV = (
    ("PRIV_ANALYTICS_THIRD_PARTIES", "INFO", 0.85, "LOW", "MEDIUM", "Resources come from domains known for analytics."),
    ("PRIV_SOCIAL_WIDGETS", "INFO", 0.85, "LOW", "LOW", "Resources come from social platforms."),
    ("PRIV_TRACKER_SCRIPT_PATTERNS", "INFO", 0.6, "LOW", "MEDIUM", "Script text looks like that of tracking libraries."),
    ("PRIV_PRIVACY_POLICY_MISSING", "LOW", 0.6, "LOW", "MEDIUM", "No page mentions privacy."),
    ("PRIV_CONSENT_UI_NOT_OBSERVED", "LOW", 0.4, "LOW", "MEDIUM", "Cookies are mentioned but no consent prompt was seen."),
    ("PRIV_THIRD_PARTY_COOKIES", "INFO", 0.5, "LOW", "LOW", "Cookies name a domain of their own."),
)
_SEC = (
    ("SEC_HTTPS_ABSENT", "HIGH", 1.0, "HIGH", "LOW", "The site answers over plain http."),
    ("SEC_HSTS_MISSING", "MEDIUM", 0.9, "MEDIUM", "LOW", "No strict-transport-security header was sent."),
    ("SEC_HSTS_NO_SUBDOMAINS", "LOW", 0.9, "LOW", "LOW", "The strict-transport-security header leaves out subdomains."),
    ("SEC_HSTS_SHORT_MAXAGE", "LOW", 0.9, "LOW", "LOW", "The strict-transport-security header expires within 180 days."),
    ("SEC_CSP_MISSING", "MEDIUM", 0.9, "MEDIUM", "MEDIUM", "No content security policy was sent."),
    ("SEC_CSP_UNSAFE_INLINE", "MEDIUM", 0.95, "MEDIUM", "MEDIUM", "The content security policy allows inline scripts."),
    ("SEC_CSP_UNSAFE_EVAL", "LOW", 0.95, "LOW", "MEDIUM", "The content security policy allows eval."),
    ("SEC_XCTO_MISSING", "LOW", 0.9, "LOW", "LOW", "MIME sniffing is not switched off."),
    ("SEC_REFERRER_POLICY_MISSING", "LOW", 0.8, "LOW", "LOW", "No referrer policy was sent."),
    ("SEC_PERMISSIONS_POLICY_MISSING", "LOW", 0.8, "LOW", "LOW", "No permissions policy was sent."),
    ("SEC_FRAME_PROTECTION_MISSING", "MEDIUM", 0.9, "MEDIUM", "LOW", "The pages can be framed by other sites."),
    ("SEC_TECH_DISCLOSURE", "LOW", 0.95, "LOW", "LOW", "The x-powered-by header names the technology in use."),
    ("SEC_SERVER_VERSION_DISCLOSURE", "LOW", 0.9, "LOW", "LOW", "The server header names a version."),
    ("SEC_COOKIE_MISSING_SECURE", "MEDIUM", 0.95, "MEDIUM", "LOW", "Cookies may travel over plain http."),
    ("SEC_COOKIE_MISSING_HTTPONLY", "LOW", 0.9, "LOW", "LOW", "Scripts can read cookies."),
    ("SEC_MIXED_CONTENT", "HIGH", 0.95, "HIGH", "MEDIUM", "An https site loads resources over plain http."),
    ("SEC_OBSERVABLE_API", "INFO", 0.7, "LOW", "LOW", "Page code refers to API paths."),
    ("SEC_PUBLIC_EMAIL", "INFO", 0.9, "LOW", "LOW", "Pages show e-mail addresses."),
    ("SEC_EXPOSED_SECRET_PATTERN", "HIGH", 0.4, "HIGH", "MEDIUM", "Page code holds text shaped like a key; a person should look at it."),
)
_SEO = (
    ("SEO_TITLE_MISSING", "HIGH", 0.95, "HIGH", "LOW", "Pages have no title."),
    ("SEO_TITLE_TOO_LONG", "LOW", 0.8, "LOW", "LOW", "Titles are longer than 65 characters."),
    ("SEO_DUPLICATE_TITLES", "MEDIUM", 0.9, "MEDIUM", "MEDIUM", "Pages share a title."),
    ("SEO_META_DESCRIPTION_MISSING", "MEDIUM", 0.95, "MEDIUM", "LOW", "Pages have no meta description."),
    ("SEO_CANONICAL_MISSING", "LOW", 0.8, "LOW", "LOW", "Pages name no canonical URL."),
    ("SEO_OG_MISSING", "LOW", 0.85, "LOW", "LOW", "The home page has no Open Graph title."),
    ("SEO_NO_INTERNAL_LINKS", "LOW", 0.8, "LOW", "MEDIUM", "No page links to another page."),
    ("SEO_URL_STRUCTURE", "INFO", 0.8, "LOW", "LOW", "URLs hold capitals, blanks or underscores."),
    ("SEO_BROKEN_PAGES", "HIGH", 0.95, "MEDIUM", "LOW", "Pages answer with an error status."),
    ("A11Y_HEADING_ORDER", "MEDIUM", 0.9, "LOW", "LOW", "A heading is more than one level below the heading before it."),
    ("SEO_STRUCTURED_DATA_INVALID", "LOW", 0.95, "LOW", "LOW", "A JSON-LD block is not valid JSON."),
    ("SEO_STRUCTURED_DATA_MISSING", "INFO", 0.9, "LOW", "MEDIUM", "No page holds JSON-LD."),
    ("SEO_STRUCTURED_DATA_PRESENT", "INFO", 0.95, "LOW", "LOW", "Pages hold valid JSON-LD."),
    ("SEO_NOINDEX_PAGES", "LOW", 0.95, "LOW", "LOW", "Pages ask search engines to leave them out."),
)
_UX = (
    ("UX_NAV_COMPLEXITY", "LOW", 0.85, "LOW", "MEDIUM", "The navigation offers many links."),
    ("UX_NO_CTA", "LOW", 0.7, "LOW", "MEDIUM", "The home page asks visitors to do nothing."),
    ("UX_FORM_COMPLEXITY", "INFO", 0.85, "LOW", "MEDIUM", "A form asks for many things."),
    ("UX_NO_VIEWPORT", "HIGH", 0.95, "HIGH", "LOW", "The home page sets no mobile viewport."),
    ("UX_MULTIPLE_H1", "LOW", 0.9, "LOW", "LOW", "Pages have more than one first-level heading."),
    ("UX_CONTENT_DENSITY", "INFO", 0.8, "LOW", "MEDIUM", "Pages hold more than 4000 words."),
    ("UX_UNCLEAR_PURPOSE", "LOW", 0.8, "LOW", "LOW", "Pages have neither title nor first-level heading."),
)

_BY_CATEGORY = {
    "ACCESSIBILITY": _A11Y,
    "ARCHITECTURE": _ARCH,
    "CONTENT": _CONTENT,
    "PERFORMANCE": _PERF,
    "PRIVACY": _PRIV,
    "SECURITY": _SEC,
    "SEO": _SEO,
    "UX": _UX,
}
CATEGORIES = tuple(_BY_CATEGORY)

RULES: dict[tuple[str, str], Rule] = {}
for _c, (_category, _rows) in enumerate(_BY_CATEGORY.items()):
    for _r, _row in enumerate(_rows):
        RULES[(_category, _row[0])] = Rule(_row[0], _category, *_row[1:], order=100 * _c + _r)


def rule(rule_id: str, category: str | None = None) -> Rule:
    """The rule of that id; give the category where an id is in two of them."""
    if category:
        return RULES[(category, rule_id)]
    return next(r for (_, name), r in RULES.items() if name == rule_id)
