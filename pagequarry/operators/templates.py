"""Recommendation texts by rule: title (fixed values), then what the rule measured and what to do about it (our wording)."""

from __future__ import annotations

# The title of each rule's recommendation.
TITLES: dict[str, str] = {
    "SEC_HTTPS_ABSENT": "Enable HTTPS for the entire site",
    "SEC_HSTS_MISSING": "Add the Strict-Transport-Security header",
    "SEC_CSP_MISSING": "Add a Content Security Policy header",
    "SEC_XCTO_MISSING": "Add X-Content-Type-Options: nosniff",
    "SEC_FRAME_PROTECTION_MISSING": "Add frame protection (X-Frame-Options or CSP frame-ancestors)",
    "SEC_MIXED_CONTENT": "Eliminate mixed content (HTTP resources on HTTPS pages)",
    "SEC_COOKIE_MISSING_SECURE": "Mark cookies as Secure",
    "SEC_TECH_DISCLOSURE": "Remove X-Powered-By header",
    "PERF_LARGE_IMAGE": "Compress and resize oversized images",
    "PERF_HUGE_RESOURCE": "Reduce very large resources",
    "PERF_MANY_THIRD_PARTY_REQUESTS": "Reduce third-party requests",
    "PERF_RENDER_BLOCKING_SCRIPTS": "Defer non-critical JavaScript",
    "PERF_LARGE_JS": "Split or defer large JavaScript bundles",
    "PERF_LARGE_HTML": "Reduce HTML payload size",
    "PERF_IMAGES_NO_DIMENSIONS": "Add width/height to images",
    "A11Y_IMG_MISSING_ALT": "Add alt text to images",
    "A11Y_FORM_FIELD_NO_LABEL": "Associate labels with form fields",
    "A11Y_HEADING_ORDER": "Fix heading hierarchy",
    "A11Y_HTML_LANG_MISSING": "Declare the document language",
    "A11Y_EMPTY_LINK": "Give links accessible names",
    "A11Y_EMPTY_BUTTON": "Give buttons accessible names",
    "PRIV_PRIVACY_POLICY_MISSING": "Add a privacy policy page and link it",
    "SEO_TITLE_MISSING": "Add unique page titles",
    "SEO_META_DESCRIPTION_MISSING": "Add meta descriptions",
    "SEO_STRUCTURED_DATA_MISSING": "Add structured data (JSON-LD)",
    "SEO_BROKEN_PAGES": "Fix pages returning errors",
    "SEO_DUPLICATE_TITLES": "Make page titles unique",
    "CONTENT_THIN": "Expand thin content pages",
    "UX_NO_VIEWPORT": "Add the mobile viewport meta tag",
    "UX_MULTIPLE_H1": "Use a single H1 per page",
    "SEC_TLS_CERT_INVALID": "Fix the TLS certificate",
}

TEXTS: dict[str, tuple[str, str]] = {
    "SEC_HTTPS_ABSENT": (
        "The address from which this scan started has the scheme http.",
        "Serve the host on port 443, answer port 80 with a 301 to it, and rescan from the https address.",
    ),
    "SEC_HSTS_MISSING": (
        "No answer for the home page had a Strict-Transport-Security header.",
        "Send it with max-age=31536000; below 15552000 seconds the rule on short lifetimes reports it.",
    ),
    "SEC_CSP_MISSING": (
        "The home page came without a Content-Security-Policy header.",
        "The domains under resources in this scan are the first draft of the allow list; try it with Content-Security-Policy-Report-Only.",
    ),
    "SEC_XCTO_MISSING": (
        "The header X-Content-Type-Options of the home page was absent or had another value than nosniff.",
        "One server-wide line is enough; the value is compared whole, so leave out anything beside nosniff.",
    ),
    "SEC_FRAME_PROTECTION_MISSING": (
        "The home page had no X-Frame-Options, and its policy has no frame-ancestors.",
        "Either of the two ends this finding. Take frame-ancestors if some partner has to embed the site.",
    ),
    "SEC_MIXED_CONTENT": (
        "The scan began at an https address and met resources whose URL begins with http://. The evidence lists them.",
        "Check that each listed file answers under https, replace its URL, and look for the old prefix in templates and style sheets.",
    ),
    "SEC_COOKIE_MISSING_SECURE": (
        "The cookies named in the evidence were set without Secure.",
        "Change the Set-Cookie line of each name, or the session settings that write it.",
    ),
    "SEC_TECH_DISCLOSURE": (
        "The evidence quotes what X-Powered-By said.",
        "Unset the header where it is made, or strip it in the proxy in front.",
    ),
    "PERF_LARGE_IMAGE": (
        "The image in the evidence has at least 307200 bytes.",
        "Re-encode that file as AVIF or WebP and offer smaller widths by srcset until it is below the mark.",
    ),
    "PERF_HUGE_RESOURCE": (
        "One file, of whatever type, has at least 2097152 bytes.",
        "Find out which pages refer to it; if few do, fetch it on a click, otherwise cut it up.",
    ),
    "PERF_MANY_THIRD_PARTY_REQUESTS": (
        "Ten or more resources in this scan belong to another domain than the site.",
        "Group the resource table by domain: the domain with the most rows is where removing one tag saves most.",
    ),
    "PERF_RENDER_BLOCKING_SCRIPTS": (
        "At least four script files lie on the site's own domain; the finding assumes that they are loaded in the head.",
        "Confirm it in the markup first. What the first screen does not need may carry defer.",
    ),
    "PERF_LARGE_JS": (
        "The script file in the evidence has at least 409600 bytes.",
        "Run a bundle report on that file, and move routes and libraries that one page alone uses into chunks of their own.",
    ),
    "PERF_LARGE_HTML": (
        "The html of all pages in this scan adds up to over 1572864 bytes.",
        "Sort the pages by html_bytes; inlined images, styles and state objects usually fill the first few.",
    ),
    "PERF_IMAGES_NO_DIMENSIONS": (
        "Two pages or more contain an img with neither width nor height.",
        "Let the template that prints img tags fill in both numbers from the file.",
    ),
    "A11Y_IMG_MISSING_ALT": (
        "The count is that of img tags without an alt attribute and without role=presentation; the evidence has the first src.",
        "Begin with that src, and make alt a required field wherever editors upload pictures.",
    ),
    "A11Y_FORM_FIELD_NO_LABEL": (
        "The counted controls stand in no label, are named by no label's for, and have no ARIA name.",
        "Connect every control by for and id; a placeholder does not count here.",
    ),
    "A11Y_HEADING_ORDER": (
        "Somewhere a heading's level is higher by two or more than that of the heading before it.",
        "Choose h2 to h6 by nesting and set the font size in CSS.",
    ),
    "A11Y_HTML_LANG_MISSING": (
        "The pages counted have an html tag without lang.",
        "Put the language code, such as en or pt-BR, into the layout that all pages use.",
    ),
    "A11Y_EMPTY_LINK": (
        "Between the start and end of the counted links there is no text, and no attribute names them; the evidence has the first href.",
        "Icon links are the usual case: write hidden text into them.",
    ),
    "A11Y_EMPTY_BUTTON": (
        "The counted buttons contain no text and have no naming attribute.",
        "Say in the button what a press does, if need be in visually hidden text.",
    ),
    "PRIV_PRIVACY_POLICY_MISSING": (
        "The word privacy stands in none of the scanned pages.",
        "If there is a policy, link it where the crawl can reach it; if not, have one written that covers the trackers found in this scan.",
    ),
    "SEO_TITLE_MISSING": (
        "The counted pages have an empty title or none; the evidence begins with the first.",
        "Check the page template before single pages, since one missing variable empties them all.",
    ),
    "SEO_META_DESCRIPTION_MISSING": (
        "The counted pages have no description among their meta tags.",
        "Take the opening sentence as a default and let editors override it.",
    ),
    "SEO_STRUCTURED_DATA_MISSING": (
        "Of all pages scanned, none had a script of type application/ld+json.",
        "Pick one schema.org type for each template and print its JSON with the page; this audit validates it on the next scan.",
    ),
    "SEO_BROKEN_PAGES": (
        "The listed URLs answered with a status of 400 or more.",
        "Follow the inlinks of each to the link that is wrong, then either restore the target or answer 301.",
    ),
    "SEO_DUPLICATE_TITLES": (
        "The counted pages have a title that an earlier page of this scan already had.",
        "Add what differs, such as product, place or page number, to the title's pattern.",
    ),
    "CONTENT_THIN": (
        "The listed pages have fewer than 150 words of visible text.",
        "Decide page by page: write more, fold it into a neighbour, or mark it noindex.",
    ),
    "UX_NO_VIEWPORT": (
        "The home page's head has no meta tag named viewport.",
        "Add name=viewport with content width=device-width, initial-scale=1.",
    ),
    "UX_MULTIPLE_H1": (
        "The counted pages have two or more h1 tags.",
        "Often logo and headline are both h1; make the logo a plain link.",
    ),
    "SEC_TLS_CERT_INVALID": (
        "The certificate was reported as not valid for this host.",
        "Compare host names, expiry date and intermediate certificates, in this order.",
    ),
}

TEMPLATES: dict[str, tuple[str, str, str]] = {name: (title, *TEXTS[name]) for name, title in TITLES.items()}
DEFAULT_GUIDANCE = "The evidence shows where the rule fired; the next scan shows whether the change worked."
