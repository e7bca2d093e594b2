"""Tree-scoped facts of a page, from one pass over its token array.

The pass carries the stack of open elements as a string ("<html><body><p>"). A start tag first ends what it can't stand
in (a paragraph before a block, an item before the next one, a cell, a row, an option, a link, a form), an end tag
ends its element with all that was left open inside, unless a table cell or, for inline elements, a block lies between;
end tags without an element count for nothing. "Inside nav", "inside label", "inside an aria-hidden element" are read
off the stack. Elements below the 512th level are not opened, as in browsers. The whole computation is one SQL
expression on one row: no explode, no sort, no shuffle, whatever the page count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.markup import VOID_ELEMENTS

# Field types that are never counted as form fields.
UNCOUNTED_FIELD_TYPES = ("hidden", "submit", "button", "reset")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FIELDS = ("input", "select", "textarea")


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _attr(name: str, token: str = "t") -> str:
    return f"get(filter({token}.attrs, a -> a.name = '{name}'), 0).value"


def _filled(name: str) -> str:
    return f"coalesce({_attr(name)} <> '', false)"


# Elements that end an open paragraph, blocks whose end tag ends what is open inside, and all elements
# that an inline element's end tag can't reach past.
ENDS_PARAGRAPH = (
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p",
    "plaintext", "pre", "search", "section", "summary", "table", "ul", "xmp",
)
BLOCKS = (
    "address", "article", "aside", "blockquote", "button", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "main", "menu", "nav", "object", "ol",
    "p", "pre", "search", "section", "summary", "ul",
)
TABLE_PARTS = ("caption", "tbody", "td", "tfoot", "th", "thead", "tr")
ROOTS = ("body", "head", "html", "select", "table", "template")
SPECIAL = tuple(sorted({*BLOCKS, *TABLE_PARTS, *ROOTS, "iframe", "li", "noscript", "textarea", "title"}))
SCOPE = ("button", "caption", "html", "object", "table", "td", "template", "th")
# What a start tag ends, each with the elements that it can't reach past.
ENDED_BY_START = {
    ("li",): (("li",), ("menu", "ol", "ul", *SCOPE)),
    ("dd", "dt"): (("dd", "dt"), ("dl", *SCOPE)),
    ("optgroup", "option"): (("option",), ("select",)),
    ("td", "th"): (("td", "th"), ("table",)),
    ("tr",): (("tr",), ("table",)),
    ("tbody", "tfoot", "thead"): (("tbody", "tfoot", "thead"), ("table",)),
    ("a",): (("a",), SCOPE),
    ("button",): (("button",), ("table", "td", "th")),
    ("form",): (("form",), ("table", "td", "th")),
}
DEEPEST = 512

_OPENED = "(NOT t.is_close)"
_LINK = "t.tag = 'a'"
_BUTTON = "t.tag = 'button'"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _any(tags: tuple[str, ...]) -> str:
    return f"'<({'|'.join(tags)})>'"


def _up_to(stack: str, entry: str, within: str) -> str:
    """``stack`` without its last ``entry`` and all above it, if there is one and ``within`` holds for what is above (u)."""
    cut = f"substring({stack}, 1, length({stack}) - length(u) - length({entry}))"
    return f"CASE WHEN contains({stack}, {entry}) THEN {_let('u', f'substring_index({stack}, {entry}, -1)', f'CASE WHEN {within} THEN {cut} ELSE {stack} END')} ELSE {stack} END"


def _start_ends() -> str:
    """The stack when a start tag has ended what it can't stand in."""
    cases = []
    for tags, (ended, past) in ENDED_BY_START.items():
        stack = "s.stack"
        for e in ended:
            stack = _let("k", stack, _up_to("k", f"'<{e}>'", f"NOT u rlike {_any(past)}"))
        cases.append(f"WHEN t.tag IN {_in(tags)} THEN {stack}")
    own = f"CASE {' '.join(cases)} ELSE s.stack END"
    return _let("q", own, f"CASE WHEN t.tag IN {_in(ENDS_PARAGRAPH)} THEN {_up_to('q', _PARAGRAPH, f'NOT u rlike {_any(SCOPE)}')} ELSE q END")


_PARAGRAPH = "'<p>'"
_ENDS_ITS_OWN = (
    f"CASE WHEN t.tag = 'li' THEN NOT u rlike {_any(('menu', 'ol', 'ul', *SCOPE))} WHEN t.tag IN {_in(BLOCKS)} THEN NOT u rlike {_any(SCOPE)}"
    f" WHEN t.tag IN {_in(TABLE_PARTS)} THEN NOT u rlike '<table>' WHEN t.tag IN {_in(ROOTS)} THEN true ELSE NOT u rlike {_any(SPECIAL)} END"
)
# p: the stack after what a token ends, d: its depth.
_ENTRY = "concat('<', t.tag, '>')"
_POPPED = f"CASE WHEN t.is_close THEN {_let('y', _ENTRY, _up_to('s.stack', 'y', _ENDS_ITS_OWN))} ELSE {_start_ends()} END"
_DEPTH = "length(p) - length(replace(p, '<', ''))"
_PUSHES = f"({_OPENED} AND t.tag NOT IN {_in(VOID_ELEMENTS)} AND d < {DEEPEST})"
_SAYS = r"""replace(replace(t.text, '&nbsp;', ' '), '&#160;', ' ') rlike '(?U)[^\\s]'"""
_COUNTED = (
    f"({_OPENED} AND t.tag IN {_in(FIELDS)}"
    f" AND NOT coalesce({_attr('type')} IN {_in(UNCOUNTED_FIELD_TYPES)}, false))"
)
_BARE = (
    f"({_COUNTED} AND NOT contains(p, '<label>') AND NOT {_filled('aria-label')} AND NOT {_filled('aria-labelledby')}"
    f" AND NOT ({_filled('id')} AND coalesce(array_contains(s.label_targets, {_attr('id')}), false)))"
)


def _ends(at: str, tag: str) -> str:
    """Whether the element opened at level ``at`` ends here: with an element around it, or at its own tags."""
    return f"(s.{at} IS NOT NULL AND (d < s.{at} OR t.tag = '{tag}'))"


def _level(at: str, tag: str) -> str:
    """The level of the open element that is followed, null while there is none."""
    return f"CASE WHEN {_OPENED} AND t.tag = '{tag}' THEN d + 1 WHEN {_ends(at, tag)} THEN NULL ELSE s.{at} END"


_IN_FORM = "(s.form_at IS NOT NULL AND d >= s.form_at)"
_IN_HEADER = "(s.header_at IS NOT NULL AND d >= s.header_at)"
_IN_HIDDEN = "(s.hidden_at IS NOT NULL AND d >= s.hidden_at)"
_LINK_ENDS_UNNAMED = f"({_ends('link_at', 'a')} AND NOT s.link_named)"
_BUTTON_ENDS_UNNAMED = f"({_ends('button_at', 'button')} AND NOT s.button_named)"
_HEADING = f"({_OPENED} AND t.tag IN {_in(HEADINGS)})"
_LEVEL = "CAST(substring(t.tag, 2, 1) AS INT)"
_SKIP = f"(CASE WHEN {_HEADING} THEN s.heading > 0 AND {_LEVEL} > s.heading + 1 ELSE false END)"
_NAVS = "CAST((length(p) - length(replace(p, '<nav>', ''))) / 5 AS INT)"


def _first(name: str, hit: str, counter: str, value: str) -> str:
    return f"CASE WHEN {hit} AND s.{counter} = 0 THEN {value} ELSE s.{name} END"


def _plus_one(counter: str, hit: str) -> str:
    return f"CASE WHEN {hit} THEN s.{counter} + 1 ELSE s.{counter} END"


# State of the pass: name -> (type, start value, value after a token).
_STATE = {
    "stack": ("STRING", "''", f"CASE WHEN {_PUSHES} THEN concat(p, '<', t.tag, '>') ELSE p END"),
    "nav_links": ("INT", "0", f"CASE WHEN {_OPENED} AND {_LINK} THEN s.nav_links + {_NAVS} ELSE s.nav_links END"),
    "headers_seen": ("INT", "0", _plus_one("headers_seen", f"{_OPENED} AND t.tag = 'header'")),
    "header_at": (
        "INT", "NULL",
        f"CASE WHEN {_OPENED} AND t.tag = 'header' AND s.headers_seen = 0 THEN d + 1 WHEN {_IN_HEADER} THEN s.header_at END"),
    "header_links": ("INT", "0", _plus_one("header_links", f"{_OPENED} AND {_LINK} AND {_IN_HEADER}")),
    "unlabeled": ("INT", "0", _plus_one("unlabeled", _BARE)),
    "unlabeled_first": (
        "STRING", "NULL",
        _first("unlabeled_first", _BARE, "unlabeled",
               f"substring(coalesce(nullif({_attr('name')}, ''), nullif({_attr('type')}, ''), 'input'), 1, 120)")),
    "form_at": ("INT", "NULL", _level("form_at", "form")),
    "form_fields": (
        "INT", "0",
        f"CASE WHEN t.tag = 'form' THEN 0 WHEN {_COUNTED} AND {_IN_FORM} THEN s.form_fields + 1 ELSE s.form_fields END"),
    "form_max": (
        "INT", "0",
        f"CASE WHEN {_COUNTED} AND {_IN_FORM} THEN greatest(s.form_max, s.form_fields + 1) ELSE s.form_max END"),
    "link_at": ("INT", "NULL", _level("link_at", "a")),
    "link_named": (
        "BOOLEAN", "false",
        f"CASE WHEN {_LINK} THEN {_OPENED} AND ({_SAYS} OR {_filled('aria-label')} OR {_filled('title')})"
        f" ELSE s.link_named OR (s.link_at IS NOT NULL AND d >= s.link_at AND {_SAYS}) END"),
    "link_href": (
        "STRING", "NULL", f"CASE WHEN {_LINK} AND {_OPENED} THEN coalesce({_attr('href')}, '') ELSE s.link_href END"),
    "empty_links": ("INT", "0", _plus_one("empty_links", _LINK_ENDS_UNNAMED)),
    "empty_link_first": (
        "STRING", "NULL", _first("empty_link_first", _LINK_ENDS_UNNAMED, "empty_links", "s.link_href")),
    "button_at": ("INT", "NULL", _level("button_at", "button")),
    "button_named": (
        "BOOLEAN", "false",
        f"CASE WHEN {_BUTTON} THEN {_OPENED} AND ({_SAYS} OR {_filled('aria-label')})"
        f" ELSE s.button_named OR (s.button_at IS NOT NULL AND d >= s.button_at AND {_SAYS}) END"),
    "empty_buttons": ("INT", "0", _plus_one("empty_buttons", _BUTTON_ENDS_UNNAMED)),
    "heading": ("INT", "0", f"CASE WHEN {_HEADING} THEN {_LEVEL} ELSE s.heading END"),
    "heading_skips": ("INT", "0", _plus_one("heading_skips", _SKIP)),
    "heading_skip_first": (
        "STRING", "NULL",
        _first("heading_skip_first", _SKIP, "heading_skips", "concat('h', s.heading, ' -> ', t.tag)")),
    "hidden_at": (
        "INT", "NULL",
        f"CASE WHEN {_IN_HIDDEN} THEN s.hidden_at WHEN {_PUSHES} AND coalesce({_attr('aria-hidden')} = 'true', false) THEN d + 1 END"),
    "hidden_role": ("BOOLEAN", "false", f"s.hidden_role OR ({_IN_HIDDEN} AND {_OPENED} AND {_attr('role')} IS NOT NULL)"),
}

# A link or button left open at the end of the page counts as ended there.
_LEFT_LINK = "(s.link_at IS NOT NULL AND NOT s.link_named)"
_LEFT_BUTTON = "(s.button_at IS NOT NULL AND NOT s.button_named)"
_RESULT = {
    "nav_links": "CASE WHEN s.nav_links > 0 THEN s.nav_links ELSE s.header_links END",
    "unlabeled": "s.unlabeled",
    "unlabeled_first": "s.unlabeled_first",
    "form_max": "s.form_max",
    "empty_links": f"s.empty_links + CAST({_LEFT_LINK} AS INT)",
    "empty_link_first": (
        f"substring(CASE WHEN {_LEFT_LINK} AND s.empty_links = 0 THEN s.link_href ELSE s.empty_link_first END, 1, 150)"),
    "empty_buttons": f"s.empty_buttons + CAST({_LEFT_BUTTON} AS INT)",
    "heading_skips": "s.heading_skips",
    "heading_skip_first": "s.heading_skip_first",
    "hidden_role": "s.hidden_role",
}


def _record(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def scoped_facts(tokens: str) -> Column:
    """Struct of all facts that depend on where in the tree a tag sits.

    The label targets ride in the state, so they are computed once per page and
    not once per token.
    """
    targets = f"transform(filter({tokens}, t -> {_OPENED} AND t.tag = 'label'), t -> {_attr('for')})"
    start = _record({n: f"CAST({v} AS {k})" for n, (k, v, _) in _STATE.items()} | {"label_targets": targets})
    step = _record(
        {n: f"CAST({v} AS {k})" for n, (k, _, v) in _STATE.items()} | {"label_targets": "s.label_targets"}
    )
    bound = _let("p", _POPPED, _let("d", _DEPTH, step))
    return F.expr(f"aggregate({tokens}, {start}, (s, t) -> {bound}, s -> {_record(_RESULT)})")


def flat_facts(tokens: str) -> dict[str, Column]:
    """Facts of single tags, independent of nesting."""
    def count(test: str) -> Column:
        return F.expr(f"size(filter({tokens}, t -> {_OPENED} AND {test}))")

    def has(test: str) -> Column:
        return F.expr(f"exists({tokens}, t -> {_OPENED} AND {test})")

    no_alt = f"t.tag = 'img' AND {_attr('alt')} IS NULL AND NOT coalesce({_attr('role')} = 'presentation', false)"
    first_src = f"get(transform(filter({tokens}, t -> {_OPENED} AND {no_alt}), t -> {_attr('src')}), 0)"
    viewport = (
        f"get(transform(filter({tokens}, t -> {_OPENED} AND t.tag = 'meta' AND {_attr('name')} = 'viewport'),"
        f" t -> {_attr('content')}), 0)"
    )
    return {
        "h1_count": count("t.tag = 'h1'"),
        "h1_h2_count": count("t.tag IN ('h1', 'h2')"),
        "img_no_alt": count(no_alt),
        "img_no_alt_first": F.expr(f"substring(coalesce({first_src}, ''), 1, 200)"),
        "has_unsized_img": has(
            f"t.tag = 'img' AND {_filled('src')} AND NOT {_filled('width')} AND NOT {_filled('height')}"),
        "has_html_lang": has(f"t.tag = 'html' AND {_filled('lang')}"),
        "has_button": has(f"({_BUTTON} OR ({_LINK} AND coalesce(contains({_attr('class')}, 'btn'), false)))"),
        "has_viewport": F.expr(f"coalesce({viewport} <> '', false)"),
    }
