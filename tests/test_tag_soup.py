"""Facts of unclosed and mis-nested markup against a small tree builder in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import markup as M
from pagequarry.operators import dom

FACTS = ("nav_links", "unlabeled", "form_max", "empty_links", "empty_link_first", "empty_buttons", "heading_skips", "hidden_role")


class Node:
    def __init__(self, tag, parent, attrs=()):
        self.tag, self.parent, self.attrs, self.words = tag, parent, dict(attrs), False

    def up(self):
        node = self
        while node is not None:
            yield node
            node = node.parent


class Page:
    """Builds the tree: ``here`` is the innermost open element."""

    def __init__(self):
        self.here, self.root = None, None
        self.links, self.buttons, self.forms, self.fields, self.headings = [], [], [], [], []
        self.link = self.button = self.form = self.header = None
        self.nav_links = self.header_links = 0
        self.hidden_role = False
        self.bare = []

    def open_names(self):
        return [n.tag for n in self.here.up()] if self.here else []  # innermost first

    def leave(self, node):
        """Ends ``node`` and all that is open inside it."""
        ending = []
        for n in self.here.up():
            ending.append(n)
            if n is node:
                break
        self.here = node.parent
        for kind in ("link", "button", "form"):
            if getattr(self, kind) in ending:
                self.finish(kind)

    def finish(self, kind):
        node = getattr(self, kind)
        if node is not None and kind in ("link", "button"):
            (self.links if kind == "link" else self.buttons).append(node)
        setattr(self, kind, None)

    def nearest(self, tags, past):
        for n in self.here.up() if self.here else ():
            if n.tag in tags:
                return n
            if n.tag in past:
                return None
        return None

    def start(self, tag, attrs, targets):
        attrs = dict(attrs)
        for tags, (ended, past) in dom.ENDED_BY_START.items():
            if tag in tags:
                for e in ended:
                    node = self.nearest([e], past)
                    if node is not None:
                        self.leave(node)
        if tag in dom.ENDS_PARAGRAPH and (node := self.nearest(["p"], dom.SCOPE)) is not None:
            self.leave(node)
        around = list(self.here.up()) if self.here else []
        names = [n.tag for n in around]
        if "role" in attrs and any(n.attrs.get("aria-hidden") == "true" for n in around):
            self.hidden_role = True
        if tag == "a":
            self.finish("link")
            self.nav_links += names.count("nav")
            self.header_links += self.header in around and self.header is not None
        if tag in dom.HEADINGS:
            self.headings.append(int(tag[1]))
        if tag in dom.FIELDS and attrs.get("type") not in dom.UNCOUNTED_FIELD_TYPES:
            if self.form is not None:
                self.form.count += 1
            if "label" not in names and not attrs.get("aria-label") and not (attrs.get("id") and attrs["id"] in targets):
                self.bare.append(tag)
        if tag in M.VOID_ELEMENTS:
            return
        self.here = Node(tag, self.here, attrs)
        if tag == "a":
            self.link = self.here
            self.here.words = bool(attrs.get("aria-label") or attrs.get("title"))
        if tag == "button":
            self.finish("button")
            self.button = self.here
            self.here.words = bool(attrs.get("aria-label"))
        if tag == "form":
            self.form = self.here
            self.form.count = 0
            self.forms.append(self.form)
        if tag == "header" and self.header is None:
            self.header = self.here

    def end(self, tag):
        past = ("menu", "ol", "ul", *dom.SCOPE) if tag == "li" else dom.SCOPE if tag in dom.BLOCKS else ("table",) if tag in dom.TABLE_PARTS else () if tag in dom.ROOTS else dom.SPECIAL
        node = self.nearest([tag], past)
        if node is not None:
            self.leave(node)
        for kind, name in (("link", "a"), ("button", "button"), ("form", "form")):
            if tag == name:
                self.finish(kind)

    def text(self, words):
        for node in (self.link, self.button):
            if node is not None and words.strip():
                node.words = True

    def facts(self):
        self.finish("link")
        self.finish("button")
        empty = [n for n in self.links if not n.words]
        skips = sum(b > a + 1 for a, b in zip(self.headings, self.headings[1:], strict=False))
        return {
            "nav_links": self.nav_links or self.header_links, "unlabeled": len(self.bare), "form_max": max([f.count for f in self.forms], default=0),
            "empty_links": len(empty), "empty_link_first": empty[0].attrs.get("href", "") if empty else None,
            "empty_buttons": sum(not n.words for n in self.buttons), "heading_skips": skips, "hidden_role": self.hidden_role,
        }


def plain(tokens):
    page = Page()
    targets = {dict(attrs).get("for") for close, tag, attrs, _ in tokens if not close and tag == "label"}
    for close, tag, attrs, words in tokens:
        page.end(tag) if close else page.start(tag, attrs, targets)
        page.text(words)
    return page.facts()


def html_of(tokens):
    return "".join(f"</{tag}>{words}" if close else f"<{tag}{''.join(f' {k}=\"{v}\"' for k, v in attrs)}>{words}" for close, tag, attrs, words in tokens)


def facts_of(spark, pages):
    df = spark.createDataFrame([(i, html_of(p)) for i, p in enumerate(pages)], "i int, html string").repartition(4)
    tokens = df.select("i", M.tokens(F.col("html")).alias("t"))
    rows = tokens.select("i", dom.scoped_facts("t").alias("f")).orderBy("i").collect()
    return [{name: r.f[name] for name in FACTS} for r in rows]


def soup(rng, tags, length):
    """Start and end tags in any order; attributes on some."""
    out = []
    for _ in range(length):
        tag = rng.choice(tags)
        attrs = []
        if tag == "a":
            attrs += [("href", f"/{rng.randrange(9)}")] + ([("title", "t")] if rng.random() < 0.1 else [])
        if tag in dom.FIELDS and rng.random() < 0.3:
            attrs += [rng.choice([("id", "x"), ("type", "hidden"), ("aria-label", "l")])]
        if tag == "label" and rng.random() < 0.3:
            attrs += [("for", "x")]
        if rng.random() < 0.08:
            attrs += [("aria-hidden", "true")]
        if rng.random() < 0.08:
            attrs += [("role", "r")]
        close = rng.random() < 0.45
        out.append((close, tag, [] if close else attrs, rng.choice(["", "", " ", "words"])))
    return out


SETS = (
    ("nav", "a", "div", "header", "span", "p"),
    ("form", "input", "label", "div", "p", "select", "option", "table", "tr", "td"),
    ("a", "p", "div", "li", "ul", "button", "b", "td", "table", "tr"),
    ("div", "h1", "h3", "a", "button", "form", "textarea", "nav", "p", "br", "dl", "dt", "dd", "section"),
)


@pytest.mark.parametrize("seed", range(len(SETS)))
def test_tag_soup(spark, seed):
    rng = random.Random(seed)
    pages = [soup(rng, SETS[seed], rng.choice([3, 6, 12, 40])) for _ in range(250)]
    for page, got in zip(pages, facts_of(spark, pages), strict=True):
        assert got == plain(page), html_of(page)


CASES = [
    # An unclosed label ends with its paragraph or form: later fields have none.
    ("<form><label>Name<input></form><input><input>", {"unlabeled": 2, "form_max": 1}),
    # Items and cells end the ones before.
    ("<ul><li><a href='/1'>x<li><a href='/2'><li><a href='/3'>y</ul>", {"empty_links": 1, "empty_link_first": "/2"}),
    ("<table><tr><td><a href='/1'><td>words<tr><td>more</table>", {"empty_links": 1}),
    # A nav closes over what is open in it; a stray end tag is nothing.
    ("<nav><div><a href='/'>x</nav><a href='/2'>y</a>", {"nav_links": 1}),
    ("<nav></div></span><a href='/'>x</a></nav>", {"nav_links": 1}),
    # An inline end tag doesn't reach past a block.
    ("<span><nav></span><a href='/'>x</a></nav>", {"nav_links": 1}),
    # A hidden paragraph ends at the next block.
    ("<p aria-hidden='true'>x<div role='button'>y</div>", {"hidden_role": False}),
    ("<div aria-hidden='true'><p>x<p role='button'>y</div>", {"hidden_role": True}),
    # A select ends its options.
    ("<form><select><option>a<option>b</select><input><input></form><input>", {"form_max": 3}),
    ("", {"nav_links": 0, "empty_links": 0}),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(CASES)], "i int, html string")
    rows = df.select("i", M.tokens(F.col("html")).alias("t")).select("i", dom.scoped_facts("t").alias("f")).orderBy("i").collect()
    for r, (html, want) in zip(rows, CASES, strict=True):
        assert {k: r.f[k] for k in want} == want, html


def test_very_deep_markup_stays_cheap(spark):
    df = spark.range(1).select(M.tokens(F.repeat(F.lit("<font><b>"), 20_000)).alias("t"))
    assert df.select(dom.scoped_facts("t").alias("f")).first().f.nav_links == 0
