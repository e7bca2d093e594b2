from pyspark.sql import functions as F

from pagequarry.functions import text as TX
from pagequarry.operators import extract

FLAWED = """<!DOCTYPE html><html><head><title> A &amp; B
 shop </title><meta name=description content='x'><style>a > b {}</style></head><body>
<header><a href=1>1</a><a href=2>2</a></header><!-- <img src=no> -->
<script>if (1 < 2) { document.write("<img>") }</script>
<h1>One</h1><h4>Four</h4><img src="a.png"><img src="b.png" alt=""><img src=c.png role=presentation>
<form><label>Name <input name=n></label><input id=e type=email><label for=e>E</label><input name=bare>
<select><option>1</option></select><input type=hidden></form>
<a href="/empty">&nbsp;</a><a href="/open"><img alt=x src=d.png></a><a href="/named" aria-label="n"></a>
<button> </button><button aria-label="ok"></button><div aria-hidden="true"><br><p><span role=button>x</span></div>
<div role=main>no</div></body></html>"""


def profile(spark, *htmls):
    rows = [("s", i, f"https://s.example/p{i}", h) for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, "scan_id string, seq int, url string, html string")
    return extract.page_profiles(extract.page_rows(df)).orderBy("seq").collect()


def test_flawed_page(spark):
    p = profile(spark, FLAWED)[0]
    assert p.title == "A & B shop"
    assert p.meta_description == "x"
    assert (p.h1_count, p.heading_skips, p.heading_skip_first) == (1, 1, "h1 -> h4")
    assert (p.img_no_alt, p.img_no_alt_first) == (1, "a.png")
    assert (p.unlabeled, p.unlabeled_first) == (2, "bare")
    assert (p.empty_links, p.empty_link_first) == (2, "/empty")
    assert p.empty_buttons == 1
    assert p.hidden_role and not p.has_html_lang and p.has_button
    assert p.nav_links == 2  # no nav, so the header's links count
    assert p.form_max == 4
    assert "document.write" not in p.text and "no" in p.text.split()


def test_nested_nav_counts_once_per_level(spark):
    p = profile(spark, "<nav><a>1</a><nav><a>2</a></nav></nav><nav><a>3</a></nav></nav><a>4</a>")[0]
    assert p.nav_links == 4


def test_hidden_scope_ends_with_its_element(spark):
    inside, outside = profile(
        spark, '<div aria-hidden="true"><ul><li role="x"></li></ul></div>', '<div aria-hidden="true"><b></b></div><i role="x"></i>'
    )
    assert inside.hidden_role and not outside.hidden_role


def test_unclosed_link_and_attributes_with_brackets(spark):
    p = profile(spark, '<a href="/x" title=""><a href="/y">y</a><a href="/z" data-q="a > b" alt=\'>\'>z<a href="/last">')[0]
    assert (p.empty_links, p.empty_link_first) == (2, "/x")
    assert p.internal_links == [f"https://s.example/{x}" for x in ("x", "y", "z", "last")]


def test_unbalanced_quotes_do_not_hang(spark):
    p = profile(spark, "<p " + 'a="b ' * 3000 + "<h1>x</h1>" + "<a href=it's>t</a>")[0]
    assert p.h1_count in (0, 1)


def test_no_html(spark):
    p = profile(spark, None)[0]
    assert not p.has_html and p.word_count is None and p.title is None and p.opening_sha is None


def test_text_is_read_whole(spark):
    long = "<p>" + "word " * 40_000 + "final</p>"
    p = profile(spark, long)[0]
    assert p.word_count == 40_001 and p.text.endswith("final")


def test_entities(spark):
    df = spark.createDataFrame([("&lt;b&gt; &amp;lt; &#233;&#x1F600; &copy; &unknown; &#0; a&b",)], "t string")
    assert df.select(TX.decode_entities(F.col("t"))).first()[0] == "<b> &lt; é😀 © &unknown; � a&b"
    df = spark.createDataFrame([("&#38;lt; &lt; &#38;amp; caf&eacute; &Auml;&frac12;&&;&",)], "t string")
    assert df.select(TX.decode_entities(F.col("t"))).first()[0] == "&lt; < &amp; café Ä½&&;&"


def test_whitespace_truncate_control(spark):
    df = spark.createDataFrame([(" a \t b\n",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(TX.normalize_whitespace(F.col("t"))).collect()] == ["a b", "", ""]
    assert [r[0] for r in df.select(TX.word_count(F.col("t"))).collect()] == [2, 0, 0]
    df = spark.createDataFrame([("abcdefgh",), ("abc",)], "t string")
    assert [r[0] for r in df.select(TX.truncate(F.col("t"), 6)).collect()] == ["abc...", "abc"]


def test_resources_first_type_wins_and_order(spark):
    html = (
        '<img src="/x.css"><link rel="stylesheet preload" href="/x.css"><link rel=icon href="i.png"><link rel=canonical href=/c>'
        '<link rel=preload href=/f.css?v><script src=" /a.js "></script><script>inline()</script><script>  </script>'
        '<source src=/s.woff2><video src=/v.mp4></video><iframe src="//o.example/f"></iframe><img src="data:xx">'
    )
    df = spark.createDataFrame([("s", 0, "https://s.example/d/p", html)], "scan_id string, seq int, url string, html string")
    rows = extract.resources(extract.page_rows(df)).orderBy("ord").collect()
    assert [(r.url, r.resource_type, r.is_external, r.is_inline) for r in rows] == [
        ("https://s.example/x.css", "CSS", False, False),
        ("https://s.example/d/i.png", "IMAGE", False, False),
        ("https://s.example/f.css?v", "CSS", False, False),
        ("https://s.example/a.js", "JS", False, False),
        ("https://s.example/s.woff2", "FONT", False, False),
        ("https://s.example/v.mp4", "VIDEO", False, False),
        ("https://o.example/f", "OTHER", True, False),
        ("https://s.example/d/p", "JS", False, True),
    ]


def test_only_html_is_parsed_and_headers_are_lowered(spark):
    df = spark.createDataFrame(
        [("s", 0, "https://s.example/", "<h1>x</h1>", "Text/HTML", {"X-A": "1"}), ("s", 1, "https://s.example/i", "<h1>x</h1>", "image/png", {})],
        "scan_id string, seq int, url string, html string, content_type string, headers map<string,string>",
    )
    a, b = extract.page_rows(df).orderBy("seq").collect()
    assert a.headers == {"x-a": "1"} and a.html == "<h1>x</h1>" and b.html is None and b.html_size == 10


def test_page_rows_take_odd_headers_cookies_and_texts(spark):
    from pagequarry.operators.extract import page_rows

    raw = spark.createDataFrame(
        [("s", 0, "https://s.example/", "<p>é</p>", {"Server": "one", "server": "two"}, [("/", "d.example", True, "n", False, "Lax")])],
        "scan_id string, seq int, url string, html string, headers map<string,string>, "
        "cookies array<struct<path:string,domain:string,httponly:boolean,name:string,secure:boolean,samesite:string>>")
    row = page_rows(raw).first()
    assert row.headers == {"server": "two"} and row.html_size == 9
    assert row.cookies[0].asDict() == {"name": "n", "domain": "d.example", "secure": False, "httponly": True}


def test_links_lose_tabs_and_line_ends(spark):
    from pyspark.sql import functions as F

    from pagequarry.functions import markup as M
    from pagequarry.functions import urls as U
    from pagequarry.operators.extract import internal_links

    html = '<a href="\n/x">1</a><a href=" /y\t">2</a><a href="/a\nb">3</a>'
    pages = spark.createDataFrame([("https://s.example/", html)], "url string, html string").withColumn("tokens", M.tokens(F.col("html")))
    assert [str(x) for x in pages.select(internal_links(F.col("tokens"), F.col("url"))).first()[0]] == [
        "https://s.example/x", "https://s.example/y", "https://s.example/ab"]
    assert pages.select(U.join_url(F.col("url"), F.lit("/p\tq\n"))).first()[0] == "https://s.example/pq"
