import pytest
from pyspark.sql import functions as F

from pagequarry.operators import duplicates, extract, scoring
from pagequarry.operators.rules.catalog import RULES, Rule
from pagequarry.operators.rules.pages import page_facts
from pagequarry.plans.audit import audit, write_audit
from pagequarry.plans.registry import FAMILIES, page_predicate_rule

PAGES = "scan_id string, seq int, url string, html string, headers map<string,string>, status_code int, depth int"
RESOURCES = "scan_id string, seq bigint, ord bigint, url string, resource_type string, is_external boolean, domain string, size_bytes bigint"
CLEAN = (
    '<html lang="en"><head><title>Fine</title><meta name="description" content="d"><meta name="viewport" content="w">'
    '<meta property="og:title" content="t"><link rel="canonical" href="/"></head><body><h1>Fine</h1>'
    "<p>privacy sign up</p></body></html>"
)
SAFE = {
    "Strict-Transport-Security": "max-age=31536000; includeSubDomains", "Content-Security-Policy": "frame-ancestors 'none'",
    "X-Content-Type-Options": "nosniff", "Referrer-Policy": "no-referrer", "Permissions-Policy": "camera=()",
}


HEADER_CASES = [
    ({}, {"SEC_HSTS_MISSING", "SEC_CSP_MISSING", "SEC_XCTO_MISSING", "SEC_FRAME_PROTECTION_MISSING"}, {"SEC_HSTS_SHORT_MAXAGE"}),
    ({"strict-transport-security": "max-age=60"}, {"SEC_HSTS_NO_SUBDOMAINS", "SEC_HSTS_SHORT_MAXAGE"}, {"SEC_HSTS_MISSING"}),
    ({"strict-transport-security": "max-age=soon; includeSubDomains"}, set(), {"SEC_HSTS_SHORT_MAXAGE", "SEC_HSTS_NO_SUBDOMAINS"}),
    ({"content-security-policy": "script-src 'UNSAFE-INLINE'"}, {"SEC_CSP_UNSAFE_INLINE"}, {"SEC_CSP_MISSING", "SEC_CSP_UNSAFE_EVAL"}),
    ({"server": "nginx/1.2.3", "x-powered-by": "PHP"}, {"SEC_SERVER_VERSION_DISCLOSURE", "SEC_TECH_DISCLOSURE"}, set()),
    ({"server": "cloudflare"}, set(), {"SEC_SERVER_VERSION_DISCLOSURE"}),
]
BARE = "<html lang=en><title>T</title><h1>x</h1><img src=/a.png alt=a></html>"
WORDS = " ".join(f"word{i}" for i in range(4100))


def site(name, *pages):
    """Pages of one scan from (path, html, headers, status, depth)."""
    return [(name, i, f"https://{name}.example/{path}", *rest) for i, (path, *rest) in enumerate(pages)]


@pytest.fixture(scope="module")
def result(spark):
    """One audit of all the small sites below."""
    pages = site("clean", ("", CLEAN, SAFE, 200, 0)) + site("files", ("", CLEAN, SAFE, 200, 0)) + site("one", ("", BARE, SAFE, 200, 0))
    pages += site("two", *[(str(i), BARE, SAFE, 200, 0) for i in range(2)])
    for i, (headers, _, _) in enumerate(HEADER_CASES):
        pages += site(f"h{i}", ("", CLEAN, headers, 200, 0))
    pages += site(
        "rare", ("A_b", f"<p>{WORDS}</p>", SAFE, 200, 0), ("c", f"<title> </title><p>{WORDS}</p>" + " " * 1_600_000, SAFE, 500, 9))
    pages += site("mine", ("", "<title>x</title>", {}, 200, 0))
    files = [("files", 0, i, f"https://files.example/{i}.png", "IMAGE", False, "files.example", 400_000 + i) for i in range(12)]
    files.append(("files", 0, 20, "http://cdn.example/h.js", "JS", True, "cdn.example", 3 << 20))
    mine = Rule("MY_SHORT_TITLE", "SEO", "LOW", 0.5, "LOW", "LOW", "Titles of one letter.", 9000)
    families = FAMILIES | {"mine": page_predicate_rule(mine, (F.length("title") == 1) & (F.col("scan_id") == "mine"), "Short titles")}
    return audit(extract.page_rows(spark.createDataFrame(pages, PAGES)), spark.createDataFrame(files, RESOURCES), families)


@pytest.fixture(scope="module")
def found(result):
    out = {}
    for r in result.findings.collect():
        out.setdefault(r.scan_id, []).append(r)
    return out


def ids(rows):
    return {r.rule_id for r in rows}


def test_clean_site_is_quiet(found):
    assert ids(found["clean"]) == {"ARCH_SINGLE_PAGE", "CONTENT_THIN", "SEO_NO_INTERNAL_LINKS", "SEO_STRUCTURED_DATA_MISSING"}


@pytest.mark.parametrize("case", range(len(HEADER_CASES)))
def test_headers(found, case):
    _, present, absent = HEADER_CASES[case]
    rows = ids(found[f"h{case}"])
    assert present <= rows and not (absent & rows)


def test_rules_that_need_two_pages(found):
    for rule_id in ("SEO_CANONICAL_MISSING", "PERF_IMAGES_NO_DIMENSIONS", "SEO_DUPLICATE_TITLES", "CONTENT_REPEATED", "ARCH_NO_CDN"):
        assert rule_id not in ids(found["one"]) and rule_id in ids(found["two"])


def test_rules_the_tables_never_trigger(found):
    assert {
        "SEO_URL_STRUCTURE", "UX_CONTENT_DENSITY", "PERF_LARGE_HTML", "CONTENT_NO_HEADINGS", "UX_UNCLEAR_PURPOSE", "SEO_BROKEN_PAGES",
        "ARCH_DEEP_NESTING", "CONTENT_POTENTIAL_SIMILARITY", "CONTENT_REPEATED", "A11Y_HTML_LANG_MISSING",
    } <= ids(found["rare"])


def test_largest_files(found):
    rows = sorted((r for r in found["files"] if r.category == "PERFORMANCE"), key=lambda r: (r.rule_order, r.key1, r.key2))
    images = [r for r in rows if r.rule_id == "PERF_LARGE_IMAGE"]
    assert [r.affected_url.split("/")[-1] for r in images] == [f"{i}.png" for i in range(12)]
    assert ids(rows) == {"PERF_LARGE_IMAGE", "PERF_HUGE_RESOURCE", "PERF_LARGE_JS"}
    assert "SEC_MIXED_CONTENT" in ids(found["files"])


def test_own_rule(found):
    rows = [r for r in found["mine"] if r.rule_order == 9000]
    assert [(r.rule_id, r.title, r.confidence, r.affected_url) for r in rows] == [
        ("MY_SHORT_TITLE", "Short titles (1)", 0.5, "https://mine.example/")]


def test_stored_audit_is_complete(result, spark, tmp_path):
    write_audit(result, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "findings")).count() == result.findings.count()
    assert spark.read.parquet(str(tmp_path / "summaries")).where("headline LIKE 'Overall health score is %'").count() == 12
    assert spark.read.parquet(str(tmp_path / "graph_edges")).where("relationship = 'HOSTS'").count() == 14


def test_every_rule_has_its_place():
    orders = [r.order for r in RULES.values()]
    assert orders == sorted(set(orders)) and len(orders) == 70


def test_scores(spark):
    rows = [("s", "SECURITY", "MEDIUM", 1.0), ("s", "SEO", "INFO", 0.9), ("t", "UX", "CRITICAL", 1.0)] + [("t", "UX", "HIGH", 1.0)] * 9
    findings = spark.createDataFrame(rows, "scan_id string, category string, severity string, confidence double")
    scans = spark.createDataFrame([("s",), ("t",), ("u",)], "scan_id string")
    got = {r.scan_id: r for r in scoring.scan_scores(scans, findings).collect()}
    assert (got["s"].security_score, got["s"].seo_score, got["s"].ux_score) == (92.0, 100.0, None)
    assert got["s"].overall_score == 94.7
    assert (got["t"].ux_score, got["t"].overall_score) == (0.0, 0.0)
    assert got["u"].overall_score is None


def test_more_confidence_never_raises_a_score(spark):
    rows = [(f"s{i}", "SEO", "HIGH", i / 10) for i in range(11)]
    findings = spark.createDataFrame(rows, "scan_id string, category string, severity string, confidence double")
    scores = [r.score for r in scoring.category_scores(findings).orderBy(F.expr("int(substr(scan_id, 2))")).collect()]
    assert scores == sorted(scores, reverse=True)


def test_priority(spark):
    rows = [("CRITICAL", "CRITICAL", "LOW", 1.0, 1, 1), ("HIGH", "HIGH", "LOW", 1.0, 5, 10), ("LOW", "LOW", "HIGH", 2.0, 0, 0), ("odd", "odd", "odd", 0.5, 1, 2)]
    df = spark.createDataFrame(rows, "s string, i string, e string, c double, a int, t int")
    score = scoring.priority_score(*[F.col(x) for x in "siecat"])
    got = [(r[0], r[1]) for r in df.select(score, scoring.priority_bucket(score)).collect()]
    assert got == [(24.0, "P0"), (11.25, "P2"), (0.333, "P3"), (0.0, "P3")]


def test_first_comparisons_stop_as_defined(spark):
    body = " ".join(f"term{i:03d}" for i in range(60))
    docs = [("s", i, f"/{i}", body) for i in range(70)]
    profiles = spark.createDataFrame(docs, "scan_id string, seq bigint, url string, text string")
    got = [(r.seq_a, r.seq_b) for r in duplicates.first_comparisons(profiles, 60, 100).orderBy("seq_b").collect()]
    assert got == [(0, j) for j in range(1, 61)]
    assert duplicates.first_comparisons(profiles).count() == 5


def test_same_findings_at_any_partitioning(spark):
    pages = [("s", i, f"https://s.example/{i % 7}", CLEAN.replace("Fine", f"F{i % 5}"), {}, 404 if i % 6 == 0 else 200, 0) for i in range(40)]
    df = spark.createDataFrame(pages, PAGES)

    def facts(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            return page_facts(extract.page_profiles(extract.page_rows(df.repartition(parts)))).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert facts(1) == facts(50)
