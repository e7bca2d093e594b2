"""Lookups by id stay within the user's websites."""

from pagequarry.operators import graph, reports


def tables(spark):
    websites = spark.createDataFrame([("w1", 1), ("w2", 2)], "website_id string, user_id int")
    scans = spark.createDataFrame([("s1", "w1"), ("s2", "w2")], "scan_id string, website_id string")
    return scans, websites


def test_scans_findings_and_recommendations(spark):
    scans, websites = tables(spark)
    assert [r.website_id for r in reports.scan_by_id(scans, websites, 1, "s1").collect()] == ["w1"]
    assert reports.scan_by_id(scans, websites, 2, "s1").collect() == [] == reports.scan_by_id(scans, websites, 1, "s9").collect()
    rows = spark.createDataFrame([("f1", "s1", "A"), ("f2", "s2", "A"), ("f3", "s1", "B")], "finding_id string, scan_id string, rule_id string")
    assert [r.rule_id for r in reports.finding_by_id(rows, scans, websites, 1, "f3").collect()] == ["B"]
    assert reports.finding_by_id(rows, scans, websites, 1, "f2").collect() == []
    assert [r.finding_id for r in reports.recommendation_of_rule(rows, scans, websites, 1, "s1", "A").collect()] == ["f1"]
    assert reports.recommendation_of_rule(rows, scans, websites, 2, "s1", "A").collect() == []


def test_competitors_of_own_websites_alone(spark):
    _, websites = tables(spark)
    rivals = spark.createDataFrame([("c1", "w1"), ("c2", "w1"), ("c3", "w2"), ("c4", None)], "competitor_id string, website_id string")
    ids = lambda *a: sorted(r.competitor_id for r in reports.competitors_of_owner(rivals, websites, *a).collect())
    assert (ids(1), ids(2), ids(1, "w2"), ids(1, "w1")) == (["c1", "c2"], ["c3"], [], ["c1", "c2"])


def test_graph_of_one_scan_with_metadata(spark):
    scans, websites = tables(spark)
    pages = spark.createDataFrame(
        [(s, n, f"https://{s}.test/{n}", "t", 200 + n, n) for s in ("s1", "s2") for n in (0, 1)],
        "scan_id string, seq bigint, url string, title string, status_code int, depth int")
    resources = spark.createDataFrame(
        [("s1", 0, 0, "https://cdn.test/a", "JS", True, "cdn.test", 7), ("s1", 1, 0, "https://cdn.test/a", "JS", True, "cdn.test", None)],
        "scan_id string, seq bigint, ord bigint, url string, resource_type string, is_external boolean, domain string, size_bytes bigint")
    found = spark.createDataFrame([("s1", "Nginx", "Server", 0.9)], "scan_id string, name string, category string, confidence double")
    nodes = graph.graph_nodes(pages, resources, found)
    edges = graph.graph_edges(pages, resources)
    mine, links = graph.graph_of_scan(nodes, edges, scans, websites, 1, "s1")
    assert {(r.node_type, r.name): r.metadata for r in mine.collect()} == {
        ("DOMAIN", "s1.test"): {}, ("PAGE", "https://s1.test/0"): {"status_code": "200", "depth": "0"},
        ("PAGE", "https://s1.test/1"): {"status_code": "201", "depth": "1"}, ("TECHNOLOGY", "Nginx"): {"category": "Server", "confidence": "0.9"},
        ("THIRD_PARTY", "cdn.test"): {"resource_count": "2"}, ("RESOURCE", "https://cdn.test/a"): {"resource_type": "JS"}}
    assert {r.scan_id for r in links.collect()} == {"s1"}
    assert [rows.count() for rows in graph.graph_of_scan(nodes, edges, scans, websites, 2, "s1")] == [0, 0]
