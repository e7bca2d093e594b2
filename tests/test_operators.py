import random
from collections import Counter, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import compare, diff, duplicates, graph, hosts, model_output, reports, robots
from pagequarry.sources.tables import read_current, write_run
from pagequarry.streaming.admission import admit


def _multiset(body):
    import re

    words = re.findall(r"[a-z0-9]{3,}", body.lower())
    return Counter(" ".join(words[i:i + 6]) for i in range(len(words) - 5)) if len(words) >= 20 else Counter()


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i:03d}" for i in range(40)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(60):
        words = list(common)
        for _ in range(rng.choice([0, 0, 1, 2, 5, 30])):
            words[rng.randrange(60)] = rng.choice(vocabulary)
        docs.append((("g", "h")[i % 2], i, " ".join(words + words[:rng.choice([0, 12])])))
    bags = {d: _multiset(t) for _, d, t in docs}
    copies = {d: [e for h, e, _ in docs if h == g and bags[e] == bags[d]] for g, d, _ in docs}
    want = {}
    for g, a, _ in docs:
        for h, b, _ in docs:
            if g == h and a < b and min(copies[a]) == a and min(copies[b]) == b and bags[a] != bags[b]:
                score = sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values())
                if score >= 0.55:
                    want[(a, b)] = (len(copies[a]), len(copies[b]), round(score, 9))
    df = spark.createDataFrame(docs, "site string, doc bigint, body string")
    for block in (3, 512):  # 3 splits almost every token
        rows = duplicates.similar_pairs(df, "site", "doc", "body", block=block).collect()
        assert {(r.a, r.b): (r.copies_a, r.copies_b, round(r.score, 9)) for r in rows} == want
        assert len(rows) == len(want)
    groups = duplicates.copy_groups(df, "site", "doc", "body").collect()
    assert {r.doc: (r.representative, r.copies) for r in groups} == {d: (min(c), len(c)) for d, c in copies.items()}


def test_many_copies_give_no_pairs(spark):
    body = " ".join(f"term{i:03d}" for i in range(30))
    df = spark.createDataFrame([("s", i, body) for i in range(500)], "site string, doc bigint, body string")
    assert duplicates.similar_pairs(df, "site", "doc", "body").count() == 0
    assert duplicates.copy_groups(df, "site", "doc", "body").where("representative = 0 AND copies = 500").count() == 500


def test_crawl_order_and_page_limit(spark):
    rng = random.Random(5)
    links = {i: [rng.randrange(40) for _ in range(4)] for i in range(40)}
    down, refused = {7, 11}, {3}
    order, seen, queue = [], {0}, deque([(0, 0)])
    visited = set()
    while queue and len(order) < 15:
        page, depth = queue.popleft()
        if page in visited:
            continue
        visited.add(page)
        if page in down:
            continue
        order.append((page, depth))
        if depth < 3:
            queue.extend((to, depth + 1) for to in links[page] if to not in refused)
    assert seen
    url = "https://s.example/{}".format
    starts = spark.createDataFrame([("s", url(0))], "scan_id string, url string")
    table = spark.createDataFrame(
        [("s", url(a), url(b), i) for a, bs in links.items() for i, b in enumerate(bs)], "scan_id string, from_url string, to_url string, pos int")
    answering = spark.createDataFrame([("s", url(i)) for i in range(40) if i not in down], "scan_id string, url string")
    no = spark.createDataFrame([("s", url(i)) for i in refused], "scan_id string, url string")
    found = graph.reachable(starts, table, answering, 3, 15, no).orderBy("depth", "crawl_order").collect()
    assert [(r.url, r.depth) for r in found] == [(url(p), d) for p, d in order]


def test_layers(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")]
    nodes = spark.createDataFrame([("s", n) for n in "abcdx"], "scan_id string, node_id string")
    e = spark.createDataFrame([("s", *p) for p in edges], "scan_id string, source string, target string")
    rows = graph.index_in_layer(graph.layers(nodes, e)).collect()
    assert {r.node_id: (r.layer, r["index"]) for r in rows} == {"a": (0, 0), "x": (0, 1), "b": (1, 0), "c": (2, 0), "d": (3, 0)}
    loop = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("s", "b", "c"), ("s", "c", "c")], "scan_id string, source string, target string")
    rows = graph.layers(nodes, loop).collect()
    assert {r.node_id: (r.layer, r.component) for r in rows} == {"a": (0, "a"), "b": (0, "a"), "c": (1, "c"), "d": (0, "d"), "x": (0, "x")}


def test_components_and_layers_of_cyclic_graphs(spark):
    """Random graphs with nested and chained cycles, against closures of reachability."""
    rng = random.Random(9)
    names = [f"n{i:02d}" for i in range(26)]
    pairs = {"s": [(rng.choice(names), rng.choice(names)) for _ in range(30)], "t": [(rng.choice(names), rng.choice(names)) for _ in range(42)]}
    pairs["u"] = [(names[i], names[(i + 1) % 12]) for i in range(12)] + [(names[i], names[i + 1]) for i in range(12, 25)] + [("n03", "n15"), ("n20", "nowhere")]
    nodes = spark.createDataFrame([(s, n) for s in pairs for n in names], "scan_id string, node_id string")
    edges = spark.createDataFrame([(s, *p) for s, own in pairs.items() for p in own * 2], "scan_id string, source string, target string")
    want = {}
    for s, own in pairs.items():
        reach = {n: {n} for n in names}
        for _ in names:
            for a, b in own:
                if b in reach:
                    for r in reach.values():
                        if a in r:
                            r.add(b)
        component = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}
        layer = dict.fromkeys(names, 0)
        for _ in names:
            for a, b in own:
                if b in reach and component[a] != component[b]:
                    for m in names:
                        if component[m] == component[b]:
                            layer[m] = max(layer[m], layer[a] + 1)
        want |= {(s, n): (layer[n], component[n]) for n in names}
    rows = graph.layers(nodes, edges).collect()
    assert {(r.scan_id, r.node_id): (r.layer, r.component) for r in rows} == want and len(rows) == len(want)
    assert any(r.component != r.node_id for r in rows)


def test_robots(spark):
    body = (
        "Disallow: /before\r\nUser-agent: other\nDisallow: /\nUser-agent: a, auditbot\nDisallow: /missed\n"
        "User-agent: *\nDisallow: /p # x\nDisallow:\nAllow: /p/ok\nCrawl-delay: -3\nCrawl-delay: 5\nSitemap: s.xml\nnonsense\n"
    )
    bodies = spark.createDataFrame([("s.example", "https://s.example/d/", body)], "host string, base_url string, body string")
    rules = robots.robots_rules(bodies, "auditbot")
    assert [(r.kind, r.value) for r in rules.orderBy("pos").collect()] == [
        ("disallow", "/p # x"), ("allow", "/p/ok"), ("crawl-delay", "0.0"), ("sitemap", "https://s.example/d/s.xml")]
    simple = spark.createDataFrame([("s.example", 1, "disallow", "/p"), ("s.example", 2, "allow", "/p/ok")], "host string, pos bigint, kind string, value string")
    urls = spark.createDataFrame([(u,) for u in ("https://s.example//p/x", "https://s.example/p/ok/1", "https://s.example", "https://t.example/p")], "url string")
    assert [r.allowed for r in robots.can_fetch(urls, simple).select("url", "allowed").collect()].count(False) == 1


def test_hosts_and_addresses(spark):
    suffixes = spark.createDataFrame([(s,) for s in ("com", "uk", "co.uk", "*.ck", "!www.ck")], "suffix string")
    names = ["a.b.example.co.uk", "example.com", "x.y.ck", "z.x.y.ck", "www.ck", "b.www.ck", "co.uk", "odd.tld"]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    got = {r.host: r.domain for r in hosts.registrable_domains(df, suffixes).collect()}
    assert got == {
        "a.b.example.co.uk": "example.co.uk", "example.com": "example.com", "x.y.ck": "x.y.ck", "z.x.y.ck": "x.y.ck",
        "www.ck": "www.ck", "b.www.ck": "www.ck", "co.uk": "co.uk", "odd.tld": "odd.tld"}
    urls = {"https://example.com/": None, "http://localhost/": "blocked name", "https://db/": "single label", "ftp://example.com/": "scheme",
            "https://printer.local/": "private suffix", "https://corp.com/": "private name", "https:///x": "no hostname"}
    rows = hosts.target_policy(spark.createDataFrame([(u,) for u in urls], "url string"), suffixes).collect()
    assert {r.url: r.reason for r in rows} == urls
    ips = {"a": ["93.184.216.34"], "b": ["93.184.216.34", "10.0.0.1"], "c": ["::1"], "d": ["2606:4700::1", "1.1.1.1"], "e": ["0.0.0.0"],
           "f": ["169.254.169.254"], "g": ["::ffff:127.0.0.1"], "h": ["300.1.1.1"], "i": ["172.32.0.1"], "j": ["172.31.255.255"], "k": []}
    resolved = spark.createDataFrame([(h, ip) for h, xs in ips.items() for ip in xs], "host string, ip string")
    policy = hosts.address_policy(spark.createDataFrame([(h,) for h in ips], "host string"), resolved).collect()
    assert {r.host for r in policy if r.allowed} == {"a", "d", "i"}


def test_admission_against_a_plain_loop(spark):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    events, n = [], 0
    for key in ("a", "b", "c"):
        t = 0.0
        for _ in range(300):
            t += rng.choice([0, 1, 3, 7, 20, 61, 200])
            events.append((key, n, start + timedelta(seconds=t)))
            n += 1
    want = {}
    for key in ("a", "b", "c"):
        kept = deque()
        for _, i, ts in sorted((e for e in events if e[0] == key), key=lambda e: (e[2], e[1])):
            while kept and (ts - kept[0]).total_seconds() > 60:
                kept.popleft()
            want[i] = len(kept) < 10
            if want[i]:
                kept.append(ts)
    rng.shuffle(events)
    got = admit(spark.createDataFrame(events, "key string, event_id bigint, ts timestamp")).collect()
    assert {r.event_id: r.admitted for r in got} == want


def test_model_answers(spark):
    raws = [
        '{"recommendations": [{"title": "t", "confidence": 0.5, "finding_ids": ["1"]}]}', "```json\n{\"recommendations\": [{\"title\": \"t\"}]}\n```",
        'text {"recommendations": [{"title": "t"}]} text', '{"recommendations": [{"confidence": 0.5}]}', '{"recommendations": [{"title": "t", "confidence": -1}]}',
        '{"recommendations": [{"title": "t", "confidence": "sure"}]}', "[1]", "", '{"other": 1}']
    df = spark.createDataFrame([(f"s{i}", r) for i, r in enumerate(raws)], "scan_id string, raw string")
    checked = model_output.validate_lists(df, "recommendations").orderBy("scan_id").collect()
    assert [r.reason is None for r in checked] == [True, True, True] + [False] * 6
    assert checked[1]["items"][0].confidence == 0.5
    assert model_output.rejects(model_output.validate_lists(df, "recommendations")).count() == 6
    s = spark.createDataFrame([("a", '{"executive_summary": "x"}'), ("b", '{"headline": "x"}')], "scan_id string, raw string")
    summaries = model_output.validate_summaries(s)
    own = spark.createDataFrame([("a",), ("b",)], "scan_id string").select("scan_id", F.from_json(F.lit('{"headline": "own"}'), model_output.SUMMARY).alias("summary"))
    got = {r.scan_id: (r.from_model, r.summary.headline) for r in model_output.accepted_or_rule_based(summaries, own, "summary").collect()}
    assert got == {"a": (True, None), "b": (False, "own")}


def test_diff_properties(spark):
    labels = spark.createDataFrame([("1", "pages", x) for x in "abc"] + [("2", "pages", x) for x in "bcd"], "scan_id string, kind string, label string")

    def changes(before, after):
        pairs = spark.createDataFrame([("w", before, after)], "website_id string, base_scan_id string, compare_scan_id string")
        return {(r.type, r.label) for r in diff.set_changes(labels, pairs).collect()}

    assert changes("1", "2") == {("added", "d"), ("removed", "a")}
    swap = {"added": "removed", "removed": "added"}
    assert changes("2", "1") == {(swap[t], x) for t, x in changes("1", "2")}
    pairs = spark.createDataFrame([("w", "1", "1"), ("w", "1", "2"), ("v", "1", "2")], "website_id string, base_scan_id string, compare_scan_id string")
    scans = spark.createDataFrame([("w", "1"), ("w", "2")], "website_id string, scan_id string")
    assert [tuple(r) for r in diff.chosen_pairs(pairs, scans).collect()] == [("w", "1", "2")]


def test_latest_scans(spark):
    rows = [("w", "1", "2024-01-01", "COMPLETED"), ("w", "2", "2024-01-02", "FAILED"), ("w", "3", "2024-01-03", "QUEUED")]
    scans = spark.createDataFrame(rows, "website_id string, scan_id string, started_at string, status string")
    assert compare.latest_completed(scans).first().scan_id == "1"
    assert compare.latest_finished(scans).first().scan_id == "2"


def test_writing_a_scan_again_replaces_it(spark, tmp_path):
    def write(rows, *scans):
        found = spark.createDataFrame(rows, "scan_id string, x int")
        write_run({"t": found, "u": found.where("x > 2")}, spark.createDataFrame([(s,) for s in scans], "scan_id string"), str(tmp_path))

    def stored(name):
        return sorted((r.scan_id, r.x) for r in read_current(spark, str(tmp_path), name).collect())

    write([("a", 1), ("b", 2), ("c", 7), ("c", 8)], "a", "b", "c")
    assert stored("u") == [("c", 7), ("c", 8)]
    write([("a", 3), ("a", 4), ("c", 8)], "a", "c")
    assert stored("t") == [("a", 3), ("a", 4), ("b", 2), ("c", 8)]
    write([], "c")
    assert stored("t") == [("a", 3), ("a", 4), ("b", 2)] and stored("u") == [("a", 3), ("a", 4)]


def test_listings_keep_the_given_limit_and_know_new_findings(spark):
    rows = [("s", "HIGH", "SEO", i, 0, 0) for i in range(800)]
    found = spark.createDataFrame(rows, "scan_id string, severity string, category string, rule_order int, key1 int, key2 int")
    assert reports.list_findings(found, status="open", limit=700, offset=50).count() == 700
    assert reports.list_findings(found).count() == 800 and reports.list_findings(found, status="fixed").count() == 0
    with pytest.raises(ValueError):
        reports.list_findings(found, offset=5)


def test_pairs_exactly_at_the_threshold_are_kept(spark):
    from pagequarry.operators.duplicates import similar_pairs

    shared = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(105)]
    docs = spark.createDataFrame([("g", 1, " ".join(shared)), ("g", 2, " ".join(shared[:60]))], "g string, d int, t string")
    rows = similar_pairs(docs, "g", "d", "t", threshold=0.55).collect()
    assert [(r.a, r.b, r.score) for r in rows] == [(1, 2, 0.55)]
