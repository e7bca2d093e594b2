"""Steps whose work has to grow no faster than their input."""

from __future__ import annotations

from collections import Counter

from pagequarry.operators import duplicates, graph
from pagequarry.sources import tables

DOCS = "site string, doc bigint, body string"
WORDS = [f"word{i:03d}" for i in range(30)]


def counts_of(rows):
    found = Counter()
    for site, doc, body in rows:
        words = (body or "").split()
        if len(words) >= 20:
            for i in range(len(words) - 5):
                found[site, doc, " ".join(words[i:i + 6])] += 1
    return found


def test_shingles_of_a_row_are_counted_within_it(spark):
    text, again = " ".join(WORDS), " ".join(WORDS * 3)
    rows = [("a", 1, text), ("a", 2, again), ("a", 2, text), ("b", 2, again), ("b", 3, None), ("b", 4, "too short"), (None, 5, text), (None, 5, text)]
    rows += [("c", None, text), ("c", None, again)]
    got = duplicates.shingle_counts(spark.createDataFrame(rows, DOCS), "site", "doc", "body")
    assert {(r.site, r.doc, r.shingle): r.n for r in got.collect()} == dict(counts_of(rows))
    assert "Generate inline(" in got._jdf.queryExecution().toString()


def test_tokens_of_texts_are_not_written_or_sent_back_whole(spark, monkeypatch):
    """Only tokens that several texts have go back to their texts, with places as if all were sorted, rarest first."""
    written, materialize = [], duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    common = WORDS[:24]
    rows = [("a", i, " ".join([*common, *[f"own{i}x{k}" for k in range(16)]])) for i in range(5)] + [("b", 9, " ".join(WORDS))]
    prefixed, _ = duplicates._prefixes(spark.createDataFrame(rows, DOCS), "site", "doc", "body", 0.3)
    got = {r.doc: r for r in prefixed.collect()}
    assert "tokens" not in written
    assert {len(set(r.tokens)) for r in got.values()} == {35, 25} and got[9].prefix == []
    # 16 tokens of 35 stand in one text alone; the prefix has 35 - ceil(0.3 * 35) + 1 = 25, so nine that all five share.
    assert all([(p.df, p.place) for p in got[i].prefix] == [(5, 16 + k) for k in range(9)] for i in range(5))


def test_a_table_in_few_splits_gets_several_per_core(spark):
    few = spark.range(0, 1000, 1, 1)
    wanted = tables.SPLITS_PER_CORE * spark.sparkContext.defaultParallelism
    assert tables.SPLITS_PER_CORE > 1
    assert tables.spread(few).rdd.getNumPartitions() == wanted
    many = spark.range(0, 1000, 1, wanted + 1)
    assert tables.spread(many) is many


def test_rounds_of_layers_send_nothing_through_the_driver(spark, monkeypatch):
    plans, materialize = [], graph.materialize

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(graph, "materialize", noted)
    links = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "b"), ("s", "c", "d")]
    nodes = spark.createDataFrame([("s", n) for n in "abcd"], "scan_id string, node_id string")
    got = graph.layers(nodes, spark.createDataFrame(links, "scan_id string, source string, target string"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {(r.node_id, r.layer, r.component) for r in got.collect()} == {("a", 0, "a"), ("b", 1, "b"), ("c", 1, "b"), ("d", 2, "d")}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_tokens_are_numbered_once_before_they_meet(spark, monkeypatch):
    """A filter on the size of the tokens would sort all shingles of a text a second time, ahead of the join."""
    plans, materialize = {}, duplicates.materialize

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(duplicates, "materialize", noted)
    duplicates._prefixes(spark.createDataFrame([("a", 1, " ".join(WORDS))], DOCS), "site", "doc", "body", 0.55)
    assert not [line for line in plans["prefixes"].splitlines() if "Filter" in line and "transform(" in line]


def test_an_audit_makes_what_is_asked_for(spark, monkeypatch):
    from pagequarry.operators.extract import page_rows
    from pagequarry.plans import audit as plan

    labels, materialize = [], plan.materialize
    monkeypatch.setattr(plan, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    raw = spark.createDataFrame([("s", 1, "https://s.example/", "<html><body><p>hello</p></body></html>")], "scan_id string, seq bigint, url string, html string")
    found = plan.audit(page_rows(raw))
    assert found.findings.count() > 0 and "scores" not in labels and "recommendations" not in labels
    assert found.scores.count() == 1 and found.scores is found.scores and labels.count("scores") == 1
    assert found.summaries.count() == 1 and labels.count("recommendations") == 1


def test_technology_changes_need_no_audit(spark, monkeypatch):
    from testkit import catalog

    def no_audit(*args):
        raise AssertionError("an audit for technologies alone")

    monkeypatch.setattr(catalog, "audited", no_audit)
    folder = "/root/testdata/sf0.001"
    assert catalog.QUERIES["technology_changes"](spark, folder).count() > 0
    assert catalog.QUERIES["set_changes"](spark, folder).count() > 0
