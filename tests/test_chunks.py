"""Evidence texts hold every finding, are whole JSON and keep their length."""

import json

from pyspark.sql import functions as F

from pagequarry.operators.correlate import evidence_chunks

FINDINGS = """scan_id string, finding_id string, rule_order int, rule_id string, category string, title string, description string, severity string,
 impact string, effort string, confidence double, affected_url string, evidence array<struct<evidence_type:string,source:string,value:string>>"""


def finding(scan, nth, title="t", evidence=((None, None, None),), rule=None):
    return (scan, f"{scan}|{nth}", rule if rule is not None else nth % 7, "R", "SEO", title, "d" * 400, "LOW", "LOW", "LOW", 0.5, None, list(evidence))


def read(df, most):
    found, texts = {}, {}
    for r in evidence_chunks(df, most).orderBy("scan_id", "chunk_start").collect():
        some = json.loads(r.context)["findings"]
        assert r.finding_count == len(some)
        found.setdefault(r.scan_id, []).extend(f["finding_id"] for f in some)
        texts.setdefault(r.scan_id, []).append((len(r.context), len(some)))
    return found, texts


def test_every_finding_is_in_one_text_and_texts_are_bounded(spark):
    odd = "\u00e9\U0001f600 \"quoted\" \\ \n"
    rows = [finding("a", i, odd * (i % 9), [("URL", "s" * 300, odd * 50)] * (i % 4)) for i in range(400)]
    rows += [finding("b", i, rule=3) for i in range(90)] + [finding("c", 0, "x" * 9000), *(finding("c", i) for i in range(1, 30))]
    found, texts = read(spark.createDataFrame(rows, FINDINGS), 6000)
    assert {k: sorted(v) for k, v in found.items()} == {s: sorted(r[1] for r in rows if r[0] == s) for s in "abc"}
    assert len(texts["a"]) > 20 and all(size <= 6000 for s in "ab" for size, _ in texts[s])
    assert [n for size, n in texts["c"] if size > 6000] == [1]
    # But for the last one, texts are half full at least where no finding stands alone.
    assert all(size > 3000 - 1200 for size, _ in texts["b"][:-1])


def test_order_is_by_rule_and_the_same_however_the_rows_lie(spark):
    df = spark.createDataFrame([finding("a", i) for i in range(300)], FINDINGS)
    one, two = read(df, 4000)[0]["a"], read(df.repartition(5, F.rand(3)), 4000)[0]["a"]
    rules = [int(i.split("|")[1]) % 7 for i in one]
    assert one == two and rules == sorted(rules)


def test_no_findings_no_text_and_nulls(spark):
    assert read(spark.createDataFrame([], FINDINGS), 4000) == ({}, {})
    nothing = ("a", "a|0", 1) + (None,) * 10
    found, _ = read(spark.createDataFrame([nothing, nothing], FINDINGS), 4000)
    assert found == {"a": ["a|0", "a|0"]}
