"""Scans without pages, rule families that fail, and the sink between two writes."""

import os

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import extract
from pagequarry.plans import registry
from pagequarry.plans.audit import audit, write_audit
from pagequarry.plans.registry import FAMILIES
from pagequarry.sources.tables import commits, compact, current_runs, read_current, remove_old_runs, write_run
from tests.test_rules import CLEAN, PAGES

ROWS = "scan_id string, v int"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("a", 0, "https://a.example/", CLEAN, {}, 200, 0), ("a", 1, "https://a.example/x", "<p>short", {}, 404, 1), ("b", 0, "https://b.example/", CLEAN, {}, 200, 0)]
    return extract.page_rows(spark.createDataFrame(rows, PAGES))


def broken_plan(inputs):
    return inputs.profiles.select("no such column")


def broken_run(inputs):
    return registry.all_findings(inputs, {n: FAMILIES[n] for n in ("titles", "page facts")}).withColumn("title", F.expr("CAST(raise_error('rule broke') AS STRING)"))


def test_a_failing_family_fails_its_categories_only(spark, pages, monkeypatch):
    monkeypatch.setattr(registry, "FAMILY_CATEGORIES", registry.FAMILY_CATEGORIES | {"p": ("UX",), "r": ("SEO", "SECURITY")})
    some = {n: FAMILIES[n] for n in ("page facts", "listed pages", "titles")}
    whole = audit(pages, families=some)
    scans = spark.createDataFrame([("a",), ("b",), ("empty",)], "scan_id string")
    got = audit(pages, families=some | {"p": broken_plan, "r": broken_run}, scans=scans)
    assert set(got.failures) == {"p", "r"} and "rule broke" in got.failures["r"] and not whole.failures
    lost = {"UX", "SEO", "SECURITY"}
    assert {r.category for r in got.findings.collect()} == {r.category for r in whole.findings.collect()} - lost
    status = {(r.scan_id, r.category): r.status for r in got.status.collect()}
    assert len(status) == 24
    for (scan, category), value in status.items():
        needs_pages = category not in ("ARCHITECTURE", "PRIVACY")
        assert value == ("FAILED" if category in lost or (scan == "empty" and needs_pages) else "COMPLETED")
    scores, before = ({r.scan_id: r for r in x.scores.collect()} for x in (got, whole))
    assert set(scores) == {"a", "b", "empty"} and scores["empty"].overall_score is None
    assert scores["a"].seo_score is None and scores["a"].content_score == before["a"].content_score is not None


def test_no_family_left_is_an_error(pages):
    with pytest.raises(RuntimeError, match="no rule family works"):
        audit(pages, families={"p": broken_plan})


def test_a_rescan_without_pages_empties_the_scan(spark, pages, tmp_path):
    some = {"page facts": FAMILIES["page facts"]}
    write_audit(audit(pages, families=some), str(tmp_path))
    assert {r.scan_id for r in read_current(spark, str(tmp_path), "findings").collect()} == {"a", "b"}
    again = audit(pages.where("scan_id = 'b'"), families=some, scans=spark.createDataFrame([("a",), ("b",)], "scan_id string"))
    write_audit(again, str(tmp_path))
    assert {r.scan_id for r in read_current(spark, str(tmp_path), "findings").collect()} == {"b"}
    assert {r.scan_id: r.overall_score is None for r in read_current(spark, str(tmp_path), "scores").collect()} == {"a": True, "b": False}
    assert {r.scan_id for r in current_runs(spark, str(tmp_path)).collect()} == {"a", "b"}


def values(spark, folder, name):
    return sorted((r.scan_id, r.v) for r in read_current(spark, folder, name).collect())


def test_readers_see_whole_runs_and_old_ones_go(spark, tmp_path):
    folder = str(tmp_path)

    def rows(*pairs):
        return spark.createDataFrame(pairs, ROWS)

    scans = spark.createDataFrame([("a",), ("b",)], "scan_id string")
    write_run({"t": rows(("a", 1), ("b", 1)), "u": rows(("a", 10))}, scans, folder)
    # A run that ends before its commit is seen by nobody.
    rows(("a", 99)).write.parquet(f"{folder}/t/run=unfinished")
    scans.write.parquet(f"{folder}/runs/run=unfinished")
    assert values(spark, folder, "t") == [("a", 1), ("b", 1)] and values(spark, folder, "u") == [("a", 10)]
    for v in range(2, 6):
        write_run({"t": rows(("a", v)), "u": rows(("a", 10 * v))}, scans.where("scan_id = 'a'"), folder)
        assert values(spark, folder, "t") == [("a", v), ("b", 1)] and values(spark, folder, "u") == [("a", 10 * v)]
    assert [r.number for r in commits(spark, folder).orderBy("number").collect()] == [1, 2, 3, 4, 5]
    compact(spark, folder, ["t", "u"])
    assert values(spark, folder, "t") == [("a", 5), ("b", 1)] and values(spark, folder, "u") == [("a", 50)]
    assert remove_old_runs(spark, folder, ["t", "u"]) == 5
    assert values(spark, folder, "t") == [("a", 5), ("b", 1)] and values(spark, folder, "u") == [("a", 50)]
    assert len([x for x in os.listdir(f"{folder}/t") if x.startswith("run=") and x != "run=unfinished"]) == 1
