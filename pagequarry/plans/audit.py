"""The whole audit: raw pages to findings, scores, recommendations, graph and summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import correlate, extract, graph, scoring, technology
from pagequarry.operators.rules.pages import page_facts
from pagequarry.plans.registry import AuditInputs, Family, failed_categories, guarded_findings
from pagequarry.session import materialize
from pagequarry.sources.tables import write_run


@dataclass(frozen=True)
class Audit:
    """Results of an audit, keyed by scan_id throughout; ``scans`` are all of them, with pages or without.

    ``status`` has COMPLETED or FAILED for each scan and category, ``failures`` what rule families failed with.
    Scores, recommendations and summaries are made when they are first asked for.
    """

    scans: DataFrame
    pages: DataFrame
    profiles: DataFrame
    facts: DataFrame
    resources: DataFrame
    technologies: DataFrame
    findings: DataFrame
    status: DataFrame
    failures: dict[str, str]
    keep: Callable[[DataFrame, str], DataFrame] = materialize

    @cached_property
    def scores(self) -> DataFrame:
        return self.keep(scoring.scan_scores(self.scans, self.findings), "scores")

    @cached_property
    def recommendations(self) -> DataFrame:
        return self.keep(correlate.ranked_recommendations(correlate.recommendations(self.findings), self.facts), "recommendations")

    @cached_property
    def summaries(self) -> DataFrame:
        return correlate.summaries(self.scores, self.findings, self.recommendations)

    def nodes(self) -> DataFrame:
        return graph.graph_nodes(self.profiles, self.resources, self.technologies)

    def edges(self) -> DataFrame:
        return graph.without_dangling(graph.graph_edges(self.profiles, self.resources), self.nodes())


def audit(
    pages: DataFrame, resources: DataFrame | None = None, families: dict[str, Family] | None = None, stage: bool = True,
    scans: DataFrame | None = None,
) -> Audit:
    """Audit all scans in ``pages`` (rows as made by ``page_rows``).

    Html is parsed once: profiles, facts and findings are written as stage tables
    and read back by whatever needs them. ``resources`` default to those found in
    the html, with sizes unknown. ``scans`` (scan_id) names scans that may have no pages;
    without it, the scans are those of ``pages``. A rule family that fails doesn't
    end the audit: its categories are FAILED and left out of the scores.
    """
    keep = materialize if stage else (lambda df, _label: df)
    profiles = keep(extract.page_profiles(pages), "profiles")
    facts = keep(page_facts(profiles), "facts")
    if resources is None:
        resources = extract.resources(pages).withColumn("size_bytes", F.lit(None).cast("bigint"))
    resources = keep(resources, "resources")
    technologies = technology.technologies(pages, resources)
    findings, failures = guarded_findings(AuditInputs(profiles, facts, resources), families, keep)
    every = facts.select("scan_id") if scans is None else keep(scans.select("scan_id").unionByName(facts.select("scan_id")).distinct(), "scans")
    status = scoring.analyzer_status(every, profiles, failed_categories(failures))
    return Audit(every, pages, profiles, facts, resources, technologies, findings, status, failures, keep)


def write_audit(result: Audit, folder: str) -> None:
    """Store every table of an audit; scans already stored are replaced, all tables at once (see ``write_run``)."""
    tables = {
        "page_profiles": result.profiles.drop("text"),
        "resources": result.resources,
        "technologies": result.technologies,
        "findings": result.findings,
        "status": result.status,
        "scores": result.scores,
        "recommendations": result.recommendations,
        "summaries": result.summaries,
        "graph_nodes": result.nodes(),
        "graph_edges": result.edges(),
    }
    write_run(tables, result.scans, folder)
