"""Rule families: functions from audit inputs to finding rows.

Users add a family with ``@family("name")`` or a simple rule with
``page_predicate_rule``; ``all_findings`` unions every registered family.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import duplicates
from pagequarry.operators.rules import pages as page_rules
from pagequarry.operators.rules import resources as resource_rules
from pagequarry.operators.rules.base import FINDING_FIELDS, emit, evidence, text, when
from pagequarry.operators.rules.catalog import Rule
from pagequarry.operators.scoring import CATEGORIES
from pagequarry.session import materialize


@dataclass(frozen=True)
class AuditInputs:
    """What a family may read: page profiles, per-scan page facts, resources."""

    profiles: DataFrame
    facts: DataFrame
    resources: DataFrame


Family = Callable[[AuditInputs], DataFrame]

FAMILIES: dict[str, Family] = {
    "page facts": lambda i: page_rules.page_rule_findings(i.facts),
    "first pages": lambda i: page_rules.unclear_purpose(i.profiles),
    "listed pages": lambda i: page_rules.listed_pages(i.profiles, i.facts),
    "exposure": lambda i: page_rules.exposure(i.profiles, i.facts),
    "json-ld": lambda i: page_rules.invalid_json_ld(i.profiles, i.facts),
    "titles": lambda i: duplicates.duplicate_title_findings(i.profiles),
    "openings": lambda i: duplicates.repeated_opening_findings(i.profiles),
    "similarity": lambda i: duplicates.similarity_findings(i.profiles),
    "resources": lambda i: resource_rules.resource_rule_findings(i.resources, i.facts),
    "large files": lambda i: resource_rules.large_files(i.resources),
}


#: The categories whose findings a family gives; all of them fail with it.
FAMILY_CATEGORIES: dict[str, tuple[str, ...]] = {
    "page facts": CATEGORIES, "first pages": ("UX",), "listed pages": ("CONTENT", "SEO"), "exposure": ("SECURITY",), "json-ld": ("SEO",),
    "titles": ("SEO",), "openings": ("CONTENT",), "similarity": ("CONTENT",), "resources": ("ARCHITECTURE", "PERFORMANCE", "PRIVACY", "SECURITY"),
    "large files": ("PERFORMANCE",),
}


def family(name: str, categories: tuple[str, ...] = ()) -> Callable[[Family], Family]:
    """Register a family; should it fail, the scores of ``categories`` count as not measured."""
    def register(fn: Family) -> Family:
        FAMILIES[name] = fn
        FAMILY_CATEGORIES[name] = categories
        return fn

    return register


def page_predicate_rule(rule: Rule, predicate: Column, title: str, least: int = 1) -> Family:
    """A family for one user rule: scans where at least ``least`` pages satisfy the predicate."""
    def build(inputs: AuditInputs) -> DataFrame:
        per_scan = inputs.profiles.where(predicate).groupBy("scan_id").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("url", "seq").alias("url")
        )
        shown = evidence("PAGE", F.col("url"), text("pages=", F.col("n")))
        return emit(per_scan, [when(rule, F.col("n") >= least, text(title, " (", F.col("n"), ")"), F.col("url"), shown)])

    return build


def all_findings(inputs: AuditInputs, families: dict[str, Family] | None = None) -> DataFrame:
    """Findings of every family. Rows carry their own order key, so a plain union is enough."""
    parts = [fn(inputs) for fn in (FAMILIES if families is None else families).values()]
    return reduce(DataFrame.unionByName, parts)


def guarded_findings(
    inputs: AuditInputs, families: dict[str, Family] | None = None, keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> tuple[DataFrame, dict[str, str]]:
    """Findings of the families that work, written, and what the others failed with.

    Families that can't be planned are left out at once. The rest run as one job; only if that fails does each run by
    itself, to find the ones at fault. Findings of a category that a failed family belongs to are dropped: half of a
    category would be scored as all of it.
    """
    planned: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, fn in (FAMILIES if families is None else families).items():
        try:
            planned[name] = fn(inputs).select(*FINDING_FIELDS)
        except Exception as error:  # noqa: BLE001
            failed[name] = str(error)
    try:
        found = keep(reduce(DataFrame.unionByName, planned.values()), "findings") if planned else None
    except Exception:  # noqa: BLE001
        parts = []
        for name, rows in planned.items():
            try:
                parts.append(keep(rows, "findings"))
            except Exception as error:  # noqa: BLE001
                failed[name] = str(error)
        found = reduce(DataFrame.unionByName, parts) if parts else None
    if found is None:
        raise RuntimeError(f"no rule family works: {failed}")
    lost = failed_categories(failed)
    return (found.where(~F.col("category").isin(*lost)) if lost else found), failed


def failed_categories(failed: dict[str, str]) -> frozenset[str]:
    return frozenset(c for name in failed for c in FAMILY_CATEGORIES.get(name, ()))
