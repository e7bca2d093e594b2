"""How a rule becomes finding rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.rules.catalog import Rule

EVIDENCE_TYPE = "array<struct<evidence_type:string,source:string,value:string,metadata:map<string,string>>>"
FINDING_FIELDS = (
    "finding_id", "scan_id", "category", "rule_id", "rule_order", "key1", "key2", "title", "description",
    "severity", "confidence", "impact", "effort", "affected_url", "evidence",
)
TITLE_CHARS = 500


def text(*parts: Column | str) -> Column:
    """Concatenate literals and columns; numbers are printed as they are."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def evidence(kind: str, source: Column, value: Column, **metadata: Column) -> Column:
    """One piece of evidence as a one-element array."""
    pairs = [x for name, v in metadata.items() for x in (F.lit(name), v.cast("string"))]
    meta = F.create_map(*pairs) if pairs else F.lit(None)
    return F.array(F.struct(F.lit(kind), source, value, meta)).cast(EVIDENCE_TYPE)


def no_evidence() -> Column:
    return F.array().cast(EVIDENCE_TYPE)


_DRAFT = f"struct<rule_order:int,key1:bigint,key2:bigint,title:string,affected_url:string,evidence:{EVIDENCE_TYPE},confidence:double>"


def finding(
    rule: Rule,
    title: Column,
    affected_url: Column | None = None,
    evidence: Column | None = None,
    confidence: Column | None = None,
    key1: Column | None = None,
    key2: Column | None = None,
) -> Column:
    """What a rule says about one row; ``complete`` adds what the catalog knows."""
    nothing = F.lit(None)
    return F.struct(
        F.lit(rule.order), F.lit(0) if key1 is None else key1, F.lit(0) if key2 is None else key2, title,
        nothing if affected_url is None else affected_url, nothing if evidence is None else evidence,
        nothing if confidence is None else confidence,
    ).cast(_DRAFT)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _catalog_map(rules: list[Rule]) -> Column:
    """The rules' constants as one map literal, folded once and looked up per finding."""
    rows = ", ".join(
        f"{r.order}, named_struct('category', {_sql_text(r.category)}, 'rule_id', {_sql_text(r.rule_id)},"
        f" 'description', {_sql_text(r.description)}, 'severity', '{r.severity}',"
        f" 'confidence', CAST({'NULL' if r.confidence is None else r.confidence} AS DOUBLE), 'impact', '{r.impact}', 'effort', '{r.effort}')"
        for r in rules
    )
    return F.expr(f"map({rows})")


def complete(drafts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Drafts (scan_id plus the draft fields) to finding rows.

    A finding's id is made of the scan, the rule and the row's own key, so it needs
    no numbering and stays the same when a scan is analysed again.
    """
    known = drafts.withColumn("c", F.try_element_at(_catalog_map(rules), F.col("rule_order")))
    return known.select(
        F.concat_ws("|", "scan_id", "c.category", "c.rule_id", "key1", "key2").alias("finding_id"),
        "scan_id", "c.category", "c.rule_id", "rule_order", "key1", "key2",
        F.substring("title", 1, TITLE_CHARS).alias("title"), "c.description", "c.severity",
        F.coalesce("confidence", "c.confidence").alias("confidence"), "c.impact", "c.effort", "affected_url",
        F.coalesce("evidence", no_evidence()).alias("evidence"),
    )


@dataclass(frozen=True)
class ScanRule:
    """A rule decided on one row: its condition and the draft it gives."""

    rule: Rule
    when: Column
    draft: Column


def when(rule: Rule, condition: Column | bool, title: Column, *args: Column | None, **kwargs: Column) -> ScanRule:
    return ScanRule(rule, F.lit(condition) if isinstance(condition, bool) else condition, finding(rule, title, *args, **kwargs))


def emit(rows: DataFrame, rules: list[ScanRule]) -> DataFrame:
    """All findings the rules give for the rows, by projections and one explode; no shuffle."""
    drafts = F.filter(F.array(*[F.when(r.when, r.draft) for r in rules]), lambda d: d.isNotNull())
    return complete(rows.select("scan_id", F.inline(drafts)), [r.rule for r in rules])
