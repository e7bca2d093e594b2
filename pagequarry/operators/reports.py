"""Reports, listings and counts over findings, recommendations and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.compare import latest_finished
from pagequarry.operators.correlate import ORDER
from pagequarry.operators.scoring import CATEGORIES

# Fixed value: the status of a finding nobody has worked on yet.
NEW_STATUS = "OPEN"


def owned(rows: DataFrame, websites: DataFrame, user_id: Column | int, key: str = "website_id") -> DataFrame:
    """Rows of one user's websites."""
    return rows.join(websites.where(F.col("user_id") == user_id).select(key), key, "left_semi")


def scan_by_id(scans: DataFrame, websites: DataFrame, user_id: Column | int, scan_id: str) -> DataFrame:
    """The scan, if it belongs to a website of the user; else no row."""
    return owned(scans.where(F.col("scan_id") == scan_id), websites, user_id)


def of_owner(rows: DataFrame, scans: DataFrame, websites: DataFrame, user_id: Column | int) -> DataFrame:
    """Rows (findings, recommendations, ...) whose scan belongs to a website of the user."""
    return rows.join(owned(scans, websites, user_id).select("scan_id"), "scan_id", "left_semi")


def finding_by_id(findings: DataFrame, scans: DataFrame, websites: DataFrame, user_id: Column | int, finding_id: str) -> DataFrame:
    """The finding, if its scan is the user's; else no row."""
    return of_owner(findings.where(F.col("finding_id") == finding_id), scans, websites, user_id)


def recommendation_of_rule(
    recommendations: DataFrame, scans: DataFrame, websites: DataFrame, user_id: Column | int, scan_id: str, rule_id: str,
) -> DataFrame:
    """The recommendation of a rule in a scan of the user; a scan has one for each rule."""
    wanted = recommendations.where((F.col("scan_id") == scan_id) & (F.col("rule_id") == rule_id))
    return of_owner(wanted, scans, websites, user_id)


def competitors_of_owner(competitors: DataFrame, websites: DataFrame, user_id: Column | int, website_id: str | None = None) -> DataFrame:
    """The competitors of one website of the user, or of all of them; none of a website of somebody else."""
    wanted = competitors if website_id is None else competitors.where(F.col("website_id") == website_id)
    return owned(wanted, websites, user_id)



def list_findings(
    findings: DataFrame, scan_id: str | None = None, category: str | None = None, severity: str | None = None,
    status: str | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Filtered findings in alphabetical order of severity; filters reach the scan, limits become a top-k.

    Findings straight from an audit have no status column: they are new.
    """
    out = findings if "status" in findings.columns else findings.withColumn("status", F.lit(NEW_STATUS))
    for column, value in (("scan_id", scan_id), ("category", category and category.upper()),
                          ("severity", severity and severity.upper()), ("status", status and status.upper())):
        if value is not None:
            out = out.where(F.col(column) == value)
    return _part(out.orderBy("severity", "scan_id", *ORDER), limit, offset)


def _part(ordered: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``. An offset alone would send all rows to one task, so it needs a limit."""
    if limit is None:
        if offset:
            raise ValueError("an offset needs a limit")
        return ordered
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def list_recommendations(
    recommendations: DataFrame, scan_id: str | None = None, category: str | None = None, priority: str | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    out = recommendations
    for column, value in (("scan_id", scan_id), ("category", category and category.upper()), ("priority", priority and priority.upper())):
        if value is not None:
            out = out.where(F.col(column) == value)
    return _part(out.orderBy(F.desc("priority_score"), "scan_id", "position"), limit, offset)


def display_order(recommendations: DataFrame) -> DataFrame:
    """Recommendations by priority, then score."""
    return recommendations.orderBy("priority", F.desc("priority_score"), "scan_id", "position")


def count_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def _completed_of_users(scans: DataFrame, websites: DataFrame) -> DataFrame:
    return scans.where(F.col("status") == "COMPLETED").join(websites.select("website_id", "user_id"), "website_id").select("scan_id", "user_id")


def critical_per_user(findings: DataFrame, scans: DataFrame, websites: DataFrame, severity: str = "CRITICAL") -> DataFrame:
    """Findings of a severity in completed scans, per user; counted per scan before the join."""
    per_scan = findings.where(F.col("severity") == severity).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    return per_scan.join(_completed_of_users(scans, websites), "scan_id").groupBy("user_id").agg(F.sum("n").alias("findings"))


def top_recommendations_per_user(recommendations: DataFrame, scans: DataFrame, websites: DataFrame, keep: int = 5) -> DataFrame:
    joined = recommendations.join(_completed_of_users(scans, websites), "scan_id")
    order = Window.partitionBy("user_id").orderBy(F.desc("priority_score"), "scan_id", "position")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select(
        "user_id", F.col("place").cast("bigint").alias("place"), "scan_id", "rule_id", "priority", "priority_score"
    )


def user_stats(websites: DataFrame, scans: DataFrame) -> DataFrame:
    """Websites and scans of each user."""
    per_site = scans.groupBy("website_id").agg(F.count(F.lit(1)).alias("scans"))
    return websites.join(per_site, "website_id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("websites"), F.sum(F.coalesce("scans", F.lit(0))).alias("scans")
    )


def newest_first(rows: DataFrame, column: str = "started_at", limit: int | None = None, offset: int = 0, *ties: str) -> DataFrame:
    return _part(rows.orderBy(F.desc_nulls_last(column), *ties), limit, offset)


def dashboard(websites: DataFrame, scans: DataFrame) -> DataFrame:
    """Each site with its latest scan, most recent first; sites never scanned come last."""
    newest = F.max_by(F.struct("scan_id", "started_at", "status"), F.struct("started_at", "scan_id"))
    latest = scans.groupBy("website_id").agg(newest.alias("s")).select("website_id", "s.*")
    return websites.join(latest, "website_id", "left").orderBy(F.desc_nulls_last("started_at"), "website_id")


def executive_reports(
    scans: DataFrame, websites: DataFrame, scores: DataFrame, summaries: DataFrame, findings: DataFrame, ranked: DataFrame,
) -> DataFrame:
    """One row per scan: scores, summary, up to 5 critical and 8 high findings, 5 recommendations."""
    severe = findings.where(F.col("severity").isin("CRITICAL", "HIGH")).select("scan_id", "severity", "title", *ORDER)
    order = Window.partitionBy("scan_id", "severity").orderBy(*ORDER)
    risks = (
        severe.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 8)
        .where((F.col("severity") == "HIGH") | (F.col("nth") <= 5))
        .groupBy("scan_id").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("severity", "nth", "title"))),
                lambda r: F.struct(r["title"].alias("title"), r["severity"].alias("severity")),
            ).alias("top_findings")
        )
    )
    best = ranked.where(F.col("rank") <= 5).groupBy("scan_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "title", "priority", "impact", "effort", "confidence"))),
            lambda r: F.struct(*[r[c].alias(c) for c in ("title", "priority", "impact", "effort", "confidence")]),
        ).alias("top_recommendations")
    )
    site = websites.select("website_id", F.col("normalized_url").alias("website_url"))
    return (
        scans.select("scan_id", "website_id", "status", "started_at").join(site, "website_id", "left")
        .join(scores, "scan_id", "left").join(summaries, "scan_id", "left").join(risks, "scan_id", "left").join(best, "scan_id", "left")
        .select(
            "scan_id", "website_url", "status", "started_at", "overall_score", *[f"{c.lower()}_score" for c in CATEGORIES],
            "headline", "executive_summary", "top_risks", "biggest_opportunities", "roadmap",
            F.coalesce("top_findings", F.array().cast("array<struct<title:string,severity:string>>")).alias("top_findings"),
            F.coalesce(
                "top_recommendations",
                F.array().cast("array<struct<title:string,priority:string,impact:string,effort:string,confidence:double>>"),
            ).alias("top_recommendations"),
        )
    )


def developer_report(findings: DataFrame) -> DataFrame:
    """Findings with evidence in report order: INFO first, the rest alphabetical by severity.

    Rows, not one array per scan: a scan may have any number of findings.
    """
    return findings.withColumn("not_info", (F.col("severity") != "INFO").cast("int")).orderBy(
        "scan_id", "not_info", "severity", *ORDER
    ).drop("not_info")


def developer_report_heads(scans: DataFrame, pages: DataFrame, findings: DataFrame, technologies: DataFrame) -> DataFrame:
    """Counts and technologies that go with each developer report."""
    found = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_count"))
    analyzed = pages.groupBy("scan_id").agg(F.count(F.lit(1)).alias("pages_analyzed"))
    named = technologies.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("name", "category", "confidence"))).alias("technologies"))
    zero = F.lit(0).cast("bigint")
    return scans.select("scan_id", "status").join(found, "scan_id", "left").join(analyzed, "scan_id", "left").join(named, "scan_id", "left").select(
        "scan_id", "status", F.coalesce("findings_count", zero).alias("findings_count"),
        F.coalesce("pages_analyzed", zero).alias("pages_analyzed"), "technologies",
    )


def attach_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with their evidence rows nested, by one aggregate and one left join."""
    nested = evidence.groupBy("finding_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "evidence_type", "source", "value"))).alias("evidence")
    )
    return findings.drop("evidence").join(nested, "finding_id", "left")


def flat_evidence(findings: DataFrame) -> DataFrame:
    """The evidence table: one row per piece of evidence."""
    return findings.select("finding_id", "scan_id", F.posexplode("evidence").alias("position", "e")).select(
        "finding_id", "scan_id", F.col("position").cast("bigint").alias("position"), "e.*"
    )


def first_websites(websites: DataFrame) -> DataFrame:
    """One row per user and normalized URL: the website created first."""
    others = [c for c in websites.columns if c not in ("user_id", "normalized_url")]
    first = websites.groupBy("user_id", "normalized_url").agg(F.min_by(F.struct(*others), F.struct("created_at", "website_id")).alias("w"))
    return first.select("user_id", "normalized_url", "w.*")


# Percent done at each stage of a scan.
STAGE_PERCENT = {
    "INITIALIZING": 5, "CRAWLING": 20, "ANALYZING_ARCHITECTURE": 35, "ANALYZING_SECURITY": 42,
    "ANALYZING_PERFORMANCE": 49, "ANALYZING_ACCESSIBILITY": 56, "ANALYZING_PRIVACY": 63, "ANALYZING_SEO": 70,
    "ANALYZING_CONTENT": 77, "ANALYZING_UX": 84, "AI_CORRELATION": 88, "AI_RECOMMENDATIONS": 92,
    "AI_SUMMARY": 96, "FINALIZING": 98,
}


def scan_progress(scans: DataFrame) -> DataFrame:
    """Percent done by stage; finished scans are at 100, unknown stages at 50."""
    pairs = [F.lit(x) for item in STAGE_PERCENT.items() for x in item]
    percent = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("stage")), F.lit(50))
    done = F.col("status") == "COMPLETED"
    return scans.select("scan_id", "status", "stage", F.when(done, 100).otherwise(percent).alias("progress_percent"))
