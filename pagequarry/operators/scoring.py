"""Health scores and recommendation priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points lost per finding, category weights, ranks and buckets.
DEDUCTIONS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 0}
CATEGORIES = ("SECURITY", "PERFORMANCE", "ACCESSIBILITY", "PRIVACY", "SEO", "CONTENT", "UX", "ARCHITECTURE")
WEIGHTS = {
    "SECURITY": 20, "PERFORMANCE": 20, "ACCESSIBILITY": 10, "PRIVACY": 10,
    "SEO": 10, "CONTENT": 10, "UX": 10, "ARCHITECTURE": 10,
}
SEVERITY_POINTS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
IMPACT_POINTS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
EFFORT_POINTS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
BUCKETS = (("P0", 24), ("P1", 12), ("P2", 5))
PAGE_NEEDING_CATEGORIES = ("ACCESSIBILITY", "CONTENT", "PERFORMANCE", "SECURITY", "SEO", "UX")
SCORE_BANDS = ((90, "Excellent"), (75, "Good"), (60, "Needs work"))


def points(column: Column, table: dict[str, int], otherwise: int) -> Column:
    """Rank of a level by a literal map; unknown levels get ``otherwise``."""
    out = F.lit(None).cast("int")
    for name, value in table.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def severity_points(c: Column) -> Column:
    return points(c, SEVERITY_POINTS, 0)


def impact_points(c: Column) -> Column:
    return points(c, IMPACT_POINTS, 1)


def effort_points(c: Column) -> Column:
    return points(c, EFFORT_POINTS, 2)


def category_scores(findings: DataFrame) -> DataFrame:
    """Score and finding count of every measured category of every scan.

    Confidence is summed as a decimal, so the result does not depend on row order.
    """
    loss = points(F.col("severity"), DEDUCTIONS, 0).cast("decimal(3,0)") * F.col("confidence").cast("decimal(4,3)")
    lost = findings.where(F.col("category").isin(*CATEGORIES)).groupBy("scan_id", "category").agg(
        F.sum(loss).alias("lost"), F.count(F.lit(1)).alias("finding_count")
    )
    score = F.round(F.greatest(F.lit(0).cast("decimal(38,3)"), F.lit(100).cast("decimal(38,3)") - F.col("lost")), 1)
    return lost.select("scan_id", "category", score.cast("decimal(5,1)").alias("score"), "finding_count")


def score_breakdown(scans: DataFrame, findings: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """All eight categories of every scan; a category without findings is unmeasured, not perfect."""
    scored = category_scores(findings)
    slots = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(weights.get(c, 0)).alias("weight")) for c in CATEGORIES
    ])
    every = scans.select("scan_id", F.inline(slots))
    return every.join(scored, ["scan_id", "category"], "left").select(
        "scan_id", "category", F.col("score").cast("double").alias("score"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"), "weight",
    )


def scan_scores(scans: DataFrame, findings: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """One wide row per scan: overall score and the eight category scores.

    Conditional sums instead of a pivot keep it to one aggregate over a row per category.
    """
    scored = category_scores(findings)
    weight = points(F.col("category"), weights, 0).cast("decimal(10,0)")
    wide = scored.groupBy("scan_id").agg(
        (F.sum(F.col("score") * weight) / F.sum(weight)).alias("mean"),
        *[F.max(F.when(F.col("category") == c, F.col("score"))).alias(f"{c.lower()}_score") for c in CATEGORIES],
    )
    return scans.select("scan_id").join(wide, "scan_id", "left").select(
        "scan_id", F.round("mean", 1).cast("double").alias("overall_score"),
        *[F.col(f"{c.lower()}_score").cast("double").alias(f"{c.lower()}_score") for c in CATEGORIES],
    )


def analyzer_status(scans: DataFrame, pages: DataFrame, failed: frozenset[str] = frozenset()) -> DataFrame:
    """Status of each category per scan: those that need pages fail where there are none, those in ``failed`` everywhere."""
    counted = pages.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    joined = scans.select("scan_id").join(counted, "scan_id", "left")
    slots = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(c in PAGE_NEEDING_CATEGORIES).alias("needs")) for c in CATEGORIES])
    rows = joined.select("scan_id", "n", F.inline(slots))
    fails = (F.col("needs") & F.col("n").isNull()) | F.col("category").isin(*failed)
    return rows.select("scan_id", "category", F.when(fails, "FAILED").otherwise("COMPLETED").alias("status"))


def priority_score(
    severity: Column, impact: Column, effort: Column, confidence: Column, affected: Column, total: Column,
    relevance: float = 1.0,
) -> Column:
    """Severity times impact times confidence times reach, over effort; three decimals."""
    share = F.least(affected.cast("double") / F.greatest(total, F.lit(1)), F.lit(1.0))
    reach = F.when(total > 0, 1 + 0.5 * share).otherwise(F.lit(1.0))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    raw = severity_points(severity) * impact_points(impact) * sure * reach * F.lit(relevance)
    return F.round(raw / F.greatest(F.lit(1), effort_points(effort)), 3)


def priority_bucket(score: Column) -> Column:
    out = F.lit("P3")
    for name, least in reversed(BUCKETS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def priority_explanation(severity: Column, impact: Column, effort: Column, confidence: Column) -> Column:
    percent = F.round(confidence * 100).cast("int").cast("string")
    return F.concat(
        F.lit("Severity "), severity, F.lit(" × impact "), impact, F.lit(" × confidence "), percent,
        F.lit("% ÷ effort "), effort,
    )


def score_band(score: Column) -> Column:
    out = F.lit("Poor")
    for least, name in reversed(SCORE_BANDS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return F.when(score.isNull(), F.lit("Unmeasured")).otherwise(out)


def confidence_band(confidence: Column) -> Column:
    percent = F.round(confidence * 100)
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").otherwise("low")
