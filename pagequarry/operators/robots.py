"""robots.txt bodies to rule rows, and what the rules allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import urls as U


def robots_rules(bodies: DataFrame, agent: str) -> DataFrame:
    """Rules that apply to the agent: (host, pos, kind, value), kind being allow, disallow, sitemap or crawl-delay.

    ``bodies`` has host, base_url and body. An agent line replaces the one before
    it; lines before any agent line apply to nobody. Only the first crawl delay of
    a host counts, and one that is no number is dropped.
    """
    lines = bodies.select("host", "base_url", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw"))
    line = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    parsed = (
        lines.select("host", "base_url", "pos", line.alias("line"))
        .where((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit(":")))
        .select(
            "host", "base_url", "pos",
            F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("key"),
            F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), r"(?U)^\s+|\s+$", "").alias("value"),
        )
    )
    named = F.split(F.lower("value"), ",")
    relevant = F.when(F.col("key") == "user-agent", F.array_contains(named, agent) | F.array_contains(named, "*"))
    before = Window.partitionBy("host").orderBy("pos")
    carried = parsed.withColumn("relevant", F.last(relevant, ignorenulls=True).over(before))
    kinds = ("allow", "disallow", "sitemap", "crawl-delay")
    kept = carried.where(F.coalesce("relevant", F.lit(False)) & F.col("key").isin(*kinds)).where(
        ~F.col("key").isin("allow", "disallow") | (F.col("value") != "")
    )
    nth_delay = F.count_if(F.col("key") == "crawl-delay").over(before)
    numbered = kept.withColumn("nth_delay", nth_delay)
    seconds = F.col("value").try_cast("double")
    delay = F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))
    value = (
        F.when(F.col("key") == "crawl-delay", delay.cast("string"))
        .when((F.col("key") == "sitemap") & ~F.col("value").rlike("^https?://"), U.join_url(F.col("base_url"), F.col("value")))
        .otherwise(F.col("value"))
    )
    return (
        numbered.where((F.col("key") != "crawl-delay") | (F.col("nth_delay") == 1))
        .select("host", F.col("pos").cast("bigint").alias("pos"), F.col("key").alias("kind"), value.alias("value"))
        .where(F.col("value").isNotNull())
    )


def can_fetch(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed``: any allow prefix wins, else any disallow prefix refuses.

    Rules are gathered into one row per host first (a robots.txt is small), so the
    URLs are joined once, on the host, and never multiplied by the rules.
    """
    per_host = rules.where(F.col("kind").isin("allow", "disallow")).groupBy("host").agg(
        F.collect_set(F.when(F.col("kind") == "allow", F.col("value"))).alias("allows"),
        F.collect_set(F.when(F.col("kind") == "disallow", F.col("value"))).alias("disallows"),
    )
    staged = urls.withColumn("host", U.hostname_of(F.col(url))).withColumn(
        "path", F.regexp_replace(F.coalesce(F.nullif(U.path_of(F.col(url)), F.lit("")), F.lit("/")), r"/+", "/")
    )
    joined = staged.join(per_host, "host", "left")

    def hit(column: str):
        return F.coalesce(F.exists(column, lambda p: F.startswith(F.col("path"), p)), F.lit(False))

    return joined.select(*urls.columns, "path", (hit("allows") | ~hit("disallows")).alias("allowed"))
