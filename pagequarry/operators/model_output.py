"""Validation of model answers: raw texts in, checked rows and rejects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.binding import let

CAUSES = "struct<root_causes:array<struct<title:string,description:string,affected_findings:array<string>,confidence:string,evidence_ids:array<string>>>>"
ADVICE = (
    "struct<recommendations:array<struct<title:string,description:string,category:string,priority:string,impact:string,"
    "effort:string,confidence:string,root_cause:string,finding_ids:array<string>,implementation_guidance:string>>>"
)
SUMMARY = (
    "struct<headline:string,executive_summary:string,top_risks:array<string>,"
    "biggest_opportunities:array<string>,roadmap:array<string>>"
)


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_object(raw: Column) -> Column:
    """The JSON object in a model answer: fences stripped, else what lies between the outer braces.

    Null when neither is a JSON object.
    """
    def unfenced(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, r"^`+|`+$", ""), r"^json", "")
        return F.when(F.startswith(text, F.lit("```")), F.trim(F.regexp_replace(bare, r"^\s+|\s+$", ""))).otherwise(text)

    def pick(text: Column) -> Column:
        inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
        chosen = F.when(_is_json(text), text).when((inner != "") & _is_json(inner), inner)
        return let(chosen, lambda c: F.when(F.startswith(F.trim(c), F.lit("{")), c))

    stripped = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return let(let(stripped, unfenced), pick)


def _confidence(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.when(value.isNull(), F.lit(0.5)))


def _bad_confidence(items: Column) -> Column:
    def bad(item: Column) -> Column:
        number = _confidence(item["confidence"])
        return number.isNull() | (number < 0) | (number > 1)

    return F.exists(items, lambda i: i["title"].isNull() | bad(i))


def validate_lists(answers: DataFrame, kind: str) -> DataFrame:
    """Check answers of kind ``root_causes`` or ``recommendations``.

    Adds ``items`` (with confidence as a double) and ``reason``; an answer with a
    reason is rejected whole and its scan keeps the rule-based rows.
    """
    schema = CAUSES if kind == "root_causes" else ADVICE
    parsed = answers.withColumn("object", json_object(F.col("raw"))).withColumn("parsed", F.from_json("object", schema))
    items = F.col(f"parsed.{kind}")
    reason = (
        F.when(F.col("object").isNull(), "not a JSON object")
        .when(items.isNull() | (F.size(items) == 0), "nothing in it")
        .when(_bad_confidence(items), "title missing or confidence outside 0..1")
    )
    checked = F.transform(items, lambda i: i.withField("confidence", _confidence(i["confidence"])))
    return parsed.withColumn("reason", reason).select(
        *answers.columns, "reason", F.when(F.col("reason").isNull(), checked).alias("items")
    )


def validate_summaries(answers: DataFrame) -> DataFrame:
    """Check summary answers; one without an executive summary is rejected."""
    parsed = answers.withColumn("object", json_object(F.col("raw"))).withColumn("summary", F.from_json("object", SUMMARY))
    reason = F.when(F.col("object").isNull(), "not a JSON object").when(
        F.coalesce("summary.executive_summary", F.lit("")) == "", "no executive summary"
    )
    return parsed.withColumn("reason", reason).select(
        *answers.columns, "reason", F.when(F.col("reason").isNull(), F.col("summary")).alias("summary")
    )


def accepted_or_rule_based(validated: DataFrame, rule_based: DataFrame, column: str) -> DataFrame:
    """Per scan: the model's value where it passed, else the rule-based one, and which it was."""
    passed = validated.where(F.col("reason").isNull()).select("scan_id", F.col(column).alias("proposed"))
    return rule_based.join(passed, "scan_id", "left").select(
        "scan_id", F.coalesce("proposed", column).alias(column), F.col("proposed").isNotNull().alias("from_model")
    )


def rejects(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull()).select("scan_id", "raw", "reason")
