"""Figures behind a run's report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import attach_small, join_on
from .findings import severity_rank
from .ordering import top_per_group


def verdict_counts(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count("*").alias("signals"),
        F.count_if(F.col("verdict") == "CONFIRMED").alias("confirmed"),
        F.count_if(F.col("verdict") == "REQUIRES_VALIDATION").alias("requires_validation"),
        F.count_if(F.col("verdict") == "REJECTED").alias("rejected"),
    )


def confirmed_findings(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Confirmed findings, most severe and most certain first."""
    kept = reviews.where("verdict = 'CONFIRMED'").select("finding_id")
    return join_on(findings, kept, ["finding_id"], "left_semi").orderBy(
        severity_rank(F.col("severity")), F.desc("confidence"), F.asc("finding_id")
    )


def report_digest(plan: DataFrame, findings: DataFrame, examples: int = 3) -> DataFrame:
    """Plan items grouped by (priority, status, title, rationale, action), most urgent first.

    The action is an item's first step, or else its rationale.  The object id is taken out of the title, so
    similar cases fall together.  Each group has its size, its first item and its first few object ids; only
    those few leave each map task.
    """
    objects = findings.select("finding_id", "object_id")
    bare = F.rtrim(
        F.regexp_replace(
            F.when(F.coalesce("object_id", F.lit("")) != "", F.replace("title", F.col("object_id"), F.lit("")))
            .otherwise(F.col("title")),
            r"[\s:-]+$",
            "",
        )
    )
    items = join_on(plan, objects, ["finding_id"], "left").select(
        "priority", "status", bare.alias("title"), "rationale",
        F.coalesce(F.try_element_at("next_steps", F.lit(1)), "rationale").alias("action"), "plan_id", "object_id",
    )
    groups = ["priority", "status", "title", "rationale", "action"]
    counts = items.groupBy(*groups).agg(F.count("*").alias("cases"), F.min("plan_id").alias("first_plan_id"))
    first = (
        top_per_group(items, groups, [F.asc("plan_id")], examples)
        .groupBy(*groups)
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rank", "object_id"))), lambda r: r["object_id"]), ", "
            ).alias("examples")
        )
    )
    digest = attach_small(counts, first, groups, "left", null_safe=True)
    return digest.orderBy(severity_rank(F.col("priority")), "first_plan_id")


def urgent_counts(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Confirmed findings, and those of them that are high or critical."""
    kept = reviews.where("verdict = 'CONFIRMED'").select("finding_id")
    return join_on(findings.select("finding_id", "severity"), kept, ["finding_id"], "left_semi").agg(
        F.count("*").alias("confirmed"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("high_or_critical")
    )


def run_summary(
    findings: DataFrame,
    reviews: DataFrame,
    plan: DataFrame,
    rule_results: DataFrame,
    evidence: DataFrame,
) -> DataFrame:
    """One row of counts for a run."""
    tables = {
        "findings_count": findings.agg(F.count("*").alias("n")),
        "confirmed_findings_count": reviews.agg(F.count_if(F.col("verdict") == "CONFIRMED").alias("n")),
        "potential_risks_count": plan.agg(F.count_if(F.col("status") == "POTENTIAL_RISK").alias("n")),
        "audit_plan_items_count": plan.agg(F.count("*").alias("n")),
        "execution_errors_count": rule_results.agg(F.count_if(F.col("status") == "ERROR").alias("n")),
        "executed_rules_count": rule_results.agg(F.count("*").alias("n")),
        "evidence_count": evidence.agg(F.count("*").alias("n")),
    }
    parts = None
    for name, table in tables.items():
        part = table.select(F.lit(name).alias("name"), F.col("n"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy().agg(
        *[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables]
    )
