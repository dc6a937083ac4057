"""Validation of external feedback about a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feedback vocabulary.
CATEGORIES = (
    "ROOT_CAUSE", "CROSS_SOURCE_LINKAGE", "TEMPORAL_CHAIN", "BALANCE_RECONCILIATION",
    "OVP_IMPACT", "HEDGE_IMPACT", "ACCOUNTING_TRACE", "REPORT_CLARITY", "FALSE_POSITIVES",
)
STATUSES = ("FOUND", "PARTIAL", "NOT_FOUND")
SOURCE = "audit-evaluator"
MAX_ITEMS, MAX_ITEM_CHARS, MAX_BYTES = 20, 1000, 64 * 1024

# Which part of this package a category points at.
TARGETS: Mapping[str, str] = {
    "ROOT_CAUSE": "findings",
    "CROSS_SOURCE_LINKAGE": "relationships",
    "TEMPORAL_CHAIN": "timeline",
    "BALANCE_RECONCILIATION": "reconcile",
    "OVP_IMPACT": "rules",
    "HEDGE_IMPACT": "rules",
    "ACCOUNTING_TRACE": "lineage",
    "REPORT_CLARITY": "report",
    "FALSE_POSITIVES": "applicability",
}

SCHEMA = (
    "source string, source_run_id string, evaluation_run_id string, case_name string, "
    "status string, score double, missed_categories array<string>"
)


def _identifier(column: Column) -> Column:
    return F.when(F.coalesce(column, F.lit("")).rlike(r"^[A-Za-z0-9_.-]{0,100}$"), F.coalesce(column, F.lit(""))).otherwise("")


def ingest_feedback(
    records: DataFrame, *, json: str = "feedback", expected_run: str = "run_id", targets: Mapping[str, str] = TARGETS
) -> DataFrame:
    """Parse feedback JSON and say for each record whether it may be used.

    Only allow-listed content survives; ``error`` names the first violated rule.
    All of it is a projection over the row.
    """
    raw = F.col(f"`{json}`")
    parsed = F.from_json(raw, SCHEMA, {"mode": "PERMISSIVE"})
    score = F.coalesce(F.col("f.score"), F.lit(0.0))
    items = F.coalesce("f.missed_categories", F.array().cast("array<string>"))
    error = (
        F.when(F.octet_length(raw) > MAX_BYTES, "too_large")
        .when(F.col("f").isNull() | ~F.coalesce(raw.rlike(r"^\s*\{"), F.lit(False)), "not_an_object")
        .when(~F.col("f.source").eqNullSafe(F.lit(SOURCE)), "unknown_source")
        .when(~F.col("f.source_run_id").eqNullSafe(F.col(f"`{expected_run}`").cast("string")), "wrong_run")
        .when(~score.between(0, 100) | F.isnan(score), "score_out_of_range")
        .when(F.size(items) > MAX_ITEMS, "too_many_items")
        .when(F.exists(items, lambda c: F.length(F.trim(c)) > MAX_ITEM_CHARS), "item_too_long")
    )
    kept = F.filter(F.transform(items, lambda c: F.trim(c)), lambda c: c.isin(*CATEGORIES))
    lookup = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    status = F.when(F.col("f.status").isin(*STATUSES), F.col("f.status")).otherwise("UNKNOWN")
    return (
        records.withColumn("f", parsed)
        .withColumns({"error": error, "missed_categories": kept})
        .select(
            *[F.col(f"`{c}`") for c in records.columns if c != json],
            "error",
            F.col("error").isNull().alias("accepted"),
            _identifier(F.col("f.evaluation_run_id")).alias("evaluation_run_id"),
            _identifier(F.col("f.case_name")).alias("case_name"),
            status.alias("status"),
            score.alias("score"),
            "missed_categories",
            F.transform("missed_categories", lambda c: F.try_element_at(lookup, c)).alias("improvement_targets"),
        )
    )
