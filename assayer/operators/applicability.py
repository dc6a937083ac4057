"""Does a check's vocabulary fit the data it is about to judge?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..specs import RuleSpec
from .rules import in_vocabulary


def value_frequencies(df: DataFrame, column: str, expected, limit: int = 50) -> DataFrame:
    """Most frequent non-NULL values and whether the vocabulary knows them."""
    value = F.col(f"`{column}`").cast("string").alias("value")
    return (
        df.select(value)
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count("*").alias("rows_count"))
        .orderBy(F.desc("rows_count"), F.asc("value"))
        .limit(limit)
        .withColumn("mapped", in_vocabulary(F.col("value"), expected))
    )


def vocabulary_coverage(df: DataFrame, column: str, expected) -> DataFrame:
    """Total and matched rows, coverage and status of one vocabulary, in one pass."""
    value = F.col(f"`{column}`")
    coverage = F.when(F.col("total_rows") == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("matched_rows"), F.col("total_rows"))
    )
    status = (
        F.when((F.col("total_rows") > 0) & (F.col("matched_rows") == 0), "INCOMPATIBLE")
        .when(F.col("matched_rows") < F.col("total_rows"), "PARTIAL")
        .otherwise("APPLICABLE")
    )
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(in_vocabulary(value, expected)).alias("matched_rows")
    ).select(
        "total_rows", "matched_rows", F.round(coverage, 6).alias("row_coverage"), status.alias("status")
    )


def rule_applicability(df: DataFrame, rule: RuleSpec) -> DataFrame:
    """One row for a timeline rule: coverage figures and the top observed values, as JSON."""
    if rule.kind != "timeline":
        raise ValueError("vocabularies belong to timeline rules")
    spec = rule.timeline
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("rows_count")).alias("order"), "value", "rows_count", "mapped")))
    observed = value_frequencies(df, spec.event_field, spec.expected_order).agg(
        F.to_json(F.transform(ranked, lambda v: F.struct(v["value"], v["rows_count"], v["mapped"]))).alias("v")
    )
    reason = (
        F.when(F.col("status") == "INCOMPATIBLE", "No observed value is in the vocabulary.")
        .when(F.col("status") == "PARTIAL", "Some observed values are not in the vocabulary.")
        .otherwise("The vocabulary covers the observed values.")
    )
    return vocabulary_coverage(df, spec.event_field, spec.expected_order).select(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.kind).alias("rule_kind"),
        F.lit(spec.source_id).alias("source_id"),
        F.lit(spec.event_field).alias("column_name"),
        "status",
        "total_rows",
        "matched_rows",
        "row_coverage",
        F.array(*[F.lit(v) for v in spec.expected_order]).alias("expected_values"),
        observed.scalar().alias("observed_values"),
        reason.alias("reason"),
    )
