"""What part a column or table plays: attribute, mapping, join end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import has_any, words
from ..scale import join_on

# Words that decide whether a name carries business meaning.
SEMANTIC_PARTS = (
    "asset", "business", "category", "class", "classification", "country", "currency",
    "entity", "operation", "portfolio", "product", "region", "type", "unit",
)
NON_SEMANTIC_PARTS = (
    "batch", "created", "date", "description", "id", "name", "status", "time",
    "timestamp", "ts", "valid", "version",
)
TARGET_PARTS = ("destination", "target", "to")
LIFECYCLE_NAMES = ("approved_by", "description", "valid_from", "valid_to")


def is_target_key(name: Column) -> Column:
    return F.lower(name).endswith("_id") & has_any(words(name), TARGET_PARTS)


def is_semantic_attribute(name: Column, distinct_count: Column, max_distinct: int | None = None) -> Column:
    parts = words(name)
    return (
        ~F.lower(name).endswith("_id")
        & ~has_any(parts, NON_SEMANTIC_PARTS)
        & has_any(parts, SEMANTIC_PARTS)
        & (distinct_count >= 1)
        & (F.lit(True) if max_distinct is None else distinct_count <= max_distinct)
    )


def attribute_roles(
    columns: DataFrame, *, max_per_table: int | None = None, max_distinct: int | None = None
) -> DataFrame:
    """Attributes worth comparing, in column order; the bounds are for callers that want fewer.

    ``columns`` is a column profile (source_id, column_index, column_name,
    distinct_count).
    """
    chosen = columns.where(is_semantic_attribute(F.col("column_name"), F.col("distinct_count"), max_distinct))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("column_index"))
    placed = chosen.select("source_id", "column_name", place.alias("place"))
    return placed if max_per_table is None else placed.where(F.col("place") <= max_per_table)


def mapping_tables(columns: DataFrame) -> DataFrame:
    """Tables that define routes: a rule key next to validity or approval data."""
    name = F.lower("column_name")
    rule_key = (name == "rule_id") | name.endswith("_rule_id")
    return (
        columns.groupBy("source_id")
        .agg(F.bool_or(rule_key).alias("k"), F.bool_or(name.isin(*LIFECYCLE_NAMES)).alias("l"))
        .where("k AND l")
        .select("source_id")
    )


def join_roles(relationships: DataFrame) -> DataFrame:
    """Which end of a key link is the mapping: the one whose key names a target.

    Seen from that end the link must lead to one row.
    """
    left, right = is_target_key(F.col("left_column")), is_target_key(F.col("right_column"))
    fits = F.when(left, F.col("relationship").isin("many_to_one", "one_to_one")).otherwise(
        F.col("relationship").isin("one_to_many", "one_to_one")
    )

    def pick(if_left: str, if_right: str, name: str) -> Column:
        return F.when(left, F.col(if_left)).otherwise(F.col(if_right)).alias(name)

    return (
        relationships.where((F.col("dependency_type") == "join_key_candidate") & (left != right) & fits)
        .select(
            pick("left_source", "right_source", "mapping_source"),
            pick("left_column", "right_column", "mapping_key"),
            pick("right_source", "left_source", "reference_source"),
            pick("right_column", "left_column", "reference_key"),
            "confidence",
        )
        .groupBy("mapping_source", "mapping_key", "reference_source", "reference_key")
        .agg(F.max("confidence").alias("confidence"))
    )


def infer_column_roles(columns: DataFrame, relationships: DataFrame) -> DataFrame:
    """Join roles restricted to real mapping tables, ready for outlier analysis."""
    mappings = mapping_tables(columns).withColumnRenamed("source_id", "mapping_source")
    return join_on(join_roles(relationships), mappings, ["mapping_source"], "left_semi")
