"""Aggregate-level comparison of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import joined_text
from ..specs import ReconcileSpec, RelationshipSpec
from ..scale import _all


def _aggregate(kind: str, name: str) -> Column:
    functions = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
    return functions[kind](F.col(f"`{name}`"))


def reconcile(
    left: DataFrame, right: DataFrame, relationship: RelationshipSpec, spec: ReconcileSpec
) -> DataFrame:
    """Keys whose aggregated values differ by more than the tolerance.

    Both sides are reduced to one row per key before they meet, so the outer
    join works on unique keys whatever the skew of the inputs.  NULL is a key; a
    missing side counts as 0.
    """
    width = range(len(relationship.keys))

    def side(df: DataFrame, names: list[str], value: str, label: str) -> DataFrame:
        keys = [F.col(f"`{name}`").alias(f"{label}_{i}") for i, name in enumerate(names)]
        return df.groupBy(*keys).agg(_aggregate(spec.aggregation, value).alias(f"{label}_value"))

    a = side(left, [pair[0] for pair in relationship.keys], spec.left_value, "left")
    b = side(right, [pair[1] for pair in relationship.keys], spec.right_value, "right")
    same = _all(F.col(f"left_{i}").eqNullSafe(F.col(f"right_{i}")) for i in width)
    difference = F.coalesce(F.col("left_value"), F.lit(0)) - F.coalesce(F.col("right_value"), F.lit(0))
    keys = [F.coalesce(F.col(f"left_{i}"), F.col(f"right_{i}")) for i in width]
    return (
        a.join(b, same, "full_outer")
        .select(
            joined_text(keys).alias("object_id"),
            *[key.alias(f"key_{i}") for i, key in enumerate(keys)],
            "left_value",
            "right_value",
            difference.alias("difference"),
        )
        .where(F.abs("difference") > spec.tolerance)
    )
