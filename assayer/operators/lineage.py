"""Source-level lineage: edges and the shortest simple paths over them."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import freeze, join_on
from ..specs import RelationshipSpec

EDGE_KEY = ("left_source", "left_column", "right_source", "right_column")
_DECLARED = (
    "left_source string, left_column string, right_source string, right_column string, "
    "confidence double, basis string"
)


def declared_edges(spark: SparkSession, relationships: Iterable[RelationshipSpec]) -> DataFrame:
    rows = [
        (r.left_source, left, r.right_source, right, 1.0, "declared_relationship")
        for r in relationships
        for left, right in r.keys
    ]
    return spark.createDataFrame(rows, _DECLARED)


def lineage_edges(
    declared: DataFrame, inferred: DataFrame | None, *, minimum_confidence: float = 0.8
) -> DataFrame:
    """Declared links plus sure inferred keys; one edge per column pair, the surest."""
    edges = declared.select(*EDGE_KEY, "confidence", "basis")
    if inferred is not None:
        sure = (F.col("dependency_type") == "join_key_candidate") & (F.col("confidence") >= minimum_confidence)
        edges = edges.unionByName(
            inferred.where(sure).select(*EDGE_KEY, "confidence", F.lit("inferred_join_key").alias("basis"))
        )
    declared_first = F.struct("confidence", (F.col("basis") == "declared_relationship"))
    return (
        edges.groupBy(*EDGE_KEY)
        .agg(F.max("confidence").alias("confidence"), F.max_by("basis", declared_first).alias("basis"))
        .orderBy(F.desc("confidence"), *EDGE_KEY)
    )


def _steps(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, the surest parallel edge per node pair."""
    edge = F.struct(*EDGE_KEY, "confidence")
    forward = edges.select(
        F.col("left_source").alias("from"), F.col("right_source").alias("to"), edge.alias("edge")
    )
    backward = edges.select(
        F.col("right_source").alias("from"), F.col("left_source").alias("to"), edge.alias("edge")
    )
    preference = F.struct(-F.col("edge.confidence"), *[F.col(f"edge.{name}") for name in EDGE_KEY])
    return (
        forward.unionByName(backward)
        .where("from <> to")
        .groupBy("from", "to")
        .agg(F.min_by("edge", preference).alias("edge"))
    )


def impact_paths(
    edges: DataFrame, seeds: DataFrame, *, max_depth: int | None = None, max_paths: int | None = None
) -> DataFrame:
    """Simple paths from each seed to all it reaches, or to what ``max_depth`` edges reach.

    A node counts only at its own shortest distance from the seed; all equally
    short alternatives are kept.  Search runs level by level: one join grows the
    paths, one anti-join drops nodes already reached.  ``max_paths`` keeps the
    first paths per seed by (depth, node names); by default all are returned.

    ``seeds`` has one column, ``seed``.
    """
    steps = freeze(_steps(edges))
    frontier = seeds.select(
        F.col("seed"),
        F.col("seed").alias("node"),
        F.array("seed").alias("sources"),
        F.array().cast("array<" + steps.schema["edge"].dataType.simpleString() + ">").alias("edges"),
    )
    reached = frontier.select("seed", "node").distinct()
    found: DataFrame | None = None
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        grown = frontier.join(steps, frontier["node"] == steps["from"]).select(
            "seed",
            F.col("to").alias("node"),
            F.concat("sources", F.array("to")).alias("sources"),
            F.concat("edges", F.array("edge")).alias("edges"),
        )
        # Written out per level: later levels read it instead of repeating the search.
        frontier = freeze(join_on(grown, reached, ["seed", "node"], "left_anti"))
        reached = reached.unionByName(frontier.select("seed", "node").distinct())
        level = frontier.withColumn("depth", F.lit(depth))
        found = level if found is None else found.unionByName(level)
        if frontier.isEmpty():
            break
    paths = found.select(
        "seed",
        "depth",
        F.col("node").alias("target"),
        F.concat_ws(">", "sources").alias("path"),
        "sources",
        "edges",
        F.lit("CANDIDATE_PATH").alias("status"),
    )
    if max_paths is None:
        return paths
    from .ordering import top_per_group

    return top_per_group(paths, ["seed"], [F.asc("depth"), F.asc("path")], max_paths, "place").drop("place")
