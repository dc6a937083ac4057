"""Attach document evidence to findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sha256
from ..scale import attach_small, stored
from .retrieval import Embedder, embed, vector_search_batch

# Wording that makes a sentence normative.
NORMATIVE_MARKERS = (
    "должен", "должна", "должно", "требуется", "не допускается", "запрещ",
    "must", "required", "shall", "not allowed", "prohibited",
)


def plain_text(column: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.regexp_replace(F.lower(column), r"(?U)\s+", " ")


def contains_any(text: Column, values: Column) -> Column:
    return F.exists(values, lambda v: F.contains(text, v))


def constraint_values(values: Column) -> Column:
    """Values usable for matching: trimmed, lower case, at least two characters."""
    return F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: F.length(v) >= 2)


def semantic_constraint_match(
    text: Column, expected: Column, context: Column, markers: Sequence[str] = NORMATIVE_MARKERS
) -> Column:
    """Does a text state a norm that names an expected and a context value?"""
    body = plain_text(text)
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(body, F.lit(marker))
    match = marked & contains_any(body, constraint_values(expected)) & contains_any(body, constraint_values(context))
    return F.coalesce(match, F.lit(False))


def _is_semantic() -> Column:
    return F.array_contains("tags", "semantic_constraint")


def _group() -> Column:
    return F.when(_is_semantic(), F.col("finding_id")).otherwise(F.col("check_id"))


def grounding_queries(findings: DataFrame, request: str) -> DataFrame:
    """One search text per group: the first finding speaks for all of its check."""
    first = F.struct("title", "criterion", "tags", "facts")
    texts = F.array(
        F.lit(request), F.col("first.title"), F.col("first.criterion"), F.concat_ws(" ", "first.tags")
    )
    query = F.concat_ws(" ", F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""))
    return (
        findings.withColumn("group_id", _group())
        .groupBy("group_id")
        .agg(
            F.min_by(first, F.struct(-F.col("confidence"), "finding_id")).alias("first"),
            F.bool_or(_is_semantic()).alias("semantic"),
        )
        .select("group_id", "semantic", query.alias("query"), F.col("first.facts").alias("facts"))
    )


# A JSON text's tokens: strings, with the colon where they are keys, and bare values.
TOKEN_PATTERN = r'("(?:[^"\\]|\\.)*+"\s*:?|[^\s,:{}\[\]"]++)'


def json_leaves(text: Column) -> Column:
    """The texts of all values of a JSON text, at any depth, in their order; keys and null are left out.

    A text that is not an object or a list is its own only value.  The tokens are cut out in one scan and
    read as one flat list, so depth costs nothing.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN))
    values = F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":")) & (t != "null"))
    leaves = F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")
    nested = F.ltrim(text).startswith("{") | F.ltrim(text).startswith("[")
    return F.when(nested, F.coalesce(leaves, F.array(text))).when(text.isNotNull(), F.array(text))


def _json_values(column: Column, path: str) -> Column:
    """Leaf texts of the JSON value at ``path`` of a JSON text; what is empty in itself (false, 0) says nothing."""
    return F.filter(json_leaves(F.get_json_object(column, path)), lambda v: ~v.rlike(r"^(false|-?0+([.]0+)?)$"))


def ground_findings(
    findings: DataFrame,
    chunks: DataFrame,
    make_embedder: Callable[[], Embedder],
    *,
    request: str = "",
    k: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(findings tagged ``rag_grounded``, evidence references from documents).

    ``chunks`` has chunk_id, source_id, text and embedding.  Search runs once
    per group; its few matches are then joined to every finding of the group.
    """
    queries = grounding_queries(findings, request)
    searched = embed(queries, "query", make_embedder)
    matches = vector_search_batch(chunks, searched, k, index_key="chunk_id", query_key="group_id")
    texts = chunks.select("chunk_id", "source_id", F.col("text").alias("chunk_text"))
    found = (
        attach_small(texts, matches, ["chunk_id"])
        .join(queries, "group_id")
        .withColumn(
            "constraint_match",
            F.col("semantic")
            & semantic_constraint_match(
                F.col("chunk_text"), _json_values(F.col("facts"), "$.expected"), _json_values(F.col("facts"), "$.context")
            ),
        )
        .select(
            "group_id",
            sha256(F.concat_ws(":", "chunk_id", "chunk_text")).alias("checksum"),
            F.col("source_id").alias("source_name"),
            F.col("chunk_id").cast("string").alias("object_id"),
            F.col("chunk_text").alias("description"),
            F.to_json(F.struct(F.round("score", 6).alias("score"), "rank")).alias("fields"),
            "query",
            "constraint_match",
        )
    )
    # Written, so that a match is searched and hashed once and not for each of its findings.
    found = stored(found)
    references = attach_small(findings.select("finding_id", _group().alias("group_id")), found, ["group_id"]).select(
        "finding_id",
        F.lit(None).cast("string").alias("evidence_id"),
        "checksum",
        "source_name",
        "object_id",
        "description",
        "fields",
        "query",
        "constraint_match",
    )
    tagged = findings.withColumn("tags", F.array_distinct(F.concat("tags", F.array(F.lit("rag_grounded")))))
    return tagged, references
