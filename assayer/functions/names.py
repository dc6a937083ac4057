"""Identifier words and their similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a key name that only say which side it is on.
GENERIC_NAME_PARTS = ("from", "left", "right", "source", "target", "to")

Normalizer = Callable[[str], str]


def words(column: Column) -> Column:
    """``[a-z0-9]+`` words of a name column."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0)))


def meaningful_words(column: Column) -> Column:
    """Words without side words, unless nothing else is left."""
    every = words(column)
    kept = F.array_except(every, literal_array(GENERIC_NAME_PARTS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def has_any(column: Column, values) -> Column:
    return F.arrays_overlap(column, literal_array(values))


def literal_array(values) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")
