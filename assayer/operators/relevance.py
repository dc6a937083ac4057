"""Rank text items by the words of a request."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import quoted
from ..scale import freeze, spread

# Request words that select nothing, by their first five letters.
IGNORED_PREFIXES = ("аудит", "прове", "check", "revie", "тольк", "only")
ONLY_WORDS = ("только", "only")
PREFIX = 5


def request_words(request: str) -> tuple[list[str], bool]:
    """Distinct words of three or more letters, and whether only the best counts."""
    found = set(re.findall(r"[\w-]{3,}", request.lower()))
    best_only = not found.isdisjoint(ONLY_WORDS)
    return sorted(w for w in found if w[:PREFIX] not in IGNORED_PREFIXES), best_only


def _meets(word: str, text: Column) -> Column:
    """Does a request word meet any word of a lower-case text?

    A word of the text is a run of three or more of ``[\\w-]``.  It contains the
    request word exactly where the text does; it lies inside the request word
    when it is one of its substrings; it shares the first letters when it starts
    with them.  So one search and one pattern replace splitting the text.
    """
    # The leading look-ahead skips most positions before the costlier boundary test.
    inside = sorted({word[i:j] for i in range(len(word)) for j in range(i + 3, len(word) + 1)} - {word})
    choices = [rf"(?:{'|'.join(map(re.escape, inside))})(?![\w-])"] if inside else []
    if len(word) >= PREFIX:
        choices.append(re.escape(word[:PREFIX]))
    hit = F.contains(text, F.lit(word))
    if not choices:
        return hit
    letters = "".join(sorted(set(word))).replace("-", r"\-")
    return hit | text.rlike(rf"(?U)(?=[{letters}])(?<![\w-])(?:{'|'.join(choices)})")


def keyword_relevance(items: DataFrame, request: str, text: str = "text") -> DataFrame:
    """Items with ``score``: how many request words meet one of the item's words.

    Words meet when one contains the other or both start with the same five
    letters.  "only" keeps the best score, and a request that meets nothing
    keeps everything with score 0.

    Both need to know the other rows' scores, so the matching rows are written
    once and the texts are read once.
    """
    wanted, best_only = request_words(request)
    if not wanted:
        return items.withColumn("score", F.lit(0))
    score = F.lit(0)
    for word in wanted:
        score = score + _meets(word, F.col("__text")).cast("int")
    lowered = spread(items).withColumn("__text", F.lower(F.col(quoted(text))))
    # A generator drops rows without a score and computes each score just once.
    positive = F.explode(F.filter(F.array(F.coalesce(score, F.lit(0))), lambda s: s >= 1))
    matched = freeze(lowered.select(*[F.col(quoted(c)) for c in items.columns], positive.alias("score")))
    if matched.isEmpty():
        return items.withColumn("score", F.lit(0))
    if best_only:
        return matched.where(F.col("score") == matched.agg(F.max("score").alias("m")).scalar())
    return matched
