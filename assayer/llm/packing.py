"""Packing documents into sequences: cutting-stock patterns by column generation.

A document is cut into full sequences and one remainder.  Only the histogram of the
remainders' lengths, in steps of ``GRAIN`` ids (at most ``capacity / GRAIN`` numbers), reaches the
driver, where a linear program over patterns (which lengths share a sequence) is
solved by column generation: the simplex method keeps a basis of patterns, and a
knapsack by dynamic programming prices new ones with the dual values.  The pattern
counts are rounded down, what is left is packed best-fit, and the documents, ranked
within their length, take the places of their length in turn.
"""

from __future__ import annotations

import base64
import gc
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stored

CAPACITY = 1024
END_OF_TEXT = 0
# Lengths are told apart in steps of so many ids; a remainder leaves at most GRAIN - 1 ids unused.
GRAIN = 2
# Words kept per task with their ids; beyond that the memory of words starts anew.
WORDS_KEPT = 400_000
# A space that does not start a new word for the tokenizer: between white space, or after it at the end.
INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


def _plain(token: dict) -> dict:
    """An added token that matches as it is written; those that take in white space or look at words aren't built."""
    if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
        raise ValueError(f"added token {token['content']!r} has matching rules that aren't supported")
    return token


class Encoder:
    """Ids of whole texts, looking up words (a space and what follows up to the next one) seen before.

    The vocabulary is that of a byte-level BPE file of ranks; the ids are those that
    ``tokenizers`` gives with the JSON file of the same name and vocabulary, but new words take an eighth
    of the time.  Texts are split at the added tokens of that file first, as ``tokenizers`` does.  No token holds both what comes before a space and what comes after it, unless
    the space stands within a run of white space; texts with such a run are encoded as they are.
    """

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        with open(re.sub(r"\.tiktoken$", ".json", ranks_path), encoding="utf-8") as described:
            self.added = {t["content"]: _plain(t)["id"] for t in json.load(described)["added_tokens"]}
        # The first one that begins at a place wins, and of these the longest.
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        if self.split is None or not self.split.search(text):
            return self._between(text)
        ids, at = [], 0
        for found in self.split.finditer(text):
            ids += [*self._between(text[at:found.start()]), self.added[found.group()]]
            at = found.end()
        return ids + self._between(text[at:])

    def _between(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        if INNER_SPACE.search(text):
            return self.encode(text)
        first, *words = text.split(" ")
        ids, known = self.encode(first), self.known
        for word in words:
            found = known.get(word)
            if found is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                found = known[word] = tuple(self.encode(" " + word))
            ids += found
        return ids


def _pieces(ranks_path: str, capacity: int):
    """Cut every document; number the pieces of a length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and looking for them in the known words costs more than encoding
        encode, cell = Encoder(ranks_path), TaskContext.get().partitionId()
        seen = [0] * (capacity // GRAIN + 1)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                ids = [*encode(text.as_py() or ""), END_OF_TEXT]
                raw = np.array(ids, "<u4").tobytes()
                for start in range(0, len(ids), capacity):
                    length = min(capacity, len(ids) - start)
                    crc, size = zlib.crc32(raw[4 * start:4 * (start + length)]), -(-length // GRAIN)
                    rows.append((i, start, length, crc, len(ids), size, cell, seen[size]))
                    seen[size] += 1
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 8)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "cell", "rank"])

    return run


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits; ``value[k - 1]`` is that of a piece of length k.

    Unbounded knapsack by dynamic programming over the room that is left.
    """
    n, backwards = len(value), value[::-1]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(room, n)
        worth = best[room - k:room] + backwards[n - k:]
        i = int(worth.argmax())
        if worth[i] > best[room - 1] + 1e-12:
            best[room], choice[room] = worth[i], k - i
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(n, np.int64), capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room] - 1] += 1
        room -= max(1, choice[room])
    return float(best[capacity]), pattern


def first_patterns(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to start from, and its inverse.

    A length goes with the one that fills it up, as far as there are enough of both; the rest goes with
    copies of itself.
    """
    n = len(demand)
    copies = capacity // np.arange(1, n + 1)
    patterns, inverse = np.diag(copies), np.diag(1.0 / copies)
    for large in range(capacity // 2 + 1, n + 1):
        rare, other = large - 1, capacity - large - 1
        if demand[rare] > demand[other]:
            rare, other = other, rare
        patterns[rare] = 0
        patterns[rare, [rare, other]] = 1
        inverse[rare, rare], inverse[other, rare] = 1, -inverse[other, other]
    return patterns, inverse


def fractional_patterns(demand: np.ndarray, capacity: int, gap: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often to use each, to cover ``demand`` with about the fewest sequences.

    ``demand[k - 1]`` pieces have length k.  Ends when the count is within ``gap`` of a lower
    bound (the volume, or the dual bound), or after ``rounds`` columns; every basis in between covers
    the demand as well.  A column without pieces to place costs nothing and gives up places.
    """
    n = len(demand)
    # Plain sums instead of matrix products: BLAS threads have been seen to hang in a process with a JVM.
    patterns, inverse = first_patterns(demand, capacity)
    used, cost = (inverse * demand).sum(axis=1), np.ones(n)
    volume = float((np.arange(1, n + 1) * demand).sum()) / capacity
    dual = inverse.sum(axis=0)
    for _ in range(rounds):
        if dual.min() < -1e-9:
            price, column = 0.0, np.zeros(n, np.int64)
            column[dual.argmin()] = -1
        else:
            worth, column = best_pattern(dual, capacity)
            price = 1.0
            if worth <= 1 + gap or (cost * used).sum() <= volume * (1 + gap):
                break
        some = np.flatnonzero(column)
        step = (inverse[:, some] * column[some]).sum(axis=1)
        ratio = np.full(n, np.inf)
        np.divide(used, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        row, amount = inverse[out] / step[out], ratio[out]
        dual = dual + (price - (dual[some] * column[some]).sum()) * row
        used = np.maximum(used - amount * step, 0)
        inverse -= step[:, None] * row
        used[out], inverse[out], cost[out], patterns[out] = amount, row, price, column
    return patterns[cost > 0], used[cost > 0]


def packing_plan(histogram: dict[int, int], capacity: int, gap: float = 0.001, rounds: int = 2000) -> list[tuple]:
    """Where the pieces of each length go: (length, first, count, each, sequence, place).

    The pieces ranked ``first`` .. ``first + count - 1`` of that length fill sequences
    ``sequence``, ``sequence + 1``, ...: ``each`` of them side by side from ``place`` on.
    """
    full = histogram.get(capacity, 0)
    left = np.array([histogram.get(k, 0) for k in range(1, capacity)], np.int64)
    chosen: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    patterns, used = fractional_patterns(left.astype(float), capacity, gap, rounds)
    for pattern, times in zip(patterns, np.floor(used + 1e-6).astype(np.int64)):
        while times > 0 and (pattern := np.minimum(pattern, left)).any():
            some = np.flatnonzero(pattern)
            now = min(int(times), int((left[some] // pattern[some]).min()))
            left -= now * pattern
            times -= now
            chosen.append(({int(i) + 1: int(pattern[i]) for i in some}, now))
    chosen += [(pattern, 1) for pattern in _best_fit(left, capacity)]
    plan, ranked, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in chosen:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            plan.append((length, ranked[length], times * each, each, sequence, offset))
            ranked[length] += times * each
            offset += length * each
        sequence += times
    return plan


def _best_fit(left: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Longest first, each into the fullest sequence that has room.  What rounding leaves is bounded by the patterns."""
    by_room: list[list[dict[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity - 1, 0, -1):
        for _ in range(left[length - 1]):
            room = next((r for r in range(length, capacity) if by_room[r]), capacity)
            pattern = by_room[room].pop() if room < capacity else {}
            pattern[length] = pattern.get(length, 0) + 1
            by_room[room - length].append(pattern)
    return [pattern for patterns in by_room for pattern in patterns]


def pack(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    NULL and empty texts are the end-of-text id alone.  Pieces keep to their document;
    repeated rows are documents of their own.  Other columns are ignored; no rows give no rows.
    A task holds the ids of one document at a time.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    pieces = stored(docs.select("doc_id", "text").mapInArrow(
        _pieces(ranks_path, capacity),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, size long, cell long, rank long"))
    counts = stored(pieces.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("size").orderBy("cell")) - F.col("n")
    bases = stored(counts.select("size", "cell", before.alias("base")))
    plan = spark.createDataFrame(
        packing_plan(histogram, capacity // GRAIN), "size long, first long, count long, each long, sequence long, place long")
    ranked = pieces.join(bases, ["size", "cell"]).withColumn("rank", F.col("rank") + F.col("base"))
    # The plan has a few rows per length of the histogram, however many documents there are.
    placed = ranked.join(F.broadcast(plan), "size").where("rank >= first AND rank < first + count")
    turn = F.col("rank") - F.col("first")
    placed = placed.select("*", (F.col("sequence") + F.floor(turn / F.col("each"))).alias("sequence_id"),
                           (F.col("place") + turn % F.col("each") * F.col("size")).alias("order"))
    before = Window.partitionBy("sequence_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
