"""Embeddings and exact cosine search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scale import freeze, measured_bytes
from .ordering import top_per_group

EMBED_BATCH = 16
# Words whose places an embedder remembers, some 100 bytes each.
KNOWN_WORDS = 1 << 18
# Query vectors shipped to every task, and rows of one block of the blocked form.
MAX_SHIPPED_BYTES = 32 * 1024 * 1024
BLOCK_ROWS = 4096


class Embedder(Protocol):
    dimension: int

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...


# What ASCII characters become where words are looked for: letters in lower case, anything between words a blank.
ASCII_WORDS = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in map(chr, range(128)))


def words_of(text: str) -> list[str]:
    """Runs of word characters in lower case."""
    return text.translate(ASCII_WORDS).split() if text.isascii() else re.findall(r"\w+", text.lower())


class HashingEmbedder:
    """Deterministic bag-of-words vectors of unit length; needs no model files.

    The first 32 bits of a word's MD5 say its place; their highest one is the sign.
    """

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension
        # A word's place, behind those of all others if its sign is positive.
        self._places: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self._places)
        if len(self._places) + len(new) > KNOWN_WORDS:
            self._places.clear()
            new = words
        digests = b"".join([hashlib.md5(word.encode(), usedforsecurity=False).digest() for word in new])
        codes = np.frombuffer(digests, ">u4")[::4].astype(np.int64)
        self._places.update(zip(new, (codes % self.dimension + (codes >> 31) * self.dimension).tolist()))

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        found = [words_of(text) for text in texts]
        lengths = [len(words) for words in found]
        self._learn(set().union(*found))
        places = np.fromiter(map(self._places.__getitem__, chain.from_iterable(found)), np.int64, sum(lengths))
        width = 2 * self.dimension
        places += np.repeat(np.arange(len(texts)) * width, lengths)
        counts = np.bincount(places, minlength=len(texts) * width).reshape(len(texts), 2, self.dimension)
        result = (counts[:, 1] - counts[:, 0]).astype(float)
        norms = np.sqrt((result * result).sum(axis=1, keepdims=True))
        return np.divide(result, norms, out=result, where=norms > 0).tolist()


def embed(
    df: DataFrame, text: str, make_embedder: Callable[[], Embedder], *, output: str = "embedding"
) -> DataFrame:
    """Add unit vectors; the embedder is built once per Python worker stream."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make_embedder()
        for batch in batches:
            for start in range(0, len(batch), EMBED_BATCH):
                texts = [text or "" for text in batch.slice(start, EMBED_BATCH).to_pylist()]
                yield pa.array(embedder.embed_documents(texts), pa.list_(pa.float32()))

    return df.withColumn(output, vectors(F.col(f"`{text}`")))


def latest_vectors(index: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert by key: the newest row of each key; each map task sends on one row of a key."""
    return top_per_group(index, [key], [F.desc(version)], 1, "__place").drop("__place")


def metadata_filter(df: DataFrame, conditions: dict[str, str], column: str = "metadata") -> DataFrame:
    """Equality on metadata map entries, all of them."""
    for key, value in conditions.items():
        df = df.where(F.element_at(F.col(column), F.lit(key)) == value)
    return df


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two float arrays as one expression; 0 where a vector is 0."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def square(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))

    norms = F.sqrt(square(left) * square(right))
    return F.when(norms > 0, F.try_divide(dot, norms)).otherwise(F.lit(0.0))


def vector_search(
    index: DataFrame,
    query: Sequence[float],
    k: int,
    *,
    vector: str = "embedding",
    order: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` most similar rows: one map pass and a distributed top-k."""
    if k <= 0:
        raise ValueError("k must be positive")
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = index.withColumn("score", cosine(F.col(f"`{vector}`"), literal))
    return scored.orderBy(F.desc("score"), *[F.asc(c) for c in order]).limit(k)


def _unit(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list<float> column as unit vectors; widths must agree."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(array.flatten(), dtype=np.float64)
    if len(values) != len(array) * dimension:
        raise ValueError(f"every vector must have {dimension} values")
    matrix = values.reshape(len(array), dimension)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class _Best:
    """Keeps the k best (score, id) per query while blocks of scores pass by."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores: np.ndarray | None = None
        self.ids: np.ndarray | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        wide = np.broadcast_to(ids, scores.shape)
        if self.scores is not None:
            scores = np.concatenate([self.scores, scores], axis=1)
            wide = np.concatenate([self.ids, wide], axis=1)
        if scores.shape[1] > self.k:
            chosen = self._choose(scores, wide)
            scores, wide = (np.take_along_axis(m, chosen, axis=1) for m in (scores, wide))
        self.scores, self.ids = scores, wide

    def _choose(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Columns of the k best scores per row; among equals the smaller ids."""
        chosen = np.argpartition(-scores, self.k - 1, axis=1)[:, : self.k]
        worst = np.take_along_axis(scores, chosen, axis=1).min(axis=1, keepdims=True)
        # Only rows whose last place is shared by more columns than fit need the ids.
        for row in np.flatnonzero((scores >= worst).sum(axis=1) > self.k):
            able = np.flatnonzero(scores[row] >= worst[row])
            chosen[row] = sorted(able, key=lambda c: (-scores[row, c], ids[row, c]))[: self.k]
        return chosen


def _emit(best: _Best, queries: np.ndarray, schema: pa.Schema) -> pa.RecordBatch | None:
    if best.ids is None or best.ids.size == 0:
        return None
    width = best.ids.shape[1]
    columns = [np.repeat(queries, width), best.ids.ravel(), best.scores.ravel()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.tolist(), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def vector_search_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    index_key: str,
    query_key: str,
    vector: str = "embedding",
    blocked: bool | None = None,
) -> DataFrame:
    """``k`` best index rows for every query: query key, index key, score, rank.

    Exact.  A measured, small query set travels to the index partitions and
    each partition answers with its own ``k`` best per query; a larger one is
    cut into blocks that meet blocks of the index, so a task never holds more
    than one block of either.  Only partial top-k rows are shuffled after that.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if index_key == query_key:
        raise ValueError("index and query keys need different names")
    wanted = queries.select(F.col(f"`{query_key}`").alias("q"), F.col(f"`{vector}`").alias("v")).where("v IS NOT NULL")
    rows = index.select(F.col(f"`{index_key}`").alias("i"), F.col(f"`{vector}`").alias("v")).where("v IS NOT NULL")
    q_type, i_type = (d.schema[0].dataType for d in (wanted, rows))
    schema = f"q {q_type.simpleString()}, i {i_type.simpleString()}, score double"
    arrow = pa.schema([("q", to_arrow_type(q_type)), ("i", to_arrow_type(i_type)), ("score", pa.float64())])
    if blocked is None:
        # An estimate counts an array as one value, so only what was written and measured is shipped.
        wanted = freeze(wanted)
        blocked = measured_bytes(wanted) > MAX_SHIPPED_BYTES
    parts = _blocked(rows, wanted, k, schema, arrow) if blocked else _shipped(rows, wanted, k, schema, arrow)
    best = top_per_group(parts, ["q"], [F.desc("score"), F.asc("i")], k)
    return best.select(F.col("q").alias(query_key), F.col("i").alias(index_key), "score", "rank")


def _shipped(rows, wanted, k, schema, arrow) -> DataFrame:
    """Small query side, already measured: one matrix per task."""
    table = wanted.toArrow()
    names = np.array(table.column("q").to_pylist(), dtype=object)
    if not len(names):
        return rows.sparkSession.createDataFrame([], schema)
    dimension = len(table.column("v")[0])
    matrix = _unit(table.column("v"), dimension)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            if batch.num_rows:
                ids = np.array(batch.column("i").to_pylist(), dtype=object)
                for start in range(0, len(ids), BLOCK_ROWS):
                    part = _unit(batch.column("v").slice(start, BLOCK_ROWS), dimension)
                    best.add(matrix @ part.T, ids[start : start + BLOCK_ROWS])
        out = _emit(best, names, arrow)
        if out is not None:
            yield out

    return rows.mapInArrow(score, schema)


def _blocked(rows, wanted, k, schema, arrow) -> DataFrame:
    """Both sides cut into blocks by key hash; every pair of blocks is one group."""
    rows, wanted = freeze(rows), freeze(wanted)
    row_blocks = -(-rows.count() // BLOCK_ROWS) or 1
    query_blocks = -(-wanted.count() // BLOCK_ROWS) or 1

    def blocks(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = rows.withColumn("rb", F.pmod(F.xxhash64("i"), F.lit(row_blocks)).cast("int")).withColumn("qb", blocks(query_blocks))
    right = wanted.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int")).withColumn("rb", blocks(row_blocks))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        dimension = len(b.column("v")[0])
        best = _Best(k)
        ids = np.array(a.column("i").to_pylist(), dtype=object)
        best.add(_unit(b.column("v"), dimension) @ _unit(a.column("v"), dimension).T, ids)
        names = np.array(b.column("q").to_pylist(), dtype=object)
        return pa.Table.from_batches([_emit(best, names, arrow)])

    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(pair, schema)
