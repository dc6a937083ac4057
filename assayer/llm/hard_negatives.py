"""Hard negatives by a secondary sort: each anchor's pairs come by falling score, and windows open as positives pass.

Anchors are a stated set of queries.  They meet all rows block by block: rows lie in stripes of
bounded size, each block of anchors is scored against each stripe, and only pairs that can still
count leave it.  A pair is one packed key (anchor, falling score, kind, id), so the bytes' order is the
order of the result.  ``repartitionAndSortWithinPartitions`` brings an anchor's keys into
one stream; an iterator reads it once and holds the open windows only.

Two such sorts are made.  The first finds each anchor's positives: a stripe sends its best few.
The second has these positives and, of each stripe, the negatives that are among its best few in
one of the anchor's windows, so the anchor of any hot label gets a bounded number of
keys from a stripe however many rows it holds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import stored

STRIPE_ROWS = 1 << 16
BLOCK_ANCHORS = 256
# Scores are cut at this size, so that 100 times a score fits 64 bits.
MOST = (1 << 62) // 100
SIGN = np.uint64(1 << 63)
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1
RESULT = T.StructType([
    T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("negative_id", T.LongType()), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType()),
])
PACKED = "place long, ids binary, labels binary, codes binary, scores binary"
_PACKED = pa.schema([("place", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "codes", "scores"))])


def _pack(scale: float, width: int):
    """One row per group: ids in order, and the rows' whole-numbered components as one matrix."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        codes = np.zeros((len(ids), width))
        for row, vector in zip(codes, table.column("vector").to_pylist()):
            row[:len(vector)] = vector
        codes = np.floor(scale * codes)
        scores = np.array(table.column("scores").to_pylist(), np.int64) if "scores" in table.column_names else np.zeros(0, np.int64)
        held = (ids[order], table.column("label").to_numpy()[order], codes[order], scores[order] if len(scores) else scores)
        return pa.table([[table.column("place")[0].as_py()], *([np.ascontiguousarray(x).tobytes()] for x in held)], schema=_PACKED)

    return run


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    size = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if size < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    if size < MOST:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a).dot(whole(b.T)), -MOST, MOST).astype(np.int64)


def _keys(anchor: int, scores: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Packed so that bytes order by anchor, falling score, kind and id."""
    out = np.empty(len(ids), KEY)
    out["anchor"] = np.int64(anchor).view(np.uint64) ^ SIGN
    out["score"] = ~(np.ascontiguousarray(scores, np.int64).view(np.uint64) ^ SIGN)
    out["kind"] = kind
    out["id"] = np.ascontiguousarray(ids, np.int64).view(np.uint64) ^ SIGN
    raw = out.tobytes()
    return [raw[i:i + KEY.itemsize] for i in range(0, len(raw), KEY.itemsize)]


def _read(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, vec_id = struct.unpack(">QQBQ", key)
    return anchor - (1 << 63), (~score & 0xFFFFFFFFFFFFFFFF) - (1 << 63), kind, vec_id - (1 << 63)


def _met(width: int, search):
    """Score each block of anchors against its stripe, and send what ``search`` finds."""

    def matrix(raw: bytes) -> np.ndarray:
        flat = np.frombuffer(raw, np.float64)
        return flat.reshape(-1, width) if width else flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                a_ids, a_labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
                limits = np.frombuffer(row["a_scores"], np.int64).reshape(len(a_ids), -1)
                if width:
                    scores = _scores(matrix(row["a_codes"]), matrix(row["codes"]))
                else:
                    scores = np.zeros((len(a_ids), len(ids)), np.int64)
                keys = [k for x in zip(a_ids.tolist(), a_labels, limits, scores) for k in search(*x, ids, labels)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return run


def _best_positives(count: int):
    def search(anchor, label, _, scores, ids, labels):
        same = np.flatnonzero((labels == label) & (ids != anchor))
        best = same[np.argsort(-scores[same], kind="stable")[:count]]
        return _keys(anchor, scores[best], POSITIVE, ids[best])

    return search


def _best_negatives(count: int, low: int):
    def search(anchor, label, limits, scores, ids, labels):
        limits = limits[limits > -MOST - 1]
        at = np.flatnonzero((labels != label) & (scores <= limits.max()) & (100 * scores >= low * limits.min()))
        at = at[np.argsort(-scores[at], kind="stable")]
        falling = -scores[at]
        chosen: set[int] = set()
        for limit in set(limits.tolist()):
            first = np.searchsorted(falling, -limit)
            window = at[first:first + count]
            chosen.update(window[100 * scores[window] >= low * limit].tolist())
        found = np.array(sorted(chosen), np.int64)
        return _keys(anchor, scores[found], NEGATIVE, ids[found])

    return search


def _first_positives(count: int):
    """An anchor's first keys, as (anchor, scores, ids)."""

    def run(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, list[int], list[int]]]:
        anchor, scores, ids = None, [], []
        for key, _ in keys:
            this, score, _, vec_id = _read(key)
            if this != anchor:
                if ids:
                    yield anchor, scores, ids
                anchor, scores, ids = this, [], []
            if len(ids) < count:
                scores.append(score)
                ids.append(vec_id)
        if ids:
            yield anchor, scores, ids

    return run


def _open_windows(count: int, low: int):
    """Positives open a window, negatives are given to every open one; a full or passed window closes."""

    def run(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        anchor, windows = None, []
        for key, _ in keys:
            this, score, kind, vec_id = _read(key)
            if this != anchor:
                anchor, windows = this, []
            if kind == POSITIVE:
                windows.append([vec_id, score, 0])
                continue
            windows = [w for w in windows if w[2] < count and 100 * score >= low * w[1]]
            for window in windows:
                window[2] += 1
                yield anchor, window[0], window[2], vec_id, window[1], score

    return run


def _one_stream_per_anchor(keys: DataFrame):
    """The keys dealt by their anchor and sorted by their bytes."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(
        parts, lambda key: zlib.crc32(key[:8]))


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: float = 256,
    stripe_rows: int = STRIPE_ROWS,
) -> DataFrame:
    """For every anchor and each of its positives, the first ``negatives`` rows of another label that score close below.

    ``vectors`` has an integer vec_id, an integer label and an array of numbers, ``embedding``;
    ``anchors`` says which rows are anchors.  Components become floor(scale * x).  A row's score is
    its inner product with the anchor; higher scores come first, ties by smaller vec_id.  An anchor's
    positives are its first ``positives`` other rows of its label; a negative n of a positive p has
    low * p <= 100 * n <= 100 * p.  Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows with a NULL vec_id, label or vector, or a NULL or non-finite component, take no part.  Rows
    that repeat a vec_id count once (the least by label, then vector).  Shorter vectors are
    filled up with zeros.  Scores beyond 2^62 / 100 are cut there.  An empty table, and an anchor
    without positives or negatives, give no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    picked = vectors.where(good).select(
        F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), F.transform(
            x, lambda v: v.cast("double")).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")).alias("row"))
    rows = stored(picked.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*"))
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.max(F.size("vector"))).first()
    if not n or not n_anchors:
        return spark.createDataFrame([], RESULT)
    cores = spark.sparkContext.defaultParallelism
    stripes = -(-n // min(stripe_rows, max(1024, -(-n // cores))))
    blocks = -(-n_anchors // BLOCK_ANCHORS)

    def packed(df: DataFrame, places: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id"), F.lit(places)).alias("place")
        columns = [c for c in ("vec_id", "label", "vector", "scores") if c in df.columns]
        return df.select(place, *columns).groupBy("place").applyInArrow(_pack(scale, width), PACKED)

    striped = stored(packed(rows, stripes).drop("scores"))

    def met(asked: DataFrame, search) -> DataFrame:
        """A stated set of queries against all rows: every block of it goes to every stripe."""
        copies = packed(asked, blocks).select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("place"),
            *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "codes", "scores")])
        return striped.join(copies, "place").mapInArrow(_met(width, search), "key binary")

    asked = rows.where("is_anchor")
    first = _one_stream_per_anchor(met(asked, _best_positives(positives))).mapPartitions(_first_positives(positives))
    found = stored(spark.createDataFrame(first, "vec_id long, scores array<long>, ids array<long>"))
    filled = F.concat("scores", F.array_repeat(F.lit(-MOST - 1).cast("long"), F.lit(positives) - F.size("scores")))
    asked = asked.join(found.select("vec_id", filled.alias("scores")), "vec_id")
    opening = found.select("vec_id", F.posexplode("ids").alias("place", "id"), "scores").select(
        "vec_id", F.expr("scores[place]").alias("score"), "id").mapInArrow(_positive_keys, "key binary")
    keys = opening.unionAll(met(asked, _best_negatives(negatives, low)))
    return spark.createDataFrame(_one_stream_per_anchor(keys).mapPartitions(_open_windows(negatives, low)), RESULT)


def _positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_keys(a, np.array([s]), POSITIVE, np.array([i]))[0] for a, s, i in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])
