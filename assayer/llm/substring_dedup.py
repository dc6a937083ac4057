"""Removing passages that stand in more than one place: seeds are joined, then extended both ways.

* Seeds: the text's ``SEED``-word grams are winnowed.  Every ``WINDOW`` consecutive words hold
  ``WINDOW - SEED + 1`` grams, and the one with the least hash, leftmost of equals, is their
  anchor.  Equal windows have equal anchors at equal places, and neighbouring windows share one,
  so about one word in ten is an anchor.
* Join: the same anchors of all documents meet.  An anchor that stands in one place has no match.
* Extension: an anchor is extended to the left and to the right as far as the windows reach
  that it stands for.  Where an anchor's extensions are the same everywhere, all its windows
  are repeats.  Where they differ, matches are extended by less on one side and more on the other:
  each window is a way of extending the anchor to ``WINDOW`` words, and the ways are compared
  by 128-bit digests of their words.  No two occurrences are paired, so a passage that
  stands in a third of all documents costs its occurrences, not their square.
* What repeated windows cover, taken together, are the maximal repeats of at least ``WINDOW`` words.

Texts are copied once into bucketed units and never shuffled again.  A unit sends each
different anchor at most twice and each different open window once, and gets bits back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import scratch_path, stored

WINDOW = 35
SEED = 16
U64 = np.uint64
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLACE = U64(0xFFFFFFFF)
UNIT_SCHEMA = "unit long, n_bytes long, ids array<long>, texts array<string>"
KEY_SCHEMA = "part long, unit long, n long, keys binary"
BIT_SCHEMA = "unit long, part long, n long, bits binary"
_UNITS = pa.schema([("unit", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])
_KEYS = pa.schema([("part", pa.int64()), ("unit", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])
_BITS = pa.schema([("unit", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _fill_units(unit_bytes: int):
    """Gather a task's documents into units of about ``unit_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                size = text.as_buffer().size if text.is_valid else 0
                if ids and held + size > unit_bytes:
                    yield _batch([(unit, held, ids, texts)], _UNITS)
                    unit, ids, texts, held = unit + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += size
        if ids:
            yield _batch([(unit, held, ids, texts)], _UNITS)

    return run


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Words:
    """The words of a unit's documents; prefix sums give the digest of any run of them."""

    def __init__(self, texts: list[str]):
        # bytes.split() takes exactly space and \x09-\x0D as blanks.
        self.lists = [text.encode().split() for text in texts]
        self.ends = np.cumsum([len(words) for words in self.lists], dtype=np.int64)
        flat = b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(self.lists)))
        lanes = np.frombuffer(flat, np.uint64).reshape(-1, 2)
        self.n = len(lanes)
        self.up, self.sums = [], []
        for lane, factor in enumerate(FACTORS):
            down = np.cumprod(np.full(self.n, pow(factor, -1, 1 << 64), np.uint64))
            self.up.append(np.cumprod(np.r_[U64(1), np.full(self.n, factor, np.uint64)]))
            self.sums.append(np.r_[U64(0), np.cumsum(lanes[:, lane] * np.r_[U64(1), down[:-1]][:self.n])])

    def digest(self, at: np.ndarray, length, lane: int = 0) -> np.ndarray:
        """64 bits for each run of ``length`` words from ``at`` on."""
        sums = self.sums[lane]
        return _scramble((sums[at + length] - sums[at]) * self.up[lane][at] + np.asarray(length).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: first window, number of windows, anchor's digest, extension's digest."""
        starts = self.n - WINDOW + 1
        if starts <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        gram = self.digest(np.arange(self.n - SEED + 1), SEED)
        low = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
        span, width = 1, WINDOW - SEED + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:starts], low[width - span:width - span + starts])
        document = np.searchsorted(self.ends, np.arange(starts), side="right")
        windows = np.flatnonzero(np.arange(starts) + WINDOW <= self.ends[document])
        anchor = (low[windows] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][:len(anchor)])
        first, count = windows[new], np.diff(np.r_[new, len(windows)])
        # Scrambled once more: an anchor is the least of many hashes, and parts take equal shares of the digests' range.
        return first, count, _scramble(gram[anchor[new]] + U64(1)) >> U64(24), self.digest(first, count + WINDOW - 1)


class Groups:
    """Rows ordered by one or two digests, and the groups of equal ones."""

    def __init__(self, *digests: np.ndarray):
        self.order = np.lexsort(digests[::-1])
        new = np.zeros(len(self.order), bool)
        new[:1] = True
        for d in digests:
            new[1:] |= d[self.order[1:]] != d[self.order[:-1]]
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.r_[self.starts, len(new)])
        self.of = np.empty(len(new), np.int64)
        self.of[self.order] = np.cumsum(new) - 1

    def reduce(self, function: np.ufunc, values: np.ndarray) -> np.ndarray:
        return function.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]


def _pack(values: np.ndarray, size: int) -> bytes:
    """Byte plane by byte plane: what sorted numbers have in common then compresses."""
    return np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpack(raw: memoryview, n: int, size: int) -> tuple[np.ndarray, memoryview]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw[:n * size], np.uint8).reshape(size, n).T
    return out.reshape(-1).view(np.uint64), raw[n * size:]


def _deal(unit: int, first: np.ndarray, second: np.ndarray, several: np.ndarray, size: int, parts: int) -> Iterator[tuple]:
    """Cut rows that are ordered by their first digest into equal shares of its range."""
    top = first >> U64(8 * size - 32)
    cuts = np.searchsorted(top * U64(parts) >> U64(32), np.arange(parts + 1, dtype=np.uint64))
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            keys = _pack(first[a:b], size) + _pack(second[a:b], 8) + np.packbits(several[a:b]).tobytes()
            yield part, unit, int(b - a), keys


def _anchor_rows(words: Words) -> tuple:
    """Each different anchor with the least and the greatest of its extensions here, and whether it stands here twice."""
    first, count, anchor, extension = words.anchors()
    groups = Groups(anchor)
    least, most = groups.reduce(np.minimum, extension), groups.reduce(np.maximum, extension)
    kinds, several = anchor[groups.order[groups.starts]], groups.sizes > 1
    rows = np.sort(np.r_[np.arange(len(kinds)), np.flatnonzero(least != most)])
    second = np.r_[False, rows[1:] == rows[:-1]][:len(rows)]
    return (first, count, groups.of), kinds[rows], np.where(second, most[rows], least[rows]), several[rows], ~second


def _open_windows(words: Words, answers: list[dict] | None) -> tuple:
    """Runs that are repeats as a whole, and of the other joined anchors the different windows."""
    (first, count, kind), _, _, _, leading = _anchor_rows(words)
    whole, open_ = _answer(answers, 2)[:, leading]
    whole, open_ = whole[kind], open_[kind]
    n = count[open_]
    at = np.repeat(first[open_], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    one, two = words.digest(at, WINDOW), words.digest(at, WINDOW, 1)
    groups = Groups(one, two)
    rows = groups.order[groups.starts]
    return (first[whole], count[whole]), at, groups, one[rows], two[rows]


def _answer(answers: list[dict] | None, planes: int) -> np.ndarray:
    """A unit's bits, in the order in which it sent its rows."""
    out = [np.unpackbits(np.frombuffer(a["bits"], np.uint8).reshape(planes, -1), axis=1, count=a["n"])
           for a in sorted(answers or [], key=lambda a: a["part"])]
    return np.concatenate(out, axis=1).astype(bool) if out else np.zeros((planes, 0), bool)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _send_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            _, anchor, extension, several, _ = _anchor_rows(Words(row["texts"]))
            yield _batch(list(_deal(row["unit"], anchor, extension, several, 5, parts)), _KEYS)

    return run


def _send_windows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            _, _, groups, one, two = _open_windows(Words(row["texts"]), row["answers"])
            yield _batch(list(_deal(row["unit"], one, two, groups.sizes > 1, 8, parts)), _KEYS)

    return run


def _received(table: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    found = []
    for n, keys in zip(table.column("n").to_pylist(), table.column("keys")):
        first, raw = _unpack(memoryview(keys.as_buffer()), n, size)
        second, raw = _unpack(raw, n, 8)
        found.append((first, second, np.unpackbits(np.frombuffer(raw, np.uint8), count=n)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bits(table: pa.Table, planes: list[np.ndarray]) -> pa.Table:
    counts = table.column("n").to_numpy()
    ends = np.cumsum(counts)
    packed = [b"".join(np.packbits(b[e - n:e]).tobytes() for b in planes) for e, n in zip(ends, counts)]
    return pa.table([table.column("unit"), table.column("part"), table.column("n"), pa.array(packed, pa.binary())], schema=_BITS)


def _join_anchors(table: pa.Table) -> pa.Table:
    """For each anchor: it stands in several places, everywhere or not everywhere with the same extension."""
    anchor, extension, several = _received(table, 5)
    groups = Groups(anchor)
    joined = groups.reduce(np.add, several.astype(np.int64) + 1) > 1
    same = groups.reduce(np.minimum, extension) == groups.reduce(np.maximum, extension)
    return _bits(table, [(joined & same)[groups.of], (joined & ~same)[groups.of]])


def _join_windows(table: pa.Table) -> pa.Table:
    """For each window: it stands in several places."""
    one, two, several = _received(table, 8)
    groups = Groups(one, two)
    return _bits(table, [(groups.reduce(np.add, several.astype(np.int64) + 1) > 1)[groups.of]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        words = Words(row["texts"])
        (first, count), at, groups, _, _ = _open_windows(words, row["answers"])
        hit = at[_answer(row["answers2"], 1)[0][groups.of]]
        marks = np.zeros(words.n + 1, np.int32)
        np.add.at(marks, np.r_[first, hit], 1)
        np.add.at(marks, np.r_[first + count + WINDOW - 1, hit + WINDOW], -1)
        gone = np.cumsum(marks[:-1]) > 0
        out = []
        for doc_id, listed, end in zip(row["ids"], words.lists, words.ends):
            cut = gone[end - len(listed):end]
            spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
            kept = b" ".join(compress(listed, ~cut)).decode()
            out.append((doc_id, len(listed), int(cut.sum()), spans, kept))
        yield _batch(out, _CUT)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        hashes = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])


def cut_shared_passages(docs: DataFrame, digests: bool = False, unit_bytes: int = 1 << 21, part_bytes: int = 1 << 24) -> DataFrame:
    """Remove every word covered by a 35-word window that also starts anywhere else, in the same document or another.

    One row per row of ``docs`` (integer doc_id, text): doc_id, n_words, n_removed, n_spans
    (maximal repeats) and ``kept``, the words that stay, joined by one space (with ``digests``
    their SHA-256 as ``kept_sha256``).  Windows lie within a row and are judged on the input, so all
    copies of a passage go, the first one included.

    NULL and empty texts have no words; texts below 35 words lose nothing; a repeated row is a
    copy like any other, so both lose all words; a NULL doc_id stays NULL.  Other columns are ignored.
    Texts may be of any length; a task works on one unit at a time and takes some 20 times its bytes, or
    those of one longer document.

    ``unit_bytes`` of text are worked on at a time, and one task joins the anchors of about
    ``part_bytes`` of text.  A unit sends one row to each part, so both should grow with the
    square root of the input beyond some TB.
    """
    spark = docs.sparkSession
    name, path = f"passage_units_{uuid.uuid4().hex}", scratch_path(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fill_units(unit_bytes), UNIT_SCHEMA)
         .write.bucketBy(buckets, "unit").option("path", path).option("compression", "zstd").saveAsTable(name))
    units = spark.table(name)
    parts = max(1, -(-(units.agg(F.sum("n_bytes")).first()[0] or 0) // part_bytes))

    def joined(keys: DataFrame, join, answer: str) -> DataFrame:
        bits = keys.groupBy("part").applyInArrow(join, BIT_SCHEMA)
        return stored(bits.groupBy("unit").agg(F.collect_list(F.struct("part", "n", "bits")).alias(answer)))

    first = joined(units.mapInArrow(_send_anchors(parts), KEY_SCHEMA), _join_anchors, "answers")
    answered = units.join(first.hint("shuffle_hash"), "unit", "left")
    second = joined(answered.mapInArrow(_send_windows(parts), KEY_SCHEMA), _join_windows, "answers2")
    answered = answered.join(second.hint("shuffle_hash"), "unit", "left")
    columns = "doc_id long, n_words long, n_removed long, n_spans long"
    if digests:
        return answered.mapInArrow(_digested, f"{columns}, kept_sha256 string")
    return answered.mapInArrow(_cut, f"{columns}, kept string")
