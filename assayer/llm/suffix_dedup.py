"""Removing repeated windows of bytes: suffixes ordered through a fixed depth only.

Suffixes are told apart by their first ``WINDOW`` bytes and no further, in passes over
ever finer digits; ranges of a digit deal its holders to tasks, evenly, and
equal groups after the last pass are the repeated windows.  Digits are hashes, not the bytes themselves.

* A window's first digit is its anchor: the ``GRAM``-byte string in it with the least
  hash.  Equal windows have equal anchors, and some 15 neighbouring windows share one,
  so a pass handles anchors, not windows.
* The second digit is everything the windows of an anchor cover.  Where that is equal, all these
  windows are: anchors whose digits occur in a document with a smaller id are done.
* Only anchors that still share their first digit with a different context go on to the
  last pass, where each of their windows is a digit.

Texts are copied once into bucketed units and never shuffled again.  A unit sends
each different digit once, with its smallest document, so that a passage found in a third of
all documents costs no more than one row per unit; it gets one or two bits back for each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import scratch_path, stored

WINDOW = 50
GRAM = 20
SLICE = 1 << 18
NO_ID = np.iinfo(np.int64).max
U64 = np.uint64
FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
# Bytes sent of an anchor's digits (anchor, context, context) and of a window's two hashes.
ANCHOR_SIZES = [5, 8, 8]
WINDOW_SIZES = [8, 8]
KEY_SCHEMA = "part long, unit long, n long, keys binary"


def _pack_units(unit_bytes: int):
    """Rows of (unit, n_bytes, ids, nulls, ends, data): documents of a task, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                if ids and held + len(raw) > unit_bytes:
                    yield _unit_row(unit, ids, texts)
                    ids, texts, held, unit = [], [], 0, unit + 1
                ids.append(doc_id)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield _unit_row(unit, ids, texts)

    return run


def _unit_row(unit: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
    nulls = np.array([i is None for i in ids], np.uint8)
    return pa.RecordBatch.from_arrays(
        [pa.array([unit], pa.int64()), pa.array([int(ends[-1])], pa.int64()),
         *[pa.array([x], pa.binary()) for x in (numbers.tobytes(), nulls.tobytes(), ends.tobytes(), b"".join(texts))]],
        names=["unit", "n_bytes", "ids", "nulls", "ends", "data"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _anchor_part(digits: np.ndarray, parts: int) -> np.ndarray:
    """The part of each anchor digit: parts are ranges of digits that hold about as many anchors each.

    An anchor is the least of its window's hashes, so small digits are the frequent ones.  A string whose hash
    exceeds a share u of all hashes is an anchor with probability q**(w-1) * (1 + (w-1)*u), where q = 1-u and w strings
    make a window; this is that density's distribution function.  Products alone are used, which are the
    same on every machine, of 24 bits, whose steps are well above the rounding errors: the parts never overlap.
    """
    w = WINDOW - GRAM + 1
    q = 1.0 - (digits >> U64(16)).astype(np.float64) / (1 << 24)
    power, square, n = np.ones_like(q), q, w
    while n:
        if n & 1:
            power = power * square
        square, n = square * square, n >> 1
    share = (w + 1) / 2 * (1 - power) - (w - 1) / 2 * (1 - power * q)
    return np.clip((share * parts).astype(np.int64), 0, parts - 1)


def _window_part(digits: np.ndarray, parts: int) -> np.ndarray:
    """Hashes of whole windows are spread evenly: ranges of their most significant bits."""
    return ((digits >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


class Unit:
    """One unit's documents, and the digits of its windows.

    Contexts and windows are known by two independent 64-bit hashes: a false equality among 10**13 of them has a chance below 10**-12.
    """

    def __init__(self, ids: bytes, nulls: bytes, ends: bytes, data: bytes):
        self.ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, np.uint8)
        self.ends, self.data = np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8)
        letters = np.random.default_rng(50).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
        n = min(len(self.data), SLICE + WINDOW) + 1
        self.up = [np.cumprod(np.r_[U64(1), np.full(n, f, np.uint64)]) for f in FACTORS]
        self.down = [np.cumprod(np.r_[U64(1), np.full(n, pow(f, -1, 1 << 64), np.uint64)]) for f in FACTORS]
        self.letters = letters

    def _slices(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Start, and prefix sums from which ``_hashes`` gives the two hashes of any substring."""
        for start in range(0, len(self.data), SLICE):
            part = self.data[start:start + SLICE + WINDOW - 1]
            yield start, [np.r_[U64(0), np.cumsum(l[part] * d[:len(part)])] for l, d in zip(self.letters, self.down)]

    def _hashes(self, sums: list[np.ndarray], at: np.ndarray, length) -> list[np.ndarray]:
        return [(s[at + length] - s[at]) * up[at] for s, up in zip(sums, self.up)]

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: first window, number of windows, document, anchor's digit, context's two hashes."""
        found = []
        width = WINDOW - GRAM + 1
        for start, sums in self._slices():
            n = len(sums[0]) - 1 - WINDOW + 1
            if n <= 0:
                continue
            gram = _mix((sums[0][GRAM:] - sums[0][:-GRAM]) * self.up[0][:len(sums[0]) - GRAM])
            low = (gram & ~U64(0x3FFFFF)) | np.arange(len(gram), dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if width > span:
                low = np.minimum(low[:n], low[width - span:width - span + n])
            doc = np.repeat(np.arange(len(self.ends)), np.diff(np.clip(np.r_[0, self.ends] - start, 0, n)))
            windows = np.flatnonzero(np.arange(n) + start + WINDOW <= self.ends[doc])
            if not len(windows):
                continue
            anchor, doc = (low[windows] & U64(0x3FFFFF)).astype(np.int64), doc[windows]
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            first, count = windows[new], np.diff(np.r_[new, len(windows)])
            contexts = [_mix(h + count.astype(np.uint64)) for h in self._hashes(sums, first, count + WINDOW - 1)]
            found.append((first + start, count, doc[new], gram[anchor[new]] >> U64(24), *contexts))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, *[none.astype(np.uint64)] * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def windows(self, at: np.ndarray) -> list[np.ndarray]:
        """The two hashes of the windows that start at the sorted positions ``at``."""
        out = [np.zeros(len(at), np.uint64) for _ in FACTORS]
        for start, sums in self._slices():
            a, b = np.searchsorted(at, [start, start + SLICE])
            for hashes, found in zip(out, self._hashes(sums, at[a:b] - start, WINDOW)):
                hashes[a:b] = _mix(found)
        return out

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _distinct(digits: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by digits and id; the first row of each different digit; for every row, which digit it has."""
    order = np.lexsort((ids, *digits[::-1]))
    change = np.zeros(len(order), bool)
    change[:1] = True
    for d in digits:
        change[1:] |= d[order[1:]] != d[order[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(change) - 1
    return order, order[change], which


def _planes(values: np.ndarray, size: int = 8) -> bytes:
    """The numbers byte plane by byte plane: what sorted or small numbers have in common then compresses."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(raw: memoryview, n: int, size: int, kind) -> tuple[np.ndarray, memoryview]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw[:n * size], np.uint8).reshape(size, n).T
    return out.reshape(-1).view(kind), raw[n * size:]


def _deal(unit: int, digits: list[np.ndarray], sizes: list[int], ids: np.ndarray, parts: int, part_of) -> Iterator[tuple]:
    """Cut sorted digits into the parts, which are ranges of the first digit."""
    cuts = np.searchsorted(part_of(digits[0], parts), np.arange(parts + 1))
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            yield part, unit, int(b - a), b"".join([*(_planes(d[a:b], s) for d, s in zip(digits, sizes)), _planes(ids[a:b])])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


_KEYS = pa.schema([("part", pa.int64()), ("unit", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])
_BITS = pa.schema([("unit", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def _unit_of(row: dict) -> Unit:
    return Unit(row["ids"], row["nulls"], row["ends"], row["data"])


def _answer(answers: list[dict] | None, planes: int) -> np.ndarray:
    """A unit's bits, in the order of its sorted digits."""
    out = []
    for a in sorted(answers or [], key=lambda a: a["part"]):
        bits = np.frombuffer(a["bits"], np.uint8).reshape(planes, -1)
        out.append(np.unpackbits(bits, axis=1, count=a["n"]).astype(bool))
    return np.concatenate(out, axis=1) if out else np.zeros((planes, 0), bool)


def _send_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                unit = _unit_of(row)
                _, _, doc, *digits = unit.anchors()
                ids = unit.ids[doc]
                _, firsts, _ = _distinct(digits, ids)
                yield _rows(list(_deal(row["unit"], [d[firsts] for d in digits], ANCHOR_SIZES, ids[firsts], parts, _anchor_part)), _KEYS)

    return run


def _judge(sizes: list[int], anchors: bool):
    """For each sent digit: is it in a document with a smaller id; of anchors also: do documents share its first digit otherwise."""

    def run(table: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[] for _ in range(len(sizes) + 1)]
        counts = table.column("n").to_numpy()
        for n, keys in zip(counts, table.column("keys")):
            raw = memoryview(keys.as_buffer())
            for column, size in zip(columns, [*sizes, 8]):
                values, raw = _numbers(raw, n, size, np.int64 if column is columns[-1] else np.uint64)
                column.append(values)
        *digits, ids = (np.concatenate(c) for c in columns)
        order, firsts, which = _distinct(digits, ids)
        bits = [ids[firsts][which] < ids]
        if anchors:
            start = np.flatnonzero(np.r_[True, digits[0][order[1:]] != digits[0][order[:-1]]])
            group = np.empty(len(order), np.int64)
            group[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
            lowest, highest = np.minimum.reduceat(ids[order], start), np.maximum.reduceat(ids[order], start)
            contexts = np.bincount(group[firsts], minlength=len(start))
            bits.append(((lowest < highest) & (contexts > 1))[group] & ~bits[0])
        ends = np.cumsum(counts)
        packed = [b"".join(np.packbits(b[e - n:e]).tobytes() for b in bits) for e, n in zip(ends, counts)]
        return pa.table([table.column("unit"), table.column("part"), table.column("n"), pa.array(packed, pa.binary())], schema=_BITS)

    return run


def _open_windows(unit: Unit, answers: list[dict] | None) -> tuple[np.ndarray, ...]:
    """After the first two digits: runs that are repeats as a whole, and the windows still open with their digits."""
    first, count, doc, *digits = unit.anchors()
    ids = unit.ids[doc]
    _, firsts, which = _distinct(digits, ids)
    smaller, shared = _answer(answers, 2)
    done = smaller[which] | (ids > ids[firsts][which])
    still = shared[which] & ~done
    n = count[still]
    at = np.repeat(first[still], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first[done], count[done], at, unit.windows(at), unit.ids[unit.documents(at)]


def _send_windows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, _, _, digits, ids = _open_windows(_unit_of(row), row["answers"])
                _, firsts, _ = _distinct(digits, ids)
                yield _rows(list(_deal(row["unit"], [d[firsts] for d in digits], WINDOW_SIZES, ids[firsts], parts, _window_part)), _KEYS)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            unit = _unit_of(row)
            first, count, at, digits, ids = _open_windows(unit, row["answers"])
            _, firsts, which = _distinct(digits, ids)
            hit = at[_answer(row["answers2"], 1)[0][which] | (ids > ids[firsts][which])]
            marks = np.zeros(len(unit.data) + 1, np.int32)
            np.add.at(marks, np.r_[first, hit], 1)
            np.add.at(marks, np.r_[first + count + WINDOW - 1, hit + WINDOW], -1)
            gone = np.cumsum(marks[:-1]) > 0
            out = []
            for doc_id, null, start, end in zip(unit.ids.tolist(), unit.nulls, np.r_[0, unit.ends[:-1]], unit.ends):
                cut, text = gone[start:end], unit.data[start:end]
                spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                out.append((None if null else doc_id, int(end - start), int(cut.sum()), spans, text[~cut].tobytes()))
            yield _rows(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                                        ("n_spans", pa.int64()), ("kept", pa.binary())]))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        hashes = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut_repeats(docs: DataFrame, digests: bool = False, unit_bytes: int = 1 << 21, part_bytes: int = 1 << 23) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    One row per row of ``docs`` (integer doc_id, text): doc_id, n_bytes, n_removed, n_spans and
    the bytes that stay (``kept``; with ``digests`` their SHA-256 as ``kept_sha256``).  Matches lie within a
    document and are judged on the input.  NULL and empty texts, and texts below 50 bytes,
    lose nothing; rows with one doc_id do not cut each other; a NULL doc_id counts as the
    largest of all.  Other columns are ignored.

    ``unit_bytes`` of text are worked on at a time, and one task judges the digits of
    about ``part_bytes`` of text.  A unit sends one row to each part, so both should grow with the square
    root of the input beyond some TB.
    """
    spark = docs.sparkSession
    name, path = f"suffix_units_{uuid.uuid4().hex}", scratch_path(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select(F.col("doc_id").cast("long"), "text")
         .mapInArrow(_pack_units(unit_bytes), "unit long, n_bytes long, ids binary, nulls binary, ends binary, data binary")
         .write.bucketBy(buckets, "unit").option("path", path).option("compression", "zstd").saveAsTable(name))
    units = spark.table(name)
    parts = max(1, -(-(units.agg(F.sum("n_bytes")).first()[0] or 0) // part_bytes))

    def judged(keys: DataFrame, sizes: list[int], answer: str, anchors: bool) -> DataFrame:
        bits = keys.groupBy("part").applyInArrow(_judge(sizes, anchors), "unit long, part long, n long, bits binary")
        return stored(bits.groupBy("unit").agg(F.collect_list(F.struct("part", "n", "bits")).alias(answer)))

    first = judged(units.mapInArrow(_send_anchors(parts), KEY_SCHEMA), ANCHOR_SIZES, "answers", True)
    answered = units.join(first.hint("shuffle_hash"), "unit", "left")
    second = judged(answered.mapInArrow(_send_windows(parts), KEY_SCHEMA), WINDOW_SIZES, "answers2", False)
    answered = answered.join(second.hint("shuffle_hash"), "unit", "left")
    if digests:
        return answered.mapInArrow(_digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return answered.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
