"""Near-duplicates by SimHash, compared in bit-sliced blocks.

Each whole text gets a 64-bit fingerprint.  Different fingerprints that may lie
within the radius meet because they agree on two of ``radius + 2`` bit blocks (with at
most ``radius`` differing bits at least two blocks are intact), so no link is lost and
nothing is compared with everything.  Fingerprints that meet are stored as bit
planes, 64 of them to a machine word: one pass over the planes updates 64
distances at once with carry-save counters, and a word is abandoned once all its
distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stored
from .components import stars

BITS = 64
SHINGLE = 4
SEED = 42
# Keys shared by more fingerprints are dealt out as pairs of chunks of about this size.
CHUNK = 8192
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    after = list(accumulate(len(w) + 1 for w in words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b - 1], SEED) for a, b in zip([0, *after], after[size - 1:])), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "text_hash", "fp"])


def close_words(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which members of the same group differ in at most ``radius`` bits.

    ``fps`` holds the groups one after the other.  Returns members, words and lanes: a
    set bit in ``lanes`` says that this member is near the group's member with that lane in that word
    (its own lane is left out).
    """
    n_words = -(-sizes // 64)
    first = np.cumsum(sizes) - sizes
    first_word = np.cumsum(n_words) - n_words
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(fps)) - first[group]
    word, lane = first_word[group] + at // 64, (at % 64).astype(np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    one = np.uint64(1)
    planes = np.empty((BITS, len(starts)), np.uint64)
    for b in range(BITS):
        planes[b] = np.bitwise_or.reduceat(((fps >> np.uint64(b)) & one) << lane, starts)
    absent = ~np.bitwise_or.reduceat(one << lane, starts)
    width = (radius + 1).bit_length()
    preset = (1 << width) - (radius + 1)
    member = np.repeat(np.arange(len(fps)), n_words[group])
    against = np.arange(len(member)) - np.repeat(np.cumsum(n_words[group]) - n_words[group], n_words[group]) + first_word[group[member]]
    found = []
    for at in range(0, len(member), 1 << 17):
        q, w = member[at:at + (1 << 17)], against[at:at + (1 << 17)]
        dead = absent[w] | np.where(word[q] == w, one << lane[q], np.uint64(0))
        counter = [np.full(len(q), FULL if preset >> k & 1 else 0, np.uint64) for k in range(width)]
        for b in range(BITS):
            carry = planes[b][w] ^ (np.uint64(0) - ((fps[q] >> np.uint64(b)) & one))
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            dead |= carry  # the counter ran over: more than radius bits differ
            if b % 8 == 7:
                alive = np.flatnonzero(dead != FULL)
                if len(alive) < len(q):
                    q, w, dead, counter = q[alive], w[alive], dead[alive], [c[alive] for c in counter]
                if not len(q):
                    break
        found.append((q, w, ~dead))
    q, w, near = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return q, w - first_word[group[q]], near


def _forest(fps: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is near within each group: at most one per member."""
    links: list[tuple[int, int]] = []
    first = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    near: dict[int, dict[int, int]] = {}
    for q, w, lanes in zip(*(x.tolist() for x in close_words(fps, sizes, radius))):
        own = near.setdefault(int(group[q]), {})
        at = q - int(first[group[q]])
        own[at] = own.get(at, 0) | lanes << (64 * w)
    for g, own in near.items():
        values = fps[first[g]:first[g] + sizes[g]].view(np.int64).tolist()
        left = set(own)
        while left:
            root = left.pop()
            done, reached = 1 << root, own[root]
            while todo := reached & ~done:
                i = (todo & -todo).bit_length() - 1
                done |= 1 << i
                reached |= own[i]
                left.discard(i)
                links.append((values[root], values[i]))
    return links


def _link_groups(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):  # None: the last group is complete
            table = np.zeros((5, 0), np.int64) if batch is None else np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            table = table if rest is None else np.concatenate([rest, table], axis=1)
            change = np.flatnonzero(np.any(table[:4, 1:] != table[:4, :-1], axis=0)) + 1
            starts = np.r_[0, change] if table.shape[1] else change
            if batch is not None:
                cut = starts[-1] if len(starts) else 0
                rest, table, starts = table[:, cut:], table[:, :cut], starts[:-1]
            sizes = np.diff(np.r_[starts, table.shape[1]])
            many = np.repeat(sizes > 1, sizes)
            links = _forest(table[4, many].view(np.uint64), sizes[sizes > 1], radius) if many.any() else []
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) between different values of column ``fp`` that connect what is near.

    A key shared by more than ``CHUNK`` values is cut into chunks, and each pair of chunks is a
    group of its own, so no task holds a hot key.
    """
    widths = [BITS // (radius + 2) + (i < BITS % (radius + 2)) for i in range(radius + 2)]
    shifts = list(accumulate(widths, initial=0))
    masks = [((1 << w) - 1) << s for w, s in zip(widths, shifts)]
    signed = [m - (1 << 64) if m >> 63 else m for m in (masks[i] | masks[j] for i, j in combinations(range(radius + 2), 2))]
    keys = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)
    ])).alias("k")).select("k.table", "k.key", "fp")
    hot = stored(keys.groupBy("table", "key").count().where(F.col("count") > CHUNK).select(
        "table", "key", F.ceil(F.col("count") / CHUNK).alias("chunks")))
    dealt = keys.join(hot, ["table", "key"], "left").select(
        "table", "key", "fp", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    other = F.explode(F.expr("CASE WHEN chunks = 1 THEN array(0L) ELSE filter(sequence(0L, chunks - 1), i -> i <> own) END"))
    pairs = dealt.withColumn("other", other).select(
        "table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    grouped = pairs.repartition("table", "key", "low", "high").sortWithinPartitions("table", "key", "low", "high")
    return grouped.mapInArrow(_link_groups(radius), "u long, v long")


def _assigned(docs: DataFrame, radius: int) -> DataFrame:
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _fingerprints, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long"))
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    roots = stars(near_links(groups.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = stored(groups.join(roots, "fp", "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root")))
    lowest = stored(rooted.groupBy("root").agg(F.min("lowest").alias("component_id")))
    known = stored(rooted.join(lowest, "root").select("fp", "root", "component_id"))
    return rows.join(known, "fp")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    A component holds all that is reachable over fingerprints that differ in at most
    ``radius`` bits; its id is the smallest doc_id in it.  NULL and empty texts have
    fingerprint zero and are linked like any other; fewer than four words count as one
    shingle.  Other columns are ignored.
    """
    return _assigned(docs, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component, with all its columns."""
    first = _assigned(docs, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.first("doc_id").alias("__id"), F.min("text_hash").alias("__hash"))
    kept = first.select("__id", "__hash")
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__hash"])
    tagged = docs.withColumn("__text_hash", F.xxhash64("text"))
    return tagged.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__text_hash"]).select(*docs.columns)
