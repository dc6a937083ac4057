"""Mixing sources to target weights in fixed-length blocks.

The words of a source, in a fixed order of its documents, are cut into blocks of
``block_words``.  Every output shard draws how many of its slots each source fills; the
slots of a source are numbered through all shards, and a keyed permutation of its
block numbers (a new one for every pass through the source) says which block a slot takes.  Blocks and
documents then meet by (source, block).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
CELLS = 1024
# Characters of passages in a batch that is sent on.
CUT_CHARS = 1 << 20
SEED = 17
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> dict:
    """Words to take of each source: all sizes shared by weight, at most ``max_repeats`` times the source.

    Sources in code point order, None last, take the weights in turn; what a full
    source cannot take is shared among the others by weight until none is above its limit.
    """
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    found, open_names, rest = {}, names, float(sum(sizes.values()))
    while open_names:
        unit = rest / sum(weight[name] for name in open_names)
        full = [name for name in open_names if weight[name] * unit > max_repeats * sizes[name]]
        if not full:
            return found | {name: weight[name] * unit for name in open_names}
        found |= {name: float(max_repeats * sizes[name]) for name in full}
        rest -= sum(found[name] for name in full)
        open_names = [name for name in open_names if name not in found]
    return found


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1, element by element (Feistel, cycle-walking)."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = value[todo] >> h, value[todo] & m
        for turn in range(4):
            mixed = (right + k + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= size[todo].astype(np.uint64)]
    return value.astype(np.int64)


def _draw(share: np.ndarray, slots: int, shard_slots: int, seed: int):
    """Per shard: how many slots each source fills.

    The whole parts of the expected counts are fixed; only the slots left over are drawn
    (multinomially, by the fractions), so each source stays within a few slots of its share.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for shard in frame["id"]:
                n = min(shard_slots, slots - shard * shard_slots)
                counts = np.floor(n * share).astype(np.int64)
                rest = n * share - counts
                if (left := int(n - counts.sum())) > 0 and rest.sum() > 0:
                    counts += np.random.default_rng([seed, int(shard)]).multinomial(left, rest / rest.sum())
                used = np.flatnonzero(counts)
                out.append(pd.DataFrame({"shard": shard, "source_index": used, "n": counts[used]}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "source_index": [], "n": []}, dtype="int64")

    return run


def _slots(blocks: np.ndarray, max_repeats: int, seed: int):
    """The block that each slot takes; a source's slots beyond its allowed passes stay empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shard, source, start, n = (frame[c].to_numpy(np.int64) for c in ("shard", "source_index", "start", "n"))
            source, shard = np.repeat(source, n), np.repeat(shard, n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slot = within + np.repeat(start, n)
            size = blocks[source]
            turn = slot // size
            key = (source * 1_000_003 + turn * 7919 + seed).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            block = permuted(slot % size, size, key)
            ok = turn < max_repeats
            yield pd.DataFrame({"shard": shard, "source_index": source, "block": block, "slot": slot})[ok]

    return run


class Mix:
    """One mix of ``docs`` (doc_id, text, source): its recipe, and which blocks it takes.

    Only the recipe, one row per source, is on the driver.  Sources are few by nature (each has a weight
    that somebody chose); documents, blocks and slots stay distributed.  The same rows give the same
    mix, whatever the partitions; rows that agree in doc_id and text are interchangeable.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                 block_words: int = 64, shard_slots: int = 4096, seed: int = SEED):
        spark = docs.sparkSession
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long")
        sized = stored(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"),
                                   F.monotonically_increasing_id().alias("row")))
        totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        self.targets = targets(totals, weights, max_repeats)
        names = list(self.targets)
        words = np.array([totals[name] for name in names], np.int64)
        blocks = -(-words // block_words)
        wanted = np.array([self.targets[n] * b / w if w else 0.0 for n, b, w in zip(names, blocks, words)])
        recipe = spark.createDataFrame(
            [(i, name, totals[name], self.targets[name]) for i, name in enumerate(names)],
            "source_index long, name string, source_size long, target double")
        rows = sized.join(recipe, sized["source"].eqNullSafe(recipe["name"])).drop("name")
        rows = stored(rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))))
        cells = rows.groupBy("source_index", "cell").agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("source_index").orderBy("cell")) - F.col("words")
        cells = stored(cells.select("source_index", "cell", before.alias("cell_start")))
        here = Window.partitionBy("source_index", "cell").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
        placed = rows.withColumn("end", F.sum("size").over(here)).join(cells, ["source_index", "cell"])
        nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("row"))
        self.docs = stored(placed.select("*", (F.col("cell_start") + F.col("end") - F.col("size")).alias("start")).withColumn("nth", nth))
        self.max_repeats, self.block_words = max_repeats, block_words

        slots = int(np.ceil(wanted.sum()))
        share = wanted / wanted.sum() if slots else wanted
        drawn = spark.range(-(-slots // shard_slots)).mapInPandas(
            _draw(share, slots, shard_slots, seed), "shard long, source_index long, n long")
        start = F.sum("n").over(Window.partitionBy("source_index").orderBy("shard")) - F.col("n")
        # A source with many slots is spread over tasks again before its slots are written out one by one.
        spread = drawn.withColumn("start", start).repartition(
            int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "source_index")
        self.slots = stored(spread.mapInPandas(
            _slots(blocks, max_repeats, seed), "shard long, source_index long, block long, slot long"))

    def pieces(self) -> DataFrame:
        """Per document and block of its source that it reaches into: the words ``low`` to ``high`` of the document."""
        block, first = F.col("block"), F.col("block") * self.block_words - F.col("start")
        blocks = F.expr(f"sequence(start div {self.block_words}, (start + size - 1) div {self.block_words})")
        return self.docs.where("size > 0").withColumn("block", F.explode(blocks)).select(
            "row", "doc_id", "text_hash", "nth", "source_index", block,
            F.greatest(first, F.lit(0)).alias("low"), F.least(first + self.block_words, F.col("size")).alias("high"))

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
        times = self.slots.groupBy("source_index", "block").agg(F.count(F.lit(1)).alias("times"))
        words = self.pieces().join(times, ["source_index", "block"]).groupBy("row").agg(
            F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
        return self.docs.join(words, "row", "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))

    def takes(self) -> DataFrame:
        """Per document that the mix uses: all its passages, as (shard, slot, low, high)."""
        return self.pieces().join(self.slots, ["source_index", "block"]).groupBy("doc_id", "text_hash", "nth").agg(
            F.sort_array(F.collect_list(F.struct("shard", "slot", "low", "high"))).alias("takes"))


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, chars_at: int) -> Iterator[pa.RecordBatch]:
    """Each passage of a row as a row of its own; the passages are the last column.

    Only the other columns are repeated for a row's passages, and what was cut is sent on
    before more than ``CUT_CHARS`` of it lie here.
    """
    word = re.compile(WORDS)
    for batch in batches:
        columns = batch.columns[:-1]
        rows, texts, chars = [], [], 0

        def passages() -> pa.RecordBatch:
            place = pa.array(rows, pa.int64())
            out = [pa.array(texts, pa.string()) if i == text_at else pa.array(map(len, texts), pa.int64()) if i == chars_at
                   else column.take(place) for i, column in enumerate(columns)]
            return pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

        for i, (text, takes) in enumerate(zip(batch.column(text_at), batch.column(batch.num_columns - 1))):
            text = text.as_py()
            # The starts and ends of the words, in turn.
            spans = array("q", (at for found in word.finditer(text) for at in found.span()))
            for take in takes.as_py():
                whole = take["low"] == 0 and 2 * take["high"] == len(spans)
                passage = text if whole else text[spans[2 * take["low"]]:spans[2 * take["high"] - 1]]
                rows.append(i)
                texts.append(passage)
                chars += len(passage)
                if chars >= CUT_CHARS:
                    yield passages()
                    rows, texts, chars = [], [], 0
        if rows:
            yield passages()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row per passage that a slot takes.

    ``text`` (and ``n_chars``, where it is there) are those of the passage; a document
    that lies within one block stays whole.  Documents that no slot takes, and those without a
    word, are not in the mix; a document of a small source comes up to ``max_repeats`` times.
    """
    takes = Mix(docs, **options).takes()
    takes = takes.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("nth").alias("__n"),
                         F.col("takes").alias("__takes"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("__h"))
    tagged = docs.withColumn("__h", F.xxhash64("text")).withColumn("__nth", nth)
    same = tagged["doc_id"].eqNullSafe(takes["__id"]) & (tagged["__h"] == takes["__hash"]) & (tagged["__nth"] == takes["__n"])
    found = tagged.join(takes, same).select(*docs.columns, "__takes")
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else -1
    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))
    return found.mapInArrow(lambda batches: _cut(batches, text_at, chars_at), schema).toDF(*docs.columns)
