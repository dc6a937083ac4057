"""Quality rules per document, and a verdict on whole hosts.

Every document is measured by fixed rules.  Failures are summed by host (column
``source``), the rates are shrunk towards a beta prior fitted to all hosts, and a
host whose shrunk rate is too high loses its documents that passed, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> tuple:
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space only
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed


def _append_measures(position: int, drop: bool):
    kinds = [pa.int64()] * 5 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text.as_py()) for text in batch.column(position)]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * 6, kinds, strict=True)]
            before = [c for i, c in enumerate(batch.columns) if not (drop and i == position)]
            yield pa.RecordBatch.from_arrays([*before, *columns], names=[f"c{i}" for i in range(len(before) + 6)])

    return run


def measured(docs: DataFrame, drop_text: bool = True) -> DataFrame:
    """The columns of ``docs``, and what the rules measure in every row's whole text.

    The new columns are called ``__`` and the name of the measure.
    """
    names = [c for c in docs.columns if not (drop_text and c == "text")]
    kinds = dict(docs.dtypes)
    new = [part.split() for part in MEASURES.split(", ")]
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate([kinds[c] for c in names] + [kind for _, kind in new]))
    rows = docs.mapInArrow(_append_measures(docs.columns.index("text"), drop_text), schema)
    return rows.toDF(*names, *["__" + name for name, _ in new])


def host_rates(rows: DataFrame) -> DataFrame:
    """Per source: documents, failures, and the failure rate shrunk to the beta prior.

    The prior's mean and variance are those of the hosts' own rates (method of
    moments).  Hosts that all agree give a prior so heavy that every rate is the mean; rates spread
    as widely as 0 and 1 allow give no prior at all.
    """
    hosts = stored(rows.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("__base_failed").alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"))
    mean, spread = moments.select("mean").scalar(), moments.select("spread").scalar()
    room = mean * (1 - mean)
    weight = F.when(spread * 1e6 <= room, F.lit(1e6)).otherwise(room / spread - 1)
    weight = F.when(room <= 0, F.lit(0.0)).otherwise(weight)
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def _rejected(rows: DataFrame, max_host_rate: float) -> DataFrame:
    return stored(host_rates(rows).where(F.col("shrunk_rate") >= max_host_rate).select(
        F.col("source").alias("__host"), F.lit(True).alias("__host_rejected")))


def judge_quality(docs: DataFrame, max_host_rate: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, the measures, base_failed, kept.

    NULL text is an empty text and fails.  Rows without a source belong to no host: their own
    measures decide.  Repeated rows are judged each; other columns are ignored.
    """
    rows = stored(measured(docs.select("doc_id", "source", "text")))
    rejected = _rejected(rows, max_host_rate)
    judged = rows.join(rejected, rows["source"] == rejected["__host"], "left")
    kept = ~F.col("__base_failed") & F.col("__host_rejected").isNull()
    return judged.select("doc_id", *[F.col("__" + part.split()[0]).alias(part.split()[0]) for part in MEASURES.split(", ")],
                         kept.alias("kept"))


def keep_good(docs: DataFrame, max_host_rate: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns.

    Texts are measured a second time instead of being moved or copied: each row
    carries its own verdict, and the rejected hosts are anti-joined (Spark copies that stored
    table to the executors only below its own threshold).
    """
    rejected = _rejected(stored(measured(docs.select("source", "text"))), max_host_rate)
    passed = measured(docs, drop_text=False).where("NOT __base_failed").select(*docs.columns)
    return passed.join(rejected, passed["source"] == rejected["__host"], "left_anti")
