"""Exact deduplication against a persistent index of digests.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text with
all ASCII white space deleted.  A new batch is reduced to one row per digest,
meets the index in a sort-merge anti-join that moves only the batch (the index
already lies in its buckets), and what is new is appended.  ``add`` moves digests and ids, no texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import stored
from ..sources.versions import Conflict, Versions

SPACES = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without ASCII white space; NULL counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, ""), 256))


class DigestIndex:
    """Digests of all texts seen so far, in a folder that outlives the session.

    ``path`` must be in storage that all executors share.  ``buckets`` and ``id_type`` are fixed when
    the folder is first written and kept beside the data: reopened with another number of buckets, the index keeps its
    own; with another type of ids it raises.  About one bucket per GB of digests (10^7 texts) keeps a
    merge task small.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        layout = self._layout(Versions(spark, path), {"buckets": buckets, "id_type": id_type})
        if layout["id_type"] != id_type:
            raise ValueError(f"the index below {path} has ids of type {layout['id_type']}, not {id_type}")
        buckets = layout["buckets"]
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, keep_row BIGINT, group_size BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @staticmethod
    def _layout(versions: Versions, wanted: dict) -> dict:
        """What the folder was first written with; ``wanted`` where it is new."""
        number, layout = versions.current()
        if number:
            return layout
        try:
            versions.publish(0, wanted)
            return wanted
        except Conflict:
            return versions.current()[1]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """Deduplicate ``docs`` (doc_id, text) against the index and append what is new.

        Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept,
        text_sha256, n_chars.  Of equal texts in one batch the row with the most code points,
        then the smallest doc_id stays; of rows that agree in both, one.  A text that an
        earlier batch brought is not kept, and its keep_id is the row kept then;
        group_size counts the batch that brought the text and this one.  Adding the same batch
        again changes nothing and gives the same answer.  Other columns are ignored;
        NULL and empty texts are one group; no rows give no rows.
        """
        prints = stored(docs.select(
            F.col("doc_id"),
            digest(F.col("text")).alias("digest"),
            F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
        ))
        best = prints.groupBy("digest").agg(
            F.min(F.struct(-F.col("n_chars"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")
        )
        index = self.rows()
        earlier = index.where(F.col("batch") != batch).hint("merge")
        new = best.join(earlier, "digest", "left_anti").select(
            "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"),
            F.col("n").alias("group_size"), F.lit(batch).alias("batch"),
        )
        known = best.join(earlier, "digest").select(
            "digest", "keep_id", F.lit(None).cast("long").alias("keep_row"),
            (F.col("group_size") + F.col("n")).alias("group_size"), "batch",
        )
        facts = stored(new.unionByName(known))
        again = index.where(F.col("batch") == batch).select("digest").hint("merge")
        fresh = facts.where(F.col("batch") == batch).join(again, "digest", "left_anti")
        (fresh.select(*index.columns).repartition(self.buckets, "digest")
              .sortWithinPartitions("digest").write.insertInto(self.name))
        return prints.join(facts, "digest").select(
            "doc_id", "keep_id", "group_size", "n_chars",
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def keep_first_copies(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that ``DigestIndex.add`` keeps, with all their columns.

    Of rows that agree in doc_id, text without white space and length, one stays.
    """
    kept = index.add(docs, batch).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("n_chars").alias("__n"), F.unhex("text_sha256").alias("__kept"))
    tagged = docs.withColumn("__digest", digest(docs["text"]))
    chars = F.char_length(F.coalesce(docs["text"], F.lit("")))
    same = (docs["doc_id"].eqNullSafe(kept["__id"])) & (tagged["__digest"] == kept["__kept"]) & (chars == kept["__n"])
    return tagged.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__digest"]).select(*docs.columns)
