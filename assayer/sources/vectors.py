"""A written vector table that follows its documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import chunk_documents, chunk_id, detect_changed_documents, removed_documents
from ..operators.retrieval import Embedder, embed, latest_vectors
from ..scale import freeze, join_on
from .versions import Conflict, Versions

DEFAULT_BUCKETS = 64
ATTEMPTS = 5


@dataclass
class Reindexed:
    """What one pass over the documents did."""

    changed_documents: int
    removed_documents: int
    rewritten_buckets: int
    generation: int


class ChunkIndex:
    """Chunks with their vectors, in buckets by document, below one folder.

    ``reindex`` compares the documents as they are with those that were indexed, chunks and embeds only the new and
    changed ones, and rewrites only the buckets that hold such or removed documents (merge by bucket); all
    other buckets keep their files.  ``upsert`` merges ready rows by chunk id.  Each change is published as
    a whole (see :class:`~assayer.sources.versions.Versions`), so readers see the state before or after it, and
    a writer that another one overtook starts over.

    ``buckets`` and the type of the document key are fixed when the folder is first written; a later instance reads them from there.
    """

    def __init__(self, spark: SparkSession, root: str, *, key: str = "doc_id", buckets: int = DEFAULT_BUCKETS):
        self.spark, self.key, self.versions = spark, key, Versions(spark, root)
        self._default_buckets = buckets

    def read(self) -> DataFrame:
        """The current rows: key, chunk_index, start_char, end_char, text, chunk_id, embedding, generation."""
        _, state = self.versions.current()
        if not state:
            raise ValueError(f"nothing is indexed below {self.versions.root}")
        return self._rows(state, state["folders"])

    def documents(self) -> DataFrame:
        """Key and digest of every indexed document."""
        _, state = self.versions.current()
        if not state:
            raise ValueError(f"nothing is indexed below {self.versions.root}")
        return self.spark.read.schema(state["documents_schema"]).parquet(self.versions.path(state["documents"]))

    def _rows(self, state: dict, buckets) -> DataFrame:
        paths = [self.versions.path(state["folders"][b]) for b in buckets if b in state["folders"]]
        if not paths:
            return self.spark.createDataFrame([], state["schema"])
        return self.spark.read.schema(state["schema"]).parquet(*paths)

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets))

    def reindex(
        self,
        documents: DataFrame,
        make_embedder: Callable[[], Embedder],
        *,
        text: str = "text",
        size: int = 1200,
        overlap: int = 200,
    ) -> Reindexed:
        """Bring the index up to ``documents`` (key and text; a NULL text has no chunks).

        A document is changed when the SHA-256 of its text is; keys must be unique and not NULL.
        """
        bodies = documents.select(F.col(self.key), F.col(text).alias("text")).where(F.col(self.key).isNotNull())
        now = freeze(bodies.select(self.key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))
        if not now.groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError(f"{self.key} must be unique")
        for _ in range(ATTEMPTS):
            try:
                return self._reindex(bodies, now, make_embedder, size, overlap)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts to publish below {self.versions.root} were overtaken")

    def _reindex(self, bodies, now, make_embedder, size, overlap) -> Reindexed:
        number, state = self.versions.current()
        buckets = state.get("buckets", self._default_buckets)
        if state:
            known = self.spark.read.schema(state["documents_schema"]).parquet(self.versions.path(state["documents"]))
            self._check_key(now, state)
        else:
            known = now.where("false")
        changed = freeze(detect_changed_documents(now, known, (self.key, "digest")).select(self.key))
        removed = freeze(removed_documents(now, known, self.key).select(self.key))
        affected = changed.unionAll(removed)
        touched = sorted(str(r[0]) for r in affected.select(self._bucket(buckets)).distinct().collect())  # at most one per bucket
        chunks = chunk_documents(join_on(bodies, changed, [self.key], "left_semi"), self.key, size=size, overlap=overlap)
        vectors = embed(chunks.withColumn("chunk_id", chunk_id(F.col(self.key))), "text", make_embedder)
        fresh = vectors.withColumn("generation", F.lit(number + 1).cast("long"))
        written = self._written(state, touched, fresh, lambda old: join_on(old, affected, [self.key], "left_anti"), buckets)
        place = self.versions.folder()
        now.write.parquet(self.versions.path(place))
        self.versions.publish(number, written | {"documents": place, "documents_schema": _ddl(now)})
        return Reindexed(changed.count(), removed.count(), len(touched), number + 1)

    def _check_key(self, now: DataFrame, state: dict) -> None:
        if _ddl(now) != state["documents_schema"]:
            raise ValueError(f"the index holds {state['documents_schema']}, not {_ddl(now)}")

    def _written(self, state: dict, touched: list[str], fresh: DataFrame, remaining, buckets: int) -> dict:
        """Write the touched buckets anew; the state that has them in place of the old ones."""
        if state:
            fresh = remaining(self._rows(state, touched)).unionByName(fresh)
        folder = self.versions.folder()
        dealt = fresh.withColumn("bucket", self._bucket(buckets)).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(self.versions.path(folder))
        folders = {b: f for b, f in state.get("folders", {}).items() if b not in touched}
        folders |= {b: f"{folder}/bucket={b}" for b in touched if self.versions.exists(f"{folder}/bucket={b}")}
        return {**state, "buckets": buckets, "folders": folders, "schema": _ddl(fresh)}

    def upsert(self, rows: DataFrame) -> int:
        """Merge ready rows (columns of :meth:`read` without generation) by chunk id; returns the new generation."""
        rows = freeze(rows)
        for _ in range(ATTEMPTS):
            number, state = self.versions.current()
            buckets = state.get("buckets", self._default_buckets)
            touched = sorted(str(r[0]) for r in rows.select(self._bucket(buckets)).distinct().collect())
            fresh = latest_vectors(rows.withColumn("generation", F.lit(number + 1).cast("long")), "chunk_id", "generation")
            keep = lambda old: join_on(old, rows.select("chunk_id"), ["chunk_id"], "left_anti")
            written = self._written(state, touched, fresh, keep, buckets)
            if not state:
                none = rows.select(self.key, F.lit("").alias("digest")).where("false")
                place = self.versions.folder()
                none.write.parquet(self.versions.path(place))
                written |= {"documents": place, "documents_schema": _ddl(none)}
            try:
                return self.versions.publish(number, written)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts to publish below {self.versions.root} were overtaken")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
