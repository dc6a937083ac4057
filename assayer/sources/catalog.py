"""Registering configured sources with a session."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import chunk_documents, chunk_id, document_errors, usable_documents
from ..operators.profile import profile_table
from ..operators.retrieval import Embedder, embed
from ..scale import union_all
from ..specs import ConnectionSpec, SourceSpec, unique_sources
from .readers import read_documents, read_table


def register_table(
    df: DataFrame, name: str, *, materialize: bool = False, append: bool = False
) -> str:
    """Make a table usable by name: a lazy view, or a stored table.

    ``append`` adds a batch to a stored table.
    """
    if append:
        df.write.mode("append").saveAsTable(name)
    elif materialize:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return name


def query_table(spark: SparkSession, sql: str, parameters: dict | list | None = None) -> DataFrame:
    """Parametrised SQL over the registered names."""
    return spark.sql(sql, args=parameters) if parameters else spark.sql(sql)


@dataclass
class Ingested:
    tables: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    profiles: DataFrame | None = None
    chunks: DataFrame | None = None
    document_errors: DataFrame | None = None
    errors: dict[str, str] = field(default_factory=dict)


def ingest_catalog(
    spark: SparkSession,
    sources: Iterable[SourceSpec],
    *,
    connections: Mapping[str, ConnectionSpec] | None = None,
    selected: str | None = None,
    make_embedder: Callable[[], Embedder] | None = None,
    chunk_size: int = 1200,
    chunk_overlap: int = 200,
    approx_profiles: bool = False,
) -> Ingested:
    """Register and profile every enabled table, chunk and embed every document.

    The loop is over sources.  A source that cannot be read is recorded and skipped; a document that cannot be read is a
    row of ``document_errors``, and the others of its source go on.  Chunks keep their document's metadata.
    """
    result = Ingested()
    profiles, chunks, failed = [], [], []
    for source in unique_sources(sources):
        if not source.enabled:
            continue
        if source.source_type == "document" and make_embedder is None:
            raise ValueError(f"document source {source.source_id} needs an embedder")
        try:
            if source.source_type == "table":
                df = read_table(spark, source, connections=connections, selected=selected)
                result.tables[source.source_id] = register_table(df, source.view_name)
                result.frames[source.source_id] = df
                profiles.append(
                    profile_table(
                        df,
                        source.source_id,
                        expected_fields=source.expected_fields,
                        primary_key=source.primary_key,
                        approx=approx_profiles,
                    )
                )
            else:
                # Read, decoded and written once: what can't be read at run time is a row here.
                documents = read_documents(spark, source)
                failed.append(document_errors(documents, "path").select(F.lit(source.source_id).alias("source_id"), "path", "error"))
                # The key carries id, path and metadata; all travel with the chunk.
                keyed = usable_documents(documents).withColumn("document", F.to_json(F.struct("source_id", "path", "metadata")))
                parts = chunk_documents(keyed, "document", size=chunk_size, overlap=chunk_overlap)
                described = F.from_json("document", "source_id string, path string, metadata map<string,string>")
                identified = parts.withColumn("d", described).select(
                    "d.source_id", "d.path", *[c for c in parts.columns if c != "document"], "d.metadata",
                ).withColumn("chunk_id", chunk_id(F.concat_ws(":", "source_id", "path")))
                chunks.append(embed(identified, "text", make_embedder))
        except Exception as error:  # noqa: BLE001 - one bad source must not stop the rest
            result.errors[source.source_id] = f"{type(error).__name__}: {error}"
    result.profiles = union_all(profiles)
    result.chunks = union_all(chunks)
    result.document_errors = union_all(failed)
    return result
