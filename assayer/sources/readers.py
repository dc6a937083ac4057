"""Table and document readers."""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.values import nan_to_null
from ..operators.documents import extract_html_text, parts, texts_or_errors, tidy_text
from ..scale import join_on, scratch_path, stored
from ..specs import ConnectionSpec, SourceSpec
from .batches import FileBatches

# File extensions and what they hold.
TABLE_FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json"}
DOCUMENT_FORMATS = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html",
    "c": "source_code", "cc": "source_code", "cpp": "source_code", "h": "source_code",
    "hh": "source_code", "hpp": "source_code", "java": "source_code",
}
DEFAULT_FETCH_ROWS = 10_000


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def infer_format(spec: SourceSpec) -> str:
    """The configured format, else the one its extension stands for."""
    if spec.format != "auto":
        return spec.format.lower()
    known = TABLE_FORMATS if spec.source_type == "table" else DOCUMENT_FORMATS
    try:
        return known[extension(spec.location)]
    except KeyError:
        raise ValueError(f"unsupported extension: {spec.location}") from None


def charset(encoding: str) -> str:
    """Java name of a Python encoding name.

    Spark reads UTF-8/16/32, US-ASCII and ISO-8859-1; other names are passed on
    and need ``spark.sql.legacy.javaCharsets`` in the session.
    """
    name = codecs.lookup(encoding).name
    known = {"ascii": "us-ascii", "iso8859-1": "iso-8859-1"}
    return known.get(name, name.replace("_", "-") if name.startswith("utf") else name.replace("cp125", "windows-125"))


def _shape(df: DataFrame, columns: Sequence[str] | None, limit: int | None) -> DataFrame:
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    return nan_to_null(df if limit is None else df.limit(limit))


def scan_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: str | None = None,
    encoding: str = "utf-8",
    options: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """CSV with a header. A schema saves the extra pass that inference takes."""
    reader = spark.read.options(header=True, encoding=charset(encoding), **dict(options or {}))
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return _shape(reader.csv(path), columns, limit)


def scan_parquet(
    spark: SparkSession,
    path: str,
    *,
    options: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    return _shape(spark.read.options(**dict(options or {})).parquet(path), columns, limit)


def scan_json(
    spark: SparkSession,
    path: str,
    *,
    document: bool = False,
    schema: str | None = None,
    encoding: str = "utf-8",
    options: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """JSON lines (splittable), or with ``document=True`` one JSON value per file."""
    reader = spark.read.options(encoding=charset(encoding), multiLine=document, **dict(options or {}))
    if schema:
        reader = reader.schema(schema)
    return _shape(reader.json(path), columns, limit)


def jdbc_options(
    spec: SourceSpec,
    connections: Mapping[str, ConnectionSpec],
    *,
    selected: str | None = None,
    fetch_rows: int = DEFAULT_FETCH_ROWS,
    limit: int | None = None,
    partition: tuple[str, int, int, int] | None = None,
    environment: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a read-only JDBC scan of a registered replica.

    ``partition`` = (column, lower, upper, partitions) reads in parallel ranges;
    without it a JDBC scan is one task.
    """
    if not 100 <= fetch_rows <= 1_000_000:
        raise ValueError("fetch_rows must lie in 100..1000000")
    alias = selected if spec.connection == "$selected" else spec.connection
    if not alias or alias not in connections:
        raise ValueError(f"unknown database replica: {alias}")
    link = connections[alias]
    password = (os.environ if environment is None else environment).get(link.password_env)
    if not password:
        raise RuntimeError(f"password variable {link.password_env} is not set")
    options = {
        "url": f"jdbc:postgresql://{link.host}:{link.port}/{link.database}",
        "driver": "org.postgresql.Driver",
        "user": link.user,
        "password": password,
        "sslmode": link.sslmode,
        "connectTimeout": str(link.connect_timeout_seconds),
        "fetchsize": str(fetch_rows),
        "sessionInitStatement": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY",
        "ApplicationName": "assayer",
    }
    relation = f"({spec.query.strip().rstrip(';')}) AS source" if spec.query else spec.location
    if limit is not None:
        relation = f"(SELECT * FROM {relation} LIMIT {int(limit)}) AS bounded"
    options["dbtable"] = relation
    if partition is not None:
        column, lower, upper, count = partition
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(count),
        }
    return options


def scan_jdbc(spark: SparkSession, spec: SourceSpec, connections: Mapping[str, ConnectionSpec], **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(spec, connections, **kwargs)).load()


def decoded(content: Column, encoding: str) -> Column:
    """Struct of ``text`` and ``error``: bytes that are not in the encoding give an error, not a failed job."""
    name = codecs.lookup(encoding).name

    @F.arrow_udf("text string, error string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts(batch):
                rows = []
                for body in part.to_pylist():
                    try:
                        text = None if body is None else body.decode(name).removeprefix("\ufeff")
                        rows.append((text, None if body is not None else "TypeError: no content"))
                    except UnicodeError as error:
                        rows.append((None, f"{type(error).__name__}: {error}"))
                yield texts_or_errors(rows)

    return decode(content)


def scan_documents(
    spark: SparkSession, path: str, *, document_format: str = "text", encoding: str = "utf-8"
) -> DataFrame:
    """Whole files: ``path``, ``length``, ``modificationTime``, ``text``, ``error``.

    Every file has a row, but for empty ones, which the file source leaves out.  One whose bytes are not in the encoding, whose page can't be parsed, or that vanished
    or could not be read to its end keeps NULL as text and says why in ``error``.  The files are listed and read
    once, here, a batch at a time, so the driver never holds the states of all; what was read is written down, and later steps read that.
    """
    files, target = FileBatches(spark, path), scratch_path(spark)
    for number, batch in enumerate(files):
        schema = _read_batch(files, batch, f"{target}/{number}", document_format, encoding)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(target)


def _read_batch(files: FileBatches, batch: list[str], target: str, document_format: str, encoding: str) -> StructType:
    """Write the rows of a batch: what was read, and then what was listed and not read."""
    state = ["path", "length", "modificationTime"]
    listed = stored(files.load(batch, ignoreMissingFiles=True).select(*state))
    bodies = files.load(batch, ignoreCorruptFiles=True, ignoreMissingFiles=True)
    texts = bodies.select(*state, decoded(F.col("content"), encoding).alias("d")).select(
        *state, F.col("d.text").alias("html"), F.col("d.error").alias("undecoded"))
    if document_format == "html":
        texts = extract_html_text(texts)
    else:
        texts = texts.select(*state, "undecoded", tidy_text(F.col("html")).alias("text"), F.lit(None).cast("string").alias("error"))
    texts = texts.select(*state, F.when(F.col("undecoded").isNull(), F.col("text")).alias("text"),
                         F.coalesce("undecoded", "error").alias("error"))
    texts.write.parquet(f"{target}/read")
    read = files.spark.read.schema(texts.schema).parquet(f"{target}/read")
    lost = join_on(listed, read.select("path"), ["path"], "left_anti").select(
        *state, F.lit(None).cast("string").alias("text"), F.lit("OSError: the file could not be read").alias("error"))
    lost.write.parquet(f"{target}/lost")
    return read.schema


def read_table(
    spark: SparkSession,
    spec: SourceSpec,
    *,
    connections: Mapping[str, ConnectionSpec] | None = None,
    selected: str | None = None,
    limit: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read any configured table source."""
    if spec.source_type != "table":
        raise ValueError(f"{spec.source_id} is not a table")
    if spec.is_database:
        df = scan_jdbc(spark, spec, connections or {}, selected=selected, limit=limit)
        return _shape(df, columns, None)
    options = {k: v for k, v in spec.options.items() if k != "document"}
    kind = infer_format(spec)
    if kind == "csv":
        return scan_csv(
            spark, spec.location, schema=spec.schema, encoding=spec.encoding, options=options, columns=columns, limit=limit
        )
    if kind == "parquet":
        return scan_parquet(spark, spec.location, options=options, columns=columns, limit=limit)
    if kind == "json":
        return scan_json(
            spark, spec.location, schema=spec.schema, encoding=spec.encoding, options=options, columns=columns,
            limit=limit, document=bool(spec.options.get("document", False)),
        )
    raise ValueError(f"unsupported table format: {kind}")


def read_documents(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Documents of one source with its id and metadata, ready for chunking."""
    if spec.source_type != "document":
        raise ValueError(f"{spec.source_id} is not a document source")
    metadata = {**{k: str(v) for k, v in spec.metadata.items()}, "format": infer_format(spec)}
    literal = F.create_map(*[F.lit(x) for pair in metadata.items() for x in pair])
    docs = scan_documents(spark, spec.location, document_format=infer_format(spec), encoding=spec.encoding)
    return docs.withColumns(
        {
            "source_id": F.lit(spec.source_id),
            "metadata": F.map_concat(F.map_filter(literal, lambda k, _: k != "location"), F.create_map(F.lit("location"), F.col("path"))),
        }
    )
