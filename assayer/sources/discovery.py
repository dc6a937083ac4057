"""Inventory of the files below a folder, and stable ids for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import DOCUMENT_FORMATS, TABLE_FORMATS

# Fixed value: folders that are never looked into.
EXCLUDED_FOLDER = "private"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of every file; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def relative_path(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root`` (any scheme prefix is ignored)."""
    bare = root.split(":", 1)[-1].strip("/")
    return F.regexp_replace(F.split_part(path, F.lit(f"/{bare}/"), F.lit(2)), "^/+", "")


def source_stem(relative: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(relative, "/"), -1), r"\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), r"^[_.-]+|[_.-]+$", "")
    return F.when(safe == "", "source").otherwise(F.lower(safe))


def discover_files(
    files: DataFrame, root: str, *, tables: bool = True, origin: str = "data"
) -> DataFrame:
    """Supported files with type, format and a unique id made from the file name.

    The first path of a name keeps it; later ones get ten hex digits of their
    path's hash.  The first path is a map-side combined minimum, so thousands of
    equal names need no sort of one group.
    """
    known = {**({k: ("table", v) for k, v in TABLE_FORMATS.items()} if tables else {}),
             **{k: ("document", v) for k, v in DOCUMENT_FORMATS.items()}}
    kinds = F.create_map(*[F.lit(x) for k, (t, _) in known.items() for x in (k, t)])
    formats = F.create_map(*[F.lit(x) for k, (_, f) in known.items() for x in (k, f)])
    relative = relative_path(F.col("path"), root)
    folders = F.split(F.lower("relative_path"), "/")
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    listed = (
        files.withColumn("relative_path", relative)
        .withColumn("__ext", suffix)
        .where(~F.array_contains(folders, EXCLUDED_FOLDER))
        .withColumn("source_type", F.try_element_at(kinds, F.col("__ext")))
        .where("source_type IS NOT NULL")
        .withColumn("file_format", F.try_element_at(formats, F.col("__ext")))
        .withColumn("__stem", source_stem(F.col("relative_path")))
    )
    firsts = listed.groupBy("__stem").agg(F.min("relative_path").alias("__first"))
    digest = F.substring(F.sha2("relative_path", 256), 1, 10)
    return (
        listed.join(firsts, "__stem")
        .select(
            F.when(F.col("relative_path") == F.col("__first"), F.col("__stem"))
            .otherwise(F.concat_ws("_", "__stem", digest))
            .alias("source_id"),
            "source_type",
            "file_format",
            "relative_path",
            F.col("length").alias("size_bytes"),
            "modificationTime",
            "path",
            F.lit(origin).alias("origin"),
        )
    )


def new_files(current: DataFrame, known: DataFrame) -> DataFrame:
    return current.join(known.select("path"), "path", "left_anti")
