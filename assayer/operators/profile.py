"""Structure and quality of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import quoted

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _comparable(field: T.StructField) -> Column:
    """Maps can be neither compared nor counted: use their JSON text. NaN is missing."""
    column = F.col(quoted(field.name))
    if _holds_map(field.dataType):
        return F.to_json(column)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def _holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_holds_map(f.dataType) for f in data_type.fields)
    return False


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.VariantType, T.BinaryType))


def _nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.StructType))


# Columns that share one scan; wider tables take one more scan for each further batch.
COLUMN_BATCH = 48


def distinct_counts(df: DataFrame, names: Sequence[str], *, rows: bool = False) -> DataFrame:
    """Exact number of distinct non-NULL values per column: rows of (name, n); of whole rows as name "" with ``rows``.

    A row becomes one (column, 128-bit digest of the typed value) cell for each column, and equal cells are combined before the one
    shuffle; scans and exchanges do not grow with the columns, but by batches of ``COLUMN_BATCH``.
    """
    fields = {f.name: f for f in df.schema.fields}
    digests = [_value_digest(fields[n]) for n in names] + ([row_digest(df)] if rows else [])
    cells = [F.struct(F.lit(i).alias("place"), a.alias("d0"), b.alias("d1")) for i, (a, b) in enumerate(digests)]
    shown = F.array(*[F.lit(n) for n in (*names, "")])
    parts = []
    for start in range(0, len(cells), COLUMN_BATCH):
        exploded = df.select(F.inline(F.array(*cells[start:start + COLUMN_BATCH]))).where("d0 IS NOT NULL")
        parts.append(exploded.distinct().groupBy("place").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionAll, parts).select(F.get(shown, "place").alias("name"), "n")


def _value_digest(field: T.StructField) -> list[Column]:
    """Two differently seeded hashes of a value, NULL for a missing one."""
    column = _comparable(field)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        column = column + F.lit(0.0)  # -0.0 and 0.0 are one value
    if isinstance(field.dataType, T.VariantType) or (_nested(field.dataType) and not _holds_map(field.dataType)):
        column = F.to_json(column)
    return [F.when(column.isNotNull(), F.xxhash64(F.lit(seed), column)) for seed in (1, 2)]


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row, so rows are compared without moving them.

    Two differently seeded hashes over all values and, since hashing skips
    NULLs, over the places of the NULLs.
    """
    fields = df.schema.fields
    values = [F.to_json(F.col(quoted(f.name))) if _nested(f.dataType) else _comparable(f) for f in fields]
    places = []
    for start in range(0, len(fields), 60):
        missing = [
            f"if({_missing_sql(f)}, {1 << i}L, 0L)" for i, f in enumerate(fields[start : start + 60])
        ]
        places.append(F.expr(" | ".join(missing)))
    return [F.xxhash64(F.lit(seed), *places, *values).alias(f"digest_{seed}") for seed in (1, 2)]


def _missing_sql(field: T.StructField) -> str:
    column = quoted(field.name)
    fractional = isinstance(field.dataType, (T.FloatType, T.DoubleType))
    return f"{column} IS NULL OR isnan({column})" if fractional else f"{column} IS NULL"


def profile_table(
    df: DataFrame,
    source_id: str,
    *,
    expected_fields: Sequence[str] = (),
    primary_key: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """One row per column, with the table's own counts repeated on each row.

    Counts, NULLs and bounds come from one pass without a shuffle of rows.
    Distinct values and duplicate rows are counted by digest in one more (:func:`distinct_counts`).  ``approx=True`` replaces both by mergeable sketches in
    that same pass, for tables too wide or large for exact distinct counts.
    """
    fields = df.schema.fields
    columns = [_comparable(f) for f in fields]
    names = {f.name for f in fields}
    keyed = bool(primary_key) and set(primary_key) <= names
    aggregates = [F.count("*").alias("n")]
    if approx:
        aggregates.append(F.approx_count_distinct(row_digest(df)[0]).alias("rows_d"))
    for i, (f, c) in enumerate(zip(fields, columns)):
        aggregates.append(F.count_if(c.isNull()).alias(f"null_{i}"))
        if approx:
            aggregates.append(F.approx_count_distinct(c).alias(f"dist_{i}"))
        if _orderable(f.dataType):
            aggregates += [F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}")]
    totals = df.agg(*aggregates)
    if not approx:
        totals = _with_counts(totals, distinct_counts(df, [f.name for f in fields], rows=True), fields)
    if keyed:
        extra = check_primary_key(df, primary_key).select("duplicate_count").scalar()
    else:
        extra = F.lit(None).cast("long")
    return _long_profile(totals, fields, source_id, expected_fields).withColumn("primary_key_duplicate_count", extra)


def _with_counts(totals: DataFrame, counts: DataFrame, fields) -> DataFrame:
    """Attach the few (name, n) rows as columns."""
    lookup = counts.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("m")).scalar()
    held = totals.withColumn("counts", lookup)

    def of(name: str) -> Column:
        return F.coalesce(F.try_element_at("counts", F.lit(name)), F.lit(0))

    return held.withColumns({"rows_d": of(""), **{f"dist_{i}": of(f.name) for i, f in enumerate(fields)}})


def _long_profile(totals: DataFrame, fields, source_id: str, expected_fields) -> DataFrame:
    def bound(kind: str, i: int, f: T.StructField, number: bool) -> Column:
        target = "double" if number else "string"
        if not _orderable(f.dataType) or isinstance(f.dataType, _NUMBERS) != number:
            return F.lit(None).cast(target)
        column = F.col(f"{kind}_{i}")
        return F.to_json(column) if _nested(f.dataType) and not _holds_map(f.dataType) else column.cast(target)

    entries = [
        F.struct(
            F.lit(i).alias("column_index"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"null_{i}").alias("null_count"),
            F.coalesce(F.try_divide(F.col(f"null_{i}"), F.col("n")), F.lit(0.0)).alias("null_ratio"),
            F.col(f"dist_{i}").alias("distinct_count"),
            bound("min", i, f, True).alias("min_num"),
            bound("max", i, f, True).alias("max_num"),
            bound("min", i, f, False).alias("min_text"),
            bound("max", i, f, False).alias("max_text"),
        )
        for i, f in enumerate(fields)
    ]
    names = {f.name for f in fields}
    missing = F.array(*[F.lit(n) for n in expected_fields if n not in names]).cast("array<string>")
    return totals.select(
        F.lit(source_id).alias("source_id"),
        F.col("n").alias("row_count"),
        F.lit(len(fields)).alias("column_count"),
        F.greatest(F.col("n") - F.col("rows_d"), F.lit(0)).alias("duplicate_row_count"),
        missing.alias("missing_expected_fields"),
        F.inline(F.array(*entries)),
    )


def check_primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond one per key tuple; NULL when a key column is missing.

    NULL is a key value.  Grouping combines on the map side, so a hot key costs
    one row per task.
    """
    rows = F.count("*").alias("row_count")
    if not keys or not set(keys) <= set(df.columns):
        return df.agg(rows).withColumn("duplicate_count", F.lit(None).cast("long"))
    fields = {f.name: f for f in df.schema.fields}
    parts = [_comparable(fields[name]).alias(f"k{i}") for i, name in enumerate(keys)]
    return (
        df.groupBy(*parts)
        .agg(F.count("*").alias("c"))
        .agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_count"),
        )
    )
