"""Run events and the masking of secrets in them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key parts that mark a secret, the mask, and the mark of a cut text.
SENSITIVE_PARTS = ("password", "secret", "token", "api_key", "authorization")
MASK = "***REDACTED***"
CUT = "…[truncated]"

EVENT_SCHEMA = "timestamp timestamp, level string, run_id string, event string, details string"


def is_sensitive(key: Column, parts=SENSITIVE_PARTS) -> Column:
    name = F.lower(key)
    result = F.lit(False)
    for part in parts:
        result = result | F.contains(name, F.lit(part))
    return result


def bounded_text(column: Column, max_text: int | None) -> Column:
    if max_text is None:
        return column
    return F.when(F.length(column) > max_text, F.concat(F.left(column, F.lit(max_text)), F.lit(CUT))).otherwise(column)


def redact_value(column: Column, data_type: T.DataType, parts=SENSITIVE_PARTS, max_text: int | None = None) -> Column:
    """Mask secrets anywhere below a typed value, following its schema.

    Texts stay whole unless the caller bounds them with ``max_text``.
    """
    if isinstance(data_type, T.StringType):
        return bounded_text(column, max_text)
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda v: redact_value(v, data_type.elementType, parts, max_text))
    if isinstance(data_type, T.MapType):
        masked = isinstance(data_type.valueType, T.StringType)

        def entry(key: Column, value: Column) -> Column:
            hidden = F.lit(MASK) if masked else F.lit(None).cast(data_type.valueType)
            return F.when(is_sensitive(key, parts), hidden).otherwise(
                redact_value(value, data_type.valueType, parts, max_text)
            )

        return F.transform_values(column, entry)
    if isinstance(data_type, T.StructType):
        fields = [
            (
                F.lit(MASK)
                if any(part in f.name.lower() for part in parts)
                else redact_value(column[f.name], f.dataType, parts, max_text)
            ).alias(f.name)
            for f in data_type.fields
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def redact_events(events: DataFrame, columns, parts=SENSITIVE_PARTS, max_text: int | None = None) -> DataFrame:
    """Mask the given typed columns; a stateless projection, batch or streaming."""
    types = {f.name: f.dataType for f in events.schema.fields}
    return events.withColumns({c: redact_value(F.col(c), types[c], parts, max_text) for c in columns})


def _hide(text: str, parts=SENSITIVE_PARTS) -> str:
    """JSON text with its secrets masked while the objects are parsed, innermost first."""
    secret = re.compile("|".join(map(re.escape, parts)), re.I)
    hidden = json.loads(text, object_pairs_hook=lambda pairs: {k: MASK if secret.search(k) else v for k, v in pairs})
    return json.dumps(hidden, ensure_ascii=False, separators=(",", ":"))


def redact_json(column: Column, parts=SENSITIVE_PARTS) -> Column:
    """The same for JSON text of unknown shape, in Arrow batches."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: _hide(text, parts), na_action="ignore")

    return mask(column)


def run_events(spark: SparkSession, run_id: str, records) -> DataFrame:
    """Event rows from (time, level, event, details) tuples, details masked."""
    rows = [
        (time, level.upper(), run_id, event, _hide(json.dumps(details, ensure_ascii=False, default=str)))
        for time, level, event, details in records
    ]
    return spark.createDataFrame(rows, EVENT_SCHEMA)
