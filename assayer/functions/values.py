"""Value normalisation, canonical JSON, time differences and text templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import formatted

_FRACTIONAL = (T.FloatType, T.DoubleType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalized_sql(name: str, data_type: T.DataType) -> str:
    """The form in which a column leaves the engine: ISO times, doubles, no NaN or infinity."""
    column = quoted(name)
    if isinstance(data_type, _FRACTIONAL):
        return f"if(isnan({column}) OR abs({column}) = double('inf'), NULL, double({column}))"
    if isinstance(data_type, T.DecimalType):
        return f"double({column})"
    if isinstance(data_type, T.DateType):
        return f"date_format({column}, 'yyyy-MM-dd')"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        full = f"date_format({column}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
        return f"regexp_replace({full}, '[.]000000$', '')"
    return column


def normalize_rows(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"{normalized_sql(f.name, f.dataType)} AS {quoted(f.name)}" for f in df.schema.fields])


def nan_to_null(df: DataFrame, names=None) -> DataFrame:
    """Loader rule: a missing number is NULL, never NaN."""
    wanted = set(names) if names is not None else None
    replaced = {
        f.name: F.when(~F.isnan(df[f"`{f.name}`"]), df[f"`{f.name}`"])
        for f in df.schema.fields
        if isinstance(f.dataType, _FRACTIONAL) and (wanted is None or f.name in wanted)
    }
    return df.withColumns(replaced) if replaced else df


def canonical_json(df: DataFrame, names) -> Column:
    """Compact JSON of the named columns, keys sorted, NULLs kept, values normalised."""
    types = {f.name: f.dataType for f in df.schema.fields}
    members = ", ".join(f"{normalized_sql(n, types[n])} AS {quoted(n)}" for n in sorted(names))
    return F.expr(f"to_json(struct({members}), map('ignoreNullFields', 'false'))")


def as_ntz(column: Column, data_type: T.DataType) -> Column:
    """Timestamps given as text are cast on use; instants keep their type."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return column
    return column.cast("timestamp_ntz")


def clock_seconds(column: Column) -> Column:
    """Whole seconds since 1970-01-01 on the column's own clock."""
    day = F.unix_date(F.to_date(column)).cast("long")
    return day * 86_400 + F.hour(column) * 3_600 + F.minute(column) * 60 + F.second(column)


def seconds_between(start: Column, end: Column) -> Column:
    """Number of second boundaries crossed from ``start`` to ``end``."""
    return clock_seconds(end) - clock_seconds(start)


def text_of(column: Column) -> Column:
    return column.cast("string")


def joined_text(columns) -> Column:
    """``a|b|c`` of the given columns, NULLs skipped."""
    return F.concat_ws("|", *[text_of(column) for column in columns])


def render(template: str | None, df: DataFrame) -> Column:
    """Compile ``"... {field} ..."`` to a concat; an unknown field raises.

    NULL prints as ``None``, whatever its format.  ``{x:spec}`` follows the format mini-language (see
    :func:`~assayer.functions.formats.formatted`); ``{x!s}`` is the text and ``{x!r}`` the quoted text.
    """
    if template is None:
        return F.lit(None).cast("string")
    types = {f.name: f.dataType for f in df.schema.fields}
    pieces: list[Column] = []
    for text, name, spec, conversion in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is None:
            continue
        if name not in types:
            raise KeyError(f"template field {name!r} is not a result column")
        if spec or conversion:
            value = formatted(F.col(quoted(name)), types[name], spec or "", conversion)
            pieces.append(F.coalesce(value, F.lit("None")))
        else:
            pieces.append(F.expr(f"coalesce(string({quoted(name)}), 'None')"))
    if len(pieces) == 1:
        return pieces[0]
    return F.concat(*pieces) if pieces else F.lit("")
