"""The format mini-language of text templates, compiled to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPEC = re.compile(
    r"(?:(?P<fill>.)?(?P<align>[<>=^]))?(?P<sign>[-+ ])?(?P<alternate>#)?(?P<zero>0)?(?P<width>\d+)?"
    r"(?P<group>[,_])?(?:\.(?P<precision>\d+))?(?P<kind>[a-zA-Z%])?", re.DOTALL)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)
# A decimal of this form holds every double below 1e15 with up to 23 places.
_MOST_DIGITS, _PLACES = 38, 23


def formatted(column: Column, data_type: T.DataType, spec: str, conversion: str | None = None) -> Column:
    """The text that ``format(value, spec)`` gives; NULL stays NULL.

    Texts take fill, align, width and precision.  Whole numbers take the kinds d, x, X, o, b, c and those of
    fractions; fractions take f, F, % and none; both take sign, 0, width and grouping.  Fractions are rounded half-even
    on their exact value, and places beyond a value's shortest digits are zeros; f, F and % take at most 20 places (12 of a whole number), and values of 1e15 or more raise at run time.
    ``!r`` quotes texts, ``!s`` makes a text of anything.  What has no expression here raises a ValueError
    when the plan is built: kinds e, E, g, G and n, the flag #, the conversion !a, and formats of other types.
    """
    if conversion == "s":
        column, data_type = _plain(column, data_type), T.StringType()
    elif conversion == "r":
        column, data_type = _quoted(column, data_type), T.StringType()
    elif conversion:
        raise ValueError(f"conversion !{conversion} is not supported")
    parts = _SPEC.fullmatch(spec)
    if parts is None or parts["alternate"]:
        raise ValueError(f"format {spec!r} is not supported")
    kind, zero = parts["kind"], bool(parts["zero"])
    width = int(parts["width"] or 0)
    precision = None if parts["precision"] is None else int(parts["precision"])
    fill = parts["fill"] or ("0" if zero else " ")
    if isinstance(data_type, T.BooleanType) and spec:
        column, data_type = column.cast("long"), T.LongType()
    if isinstance(data_type, T.StringType):
        if parts["sign"] or parts["group"] or parts["align"] == "=" or kind not in (None, "s"):
            raise ValueError(f"format {spec!r} does not fit a text")
        text = column if precision is None else F.substring(column, 1, precision)
        return _padded(text, fill, parts["align"] or "<", width)
    if not isinstance(data_type, (*_WHOLE, *_FRACTION)):
        if spec:
            raise ValueError(f"format {spec!r} does not fit {data_type.simpleString()}")
        return _plain(column, data_type)
    digits = _digits(column, data_type, kind, precision, parts["group"], spec)
    below = column < 0
    sign = F.when(below, "-").otherwise({"+": "+", " ": " "}.get(parts["sign"] or "", ""))
    align = parts["align"] or ("=" if zero else ">")
    if align != "=":
        return _padded(F.concat(sign, digits), fill, align, width)
    if parts["group"] and fill == "0" and zero and not parts["align"]:
        raise ValueError(f"format {spec!r}: grouped digits filled with zeros are not supported")
    missing = F.greatest(F.lit(0), F.lit(width) - F.length(sign) - F.length(digits))
    return F.concat(sign, F.repeat(F.lit(fill), missing), digits)


def _padded(text: Column, fill: str, align: str, width: int) -> Column:
    if not width:
        return text
    missing = F.greatest(F.lit(0), F.lit(width) - F.length(text))
    left = {"<": F.lit(0), ">": missing, "^": F.floor(missing / 2).cast("int")}[align]
    return F.concat(F.repeat(F.lit(fill), left), text, F.repeat(F.lit(fill), missing - left))


def _digits(column: Column, data_type: T.DataType, kind: str | None, precision: int | None, group: str | None, spec: str) -> Column:
    """The number without its sign."""
    whole = isinstance(data_type, _WHOLE)
    if whole and kind in (None, "d", "x", "X", "o", "b", "c"):
        if precision is not None or (group == "," and kind not in (None, "d")) or (group and kind == "c"):
            raise ValueError(f"format {spec!r} does not fit a whole number")
        if kind == "c":
            return F.char(column)
        size = F.regexp_replace(column.cast("decimal(20,0)").cast("string"), "^-", "")
        if kind in ("x", "X", "o", "b"):
            size = F.conv(size, 10, {"x": 16, "X": 16, "o": 8, "b": 2}[kind])
            size = F.lower(size) if kind == "x" else size
            return size if group is None else F.regexp_replace(size, "(?<=.)(?=(.{4})+$)", group)
        return _grouped(size, group)
    if kind in ("f", "F", "%"):
        places = 6 if precision is None else precision
        if places > (12 if whole else 20):
            raise ValueError(f"format {spec!r}: too many places")
        text = _fixed(F.abs(column), data_type, places, kind == "%")
        body = _grouped(F.regexp_extract(text, "^[0-9]+", 0), group)
        return F.concat(body, F.regexp_extract(text, r"\.[0-9]+$", 0), F.lit("%" if kind == "%" else ""))
    if kind is None and precision is None and not whole:
        text = F.regexp_replace(_plain(column, data_type), "^-", "")
        return F.concat(_grouped(F.regexp_extract(text, "^[0-9]+", 0), group), F.regexp_replace(text, "^[0-9]+", ""))
    raise ValueError(f"format {spec!r} is not supported for {data_type.simpleString()}")


def _fixed(size: Column, data_type: T.DataType, places: int, percent: bool) -> Column:
    """``size`` (times 100) with this many places, rounded half-even on its exact value."""
    if isinstance(data_type, T.DecimalType):
        shifted = size.cast(f"decimal({_MOST_DIGITS},{_PLACES})") * (100 if percent else 1)
        return F.bround(shifted, places).cast(f"decimal({_MOST_DIGITS - 2},{places})").cast("string")
    value = size.cast("double") * F.lit(100.0 if percent else 1.0)
    whole = isinstance(data_type, _WHOLE)
    held = f"decimal({_MOST_DIGITS},{12 if whole else _PLACES - 2 if percent else _PLACES})"
    digits = value.cast(held)
    if whole:
        return F.bround(digits, places).cast(f"decimal({_MOST_DIGITS - 2},{places})").cast("string")
    # The shortest digits may lie half way although the value itself does not: then the exact
    # product with a power of ten, as a sum of two doubles, says on which side the value is.
    down = F.floor(digits, F.lit(places)) if places else F.floor(digits)
    down = down.cast(f"decimal({_MOST_DIGITS - 2},{places})")
    half = F.expr(f"cast('5e-{places + 1}' AS {held})")
    step = F.expr(f"cast('1e-{places}' AS {held})") if places else F.lit(1)
    tie = (digits - down) == half
    product, error = _product(value, 10.0 ** (places + 1))
    side = F.signum((product - F.round(product)) + error)
    up = (down + step).cast(f"decimal({_MOST_DIGITS - 2},{places})")
    usual = F.bround(digits, places).cast(f"decimal({_MOST_DIGITS - 2},{places})")
    return F.when(tie & (side > 0), up).when(tie & (side < 0), down).otherwise(usual).cast("string")


def _product(value: Column, factor: float) -> tuple[Column, Column]:
    """value * factor as a rounded product and its exact error (both numbers are split in halves)."""
    product, splitter = value * F.lit(factor), 134217729.0
    spread = value * F.lit(splitter)
    high = spread - (spread - value)
    low = value - high
    factor_high = splitter * factor - (splitter * factor - factor)
    factor_low = factor - factor_high
    error = ((high * F.lit(factor_high) - product) + high * F.lit(factor_low) + low * F.lit(factor_high)) + low * F.lit(factor_low)
    return product, error


def _grouped(digits: Column, group: str | None) -> Column:
    return digits if group is None else F.regexp_replace(digits, "(?<=[0-9])(?=([0-9]{3})+$)", group)


def _plain(column: Column, data_type: T.DataType) -> Column:
    """``str(value)``: fractions without an exponent from 1e-4 up to below 1e16, flags as True and False."""
    if isinstance(data_type, T.BooleanType):
        return F.when(column, "True").otherwise(F.when(~column, "False"))
    if not isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.cast("string")
    value = column.cast("double")
    text = value.cast("string")
    expanded = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(?<=\.[0-9]{1,21})0+$", "")
    usual = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)
    power = F.regexp_extract(text, "E(-?)([0-9]+)$", 2)
    minus = F.when(text.contains("E-"), "-").otherwise("+")
    scientific = F.concat(F.regexp_replace(F.regexp_extract(text, "^[^E]+", 0), r"\.0$", ""), F.lit("e"), minus, F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
    special = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.coalesce(special, F.when(usual & text.contains("E"), expanded).when(text.contains("E"), scientific).otherwise(text))


def _quoted(column: Column, data_type: T.DataType) -> Column:
    """``repr(value)`` of texts, numbers and flags."""
    if isinstance(data_type, T.StringType):
        plain = F.replace(column, F.lit("\\"), F.lit("\\\\"))
        for letter, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            plain = F.replace(plain, F.lit(letter), F.lit(name))
        double = column.contains("'") & ~column.contains('"')
        return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))
    if isinstance(data_type, (*_WHOLE, T.FloatType, T.DoubleType, T.BooleanType)):
        return _plain(column, data_type)
    raise ValueError(f"conversion !r does not fit {data_type.simpleString()}")
