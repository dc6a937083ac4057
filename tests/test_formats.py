"""Template formats against str.format."""

import itertools

import pytest
from pyspark.sql import functions as F

from assayer.functions.values import render

SCHEMA = "t string, n long, i int, d double, b boolean, m decimal(12,3), day date"
ROWS = [
    ("ab", 5, -42, 2.5, True), ("it's", -1234567, 0, -0.125, False), ("", 9007199254740993, 7, 1234567.891, True),
    ("line\n'x' \"y\"", 65, 65, 1e15 / 8, True), ("\\", 0, 1, 0.00012345, False), ("éü", 10**15, 48, 12500000.0, True), ("long text here", 12, 99, 1e-5, True),
    ("q", 3, 3, 1e22, True), ("q", 3, 3, 0.5, True), ("q", 3, 3, 1.5, True), ("q", 3, 3, 1e16, True), ("q", 3, 3, 3.0, True), ("q", -3, 3, 2.675, True),
    *[("q", 1, 1, x, True) for x in (0.015, 0.025, 1.005, 0.145, 0.375, 2.5, 0.045, 1234567.885, 0.3, 33.335, 8.5, 0.00005, 1e14 + 0.5)],
]
TEXT = ["", "10", ">10", "<10", "^9", "*^9", ".3", "*>12.2", "s", "05"]
WHOLE = ["", "d", "5d", "05d", "+d", " d", ",", "_d", "x", "X", "o", "b", "<8", "^8", "=+8", "*=8d", "08,d"[0:2], ".2f", ",.1f", "%", "_x", "12_b"]
FRACTION = [".2f", ".0f", "f", "10.1f", "010.3f", "+.1f", ",.2f", "_.3f", "<12.2f", "*^14.2f", ".1%", "%", "=+12.2f", ".4f", ".8f"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*row, None, None) for row in ROWS], SCHEMA)


def check(table, templates, rows=ROWS):
    names = ["t", "n", "i", "d", "b"]
    columns = [render(x, table).alias(f"c{k}") for k, x in enumerate(templates)]
    got = table.select(*names, *columns).collect()
    for row in got:
        values = {n: row[n] for n in names}
        for k, template in enumerate(templates):
            try:
                wanted = template.format(**values)
            except (ValueError, OverflowError):
                continue
            assert row[f"c{k}"] == wanted, (template, values)


def test_texts(table):
    check(table, [f"<{{t:{s}}}>" for s in TEXT] + ["{t!r}", "{t!s:>12}", "{t!r:^14}", "{{x}} {t!s}"])


def test_whole_numbers(table):
    check(table, [f"{{{c}:{s}}}" for c, s in itertools.product("ni", WHOLE)] + ["{n!r}", "{i!s:>6}", "{b:d}", "{b!s:>7}", "{b!r}"])


def test_fractions(table):
    small = table.where("abs(d) < 1e15")
    check(small, [f"{{d:{s}}}" for s in FRACTION] + ["{d!s}", "{d!r:>12}"])
    check(table, ["{d!s}", "{d!r:>25}", "{d:>25}", "{d:,}"])


def test_letters(table):
    assert [r[0] for r in table.where("i in (65, 48, 99)").select(render("{i:c}", table)).collect()] == ["A", "0", "c"]


def test_nulls_and_decimals(spark, table):
    assert {r[0] for r in table.select(render("{m:.2f}|{day!s:>5}", table)).collect()} == {"None|None"}
    prices = spark.createDataFrame([("1234.565",), ("-0.005",), ("2.5",)], "x string").select(F.col("x").cast("decimal(12,3)").alias("m"))
    assert [r[0] for r in prices.select(render("{m:,.2f}", prices)).collect()] == ["1,234.56", "-0.00", "2.50"]


@pytest.mark.parametrize("template", ["{d:g}", "{d:.3e}", "{n:E}", "{n:n}", "{t:d}", "{t:=5}", "{t!a}", "{n:.2d}", "{d:d}", "{d:#x}", "{n:z}", "{day:%Y}", "{d:.30f}", "{t:,}"])
def test_refused(table, template):
    with pytest.raises(ValueError):
        render(template, table)


def test_unknown_field(table):
    with pytest.raises(KeyError):
        render("{nothing:>5}", table)
