"""Checks written as SQL, and predicates shared by checks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..specs import SqlSpec

_PLACEHOLDER = re.compile(r"\{\{\s*([\w.-]+)\s*\}\}", re.ASCII)
# Functions that call arbitrary JVM methods have no place in a check; nor has a relation that is not a given source.
_REFUSED = {"CallMethodViaReflection", "TryReflect"}
_CONSTANTS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"


def rule_sql(spark: SparkSession, spec: SqlSpec, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Run a SELECT over ``{{source_id}}`` placeholders; each row is an exception.

    The text is always a subquery, so Spark's own parser refuses anything that
    is not a query.  Sources are bound to temporary views made for this one call.  The analysed plan may read
    nothing but these very views, however the text spells it, and must read each one that it names:
    a placeholder used as an alias, in a comment or as a column is refused.
    """
    used = set(_PLACEHOLDER.findall(spec.query))
    if not used:
        raise ValueError("check SQL must name a {{source_id}}")
    missing = sorted(used - set(sources))
    if missing:
        raise ValueError(f"check SQL names unavailable sources: {', '.join(missing)}")
    views = {name: f"assayer_{uuid.uuid4().hex}" for name in used}
    try:
        for name, view in views.items():
            sources[name].createOrReplaceTempView(view)
        text = _PLACEHOLDER.sub(lambda match: views[match.group(1)], spec.query)
        if "{{" in text or "}}" in text:
            raise ValueError("malformed source placeholder")
        result = spark.sql(f"SELECT * FROM (\n{text}\n) AS exceptions")
        _refuse_foreign(result, set(views.values()))
        return result
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _each(sequence):
    return (sequence.apply(i) for i in range(sequence.size()))


def _refuse_foreign(result: DataFrame, views: set[str]) -> None:
    """Raise if the analysed plan calls JVM methods, reads anything but ``views``, or leaves one of them out.

    A source is known by the view that the session's catalog resolved, never by an alias, as the text can give
    any name to any relation.  The plans behind the views belong to the caller and are not entered.
    """
    todo, read = [(result._jdf.queryExecution().analyzed(), True)], set()
    gateway = result.sparkSession.sparkContext._gateway
    while todo:
        node, is_plan = todo.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind in _REFUSED:
            raise ValueError("check SQL must not call JVM methods")
        if is_plan:
            if kind == "View" and node.isTempView() and node.desc().identifier().table() in views:
                read.add(node.desc().identifier().table())
                continue
            if kind == "View" or (node.children().isEmpty() and kind not in _CONSTANTS):
                raise ValueError("check SQL must read its sources only")
            todo += [(e, False) for e in _each(node.expressions())]
        elif is_instance_of(gateway, node, _SUBQUERY):
            todo.append((node.plan(), True))
        todo += [(child, is_plan) for child in _each(node.children())]
    if read != views:
        raise ValueError("check SQL must read the sources that it names")


def rule_contradiction(spark: SparkSession, spec: SqlSpec, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Mutually exclusive facts: the same execution as :func:`rule_sql`."""
    return rule_sql(spark, spec, sources)


def in_vocabulary(column: Column, values) -> Column:
    """Exact, case-sensitive membership of the value's text; NULL is not a member."""
    return F.coalesce(column.cast("string").isin(list(values)), F.lit(False))


def null_safe_eq(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def null_safe_neq(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def bounded_result(df: DataFrame, max_rows: int, order: list[Column]) -> DataFrame:
    """The first ``max_rows`` rows in ``order`` and whether more existed.

    One row more than asked is taken (a distributed top-n), so ``truncated`` is
    known without counting the rest; only those few rows are numbered.
    """
    if not 0 < max_rows <= 10_000:
        raise ValueError("max_rows must lie in 1..10000")
    head = df.orderBy(*order).limit(max_rows + 1)
    place = F.row_number().over(Window.orderBy(*order))
    total = F.count("*").over(Window.partitionBy())
    return (
        head.withColumns({"__place": place, "truncated": total > max_rows})
        .where(F.col("__place") <= max_rows)
        .drop("__place")
    )
