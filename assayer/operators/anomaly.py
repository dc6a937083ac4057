"""Statistical outliers: standard score and interquartile range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import attach_small
from ..specs import AnomalySpec
from .ordering import GATHERED_ROWS, grouped_quantiles


def _with_number(df: DataFrame, name: str) -> DataFrame:
    """Missing numbers are NULL: NaN never reaches a statistic."""
    column: Column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        column = F.when(~F.isnan(column), column)
    return df.withColumn("__x", column.cast("double"))


def _with_stats(rows: DataFrame, stats: DataFrame, groups, names) -> DataFrame:
    if groups:
        return attach_small(rows, stats, groups, null_safe=True)
    one = stats.select(F.struct(*names).alias("s")).scalar()
    return rows.withColumn("__s", one).select("*", *[F.col(f"__s.{n}").alias(n) for n in names]).drop("__s")


def zscore_outliers(df: DataFrame, spec: AnomalySpec) -> DataFrame:
    """Rows further than ``threshold`` population deviations from their group mean.

    Group statistics are aggregated with map-side combine and joined back, so a
    hot group is never gathered; groups without spread yield nothing.
    """
    groups = list(spec.group_by)
    rows = _with_number(df, spec.field)
    stats = rows.groupBy(*groups).agg(
        F.avg("__x").alias("expected_mean"), F.stddev_pop("__x").alias("expected_stddev")
    )
    if groups:
        stats = stats.where(F.col("expected_stddev") > 0)
    score = F.try_divide(F.col("__x") - F.col("expected_mean"), F.col("expected_stddev"))
    return (
        _with_stats(rows, stats, groups, ["expected_mean", "expected_stddev"])
        .withColumn("anomaly_score", score)
        .where((F.col("expected_stddev") > 0) & (F.abs("anomaly_score") > spec.threshold))
        .drop("__x")
    )


def iqr_outliers(df: DataFrame, spec: AnomalySpec, *, gathered_rows: int = GATHERED_ROWS) -> DataFrame:
    """Rows outside ``[q1 - t*iqr, q3 + t*iqr]``; the score is 0 where iqr is 0."""
    groups = list(spec.group_by)
    rows = _with_number(df, spec.field)
    stats = grouped_quantiles(rows, groups, "__x", {"q1": 0.25, "q3": 0.75}, gathered_rows=gathered_rows)
    spread = F.col("q3") - F.col("q1")
    reach = F.lit(float(spec.threshold)) * spread
    middle = (F.col("q1") + F.col("q3")) / 2
    score = F.when(spread == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(F.col("__x") - middle), spread))
    return (
        _with_stats(rows, stats, groups, ["q1", "q3"])
        .where((F.col("__x") < F.col("q1") - reach) | (F.col("__x") > F.col("q3") + reach))
        .withColumn("anomaly_score", score)
        .drop("__x")
    )


def anomaly(df: DataFrame, spec: AnomalySpec) -> DataFrame:
    return zscore_outliers(df, spec) if spec.method == "zscore" else iqr_outliers(df, spec)
