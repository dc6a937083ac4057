"""Order and gap checks over the events of each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_ntz, joined_text, seconds_between, text_of
from ..scale import HOT_GROUP_ROWS
from ..specs import TimelineSpec
from .ordering import previous_values


def step_number(event: Column, expected_order) -> Column:
    """1-based place of an event in the expected order, NULL when it has none."""
    result = F.lit(None).cast("int")
    for number, name in reversed(list(enumerate(expected_order, start=1))):
        result = F.when(text_of(event) == F.lit(name), F.lit(number)).otherwise(result)
    return result


def timeline(df: DataFrame, spec: TimelineSpec, *, max_group_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Rows that break the expected order, or follow the row before too late.

    Breaks are: an event without a place, a first event (or one after an event
    without a place) that is not step 1, a step back, a skipped step.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    staged = df.withColumns(
        {
            "event_rank": step_number(F.col(f"`{spec.event_field}`"), spec.expected_order),
            "__time": as_ntz(F.col(f"`{spec.timestamp_field}`"), types[spec.timestamp_field]),
        }
    )
    ordered = previous_values(
        staged,
        spec.entity_fields,
        "__time",
        spec.tie_breakers,
        {"previous_rank": "event_rank", "previous_timestamp": "__time"},
        max_group_rows=max_group_rows,
    )
    rank, before = F.col("event_rank"), F.col("previous_rank")
    breaks = (
        rank.isNull()
        | (before.isNull() & (rank != 1))
        | (before.isNotNull() & ((rank < before) | (rank > before + 1)))
    )
    if spec.max_gap_seconds is not None:
        gap = seconds_between(F.col("previous_timestamp"), F.col("__time"))
        breaks = breaks | (gap > spec.max_gap_seconds)
    object_id = joined_text(F.col(f"`{name}`") for name in spec.entity_fields)
    return ordered.where(breaks).select(
        object_id.alias("object_id"),
        *[F.col(f"`{name}`") for name in df.columns],
        "event_rank",
        "previous_rank",
        "previous_timestamp",
    )
