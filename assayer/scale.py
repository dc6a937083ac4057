"""Size checks, durable cuts and size-checked joins shared by the operators.

Everything here answers one question before a plan is chosen: how big is this
side, really?  Small plans keep the short form; everything else is measured
first, and the measured table is written to the cluster's checkpoint folder so
that it is neither recomputed nor lost with an executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A plan reading less than this cannot hold a group too big for one task.
SMALL_PLAN_BYTES = 256 * 1024 * 1024
# Upper bound for a side that is copied to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Groups above this many rows are split before they are sorted.
HOT_GROUP_ROWS = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session inside one process (``local[n]``) may do without it and gets a
    temporary folder; on a cluster a missing setting is an error, as files in a
    machine's own folder would be lost to the other machines.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="assayer-checkpoint-"))
    return context.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the shared folder unless that was done before."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(spark)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/assayer-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back as a plain table.

    Later plans start from files that outlive any executor, are computed once, and
    carry no partitioning, so both sides of a later join are exchanged and adaptive
    execution can split a hot key.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def union_all(frames: Iterable[DataFrame]) -> DataFrame | None:
    frames = list(frames)
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def plan_bytes(df: DataFrame) -> int | None:
    """Optimizer's upper estimate of the bytes behind ``df`` (None when unknown)."""
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return None
    return int(jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, limit: int = SMALL_PLAN_BYTES) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= limit


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows as text, an upper-side proxy for their in-memory size."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return int(row["b"] or 0)


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` only when it has been measured to fit.

    A plan estimated below Spark's own broadcast threshold is returned as is
    (Catalyst broadcasts it).  A larger one is written out and measured; when it
    does not fit it is returned without a hint and the join stays a shuffle join
    whose hot keys adaptive execution splits.
    """
    threshold = 10 * 1024 * 1024
    if is_small(df, threshold):
        return df
    frozen = freeze(df)
    return F.broadcast(frozen) if measured_bytes(frozen) <= BROADCAST_BYTES else frozen


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for Python work on a small input that sits in one or two files.

    A large input already arrives in many splits and is left where it is.
    """
    if not is_small(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on same-named keys, keeping the left side's key columns."""
    if not null_safe:
        return left.join(right, list(keys), how)
    suffix = "__" + uuid.uuid4().hex[:8]
    renamed = right.withColumnsRenamed({key: key + suffix for key in keys})
    condition = _all(F.col(key).eqNullSafe(F.col(key + suffix)) for key in keys)
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[key + suffix for key in keys])


def attach_small(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    null_safe: bool = False,
) -> DataFrame:
    """Join aggregated ``facts`` back to many ``rows``; broadcast only if it fits."""
    return join_on(rows, checked_broadcast(facts), keys, how, null_safe=null_safe)


def _all(conditions) -> Column:
    result: Column | None = None
    for condition in conditions:
        result = condition if result is None else result & condition
    return F.lit(True) if result is None else result


def any_of(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result
