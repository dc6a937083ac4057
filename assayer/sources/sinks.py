"""Writing evidence, run tables and events."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import evidence_collisions, new_evidence
from ..scale import freeze
from .versions import Conflict, Versions


# A run's id names a folder.
RUN_ID = re.compile(r"[A-Za-z0-9_.-]{1,80}")


def sink_evidence(evidence: DataFrame, path: str) -> int:
    """Add records that are not stored yet; an id with another checksum raises.  Returns rows added.

    Rows are written to a folder of their own, one part per run, and then published for their runs in one step (see
    :class:`~assayer.sources.versions.Versions`).  A writer that fails leaves nothing that is read; one that another
    writer overtook compares with the new state and publishes again, so two writers of the same records add them once.
    Safe to repeat: what is already there is left out.
    """
    spark, versions = evidence.sparkSession, Versions(evidence.sparkSession, path)
    incoming = freeze(evidence.dropDuplicates(["run_id", "evidence_id", "checksum"]))
    twice = incoming.groupBy("run_id", "evidence_id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("evidence id collision within the batch")
    runs = [r["run_id"] for r in incoming.select("run_id").distinct().collect()]
    bad = [run for run in runs if not (run and RUN_ID.fullmatch(run))]
    if bad:
        raise ValueError(f"invalid run_id {bad[0]!r}")
    while True:
        number, state = versions.current()
        mine = [f for run in runs for f in state.get("runs", {}).get(run, [])]
        fresh = incoming
        if mine:
            known = spark.read.schema(state["schema"]).parquet(*[versions.path(f) for f in mine])
            if not evidence_collisions(incoming, known).isEmpty():
                raise ValueError("evidence id collision with stored records")
            fresh = freeze(new_evidence(incoming, known))
        added = fresh.count()
        if state and not added:
            return 0
        folder = versions.folder()
        named = fresh.withColumns({"created_at": F.current_timestamp(), "run": F.col("run_id")})
        named.write.partitionBy("run").parquet(versions.path(folder))
        schema = named.drop("run")
        listed = {run: list(folders) for run, folders in state.get("runs", {}).items()}
        for run, name in _partitions(named):
            listed.setdefault(run, []).append(f"{folder}/{name}")
        try:
            versions.publish(number, {"runs": listed, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)})
        except Conflict:
            continue
        return added


def _partitions(named: DataFrame) -> list[tuple[str, str]]:
    """Each run and the name of its folder, as the writer spells it."""
    return [(r["run_id"], f"run={r['run_id']}") for r in named.select("run_id").distinct().collect()]


def stored_evidence(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The published records, of one run or of all."""
    versions = Versions(spark, path)
    _, state = versions.current()
    if not state:
        raise ValueError(f"no evidence is stored below {path}")
    runs = state["runs"] if run_id is None else {run_id: state["runs"].get(run_id, [])}
    paths = [versions.path(f) for folders in runs.values() for f in folders]
    return spark.read.schema(state["schema"]).parquet(*paths) if paths else spark.createDataFrame([], state["schema"])


def sink_run_outputs(run_id: str, tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Write one folder per table below ``root/run_id`` and a manifest of row counts."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{run_id}/{name}")
    parts = None
    for name in tables:
        part = spark.read.parquet(f"{root}/{run_id}/{name}").agg(F.count("*").alias("row_count")).select(
            F.lit(run_id).alias("run_id"), F.lit(name).alias("table_name"), F.lit(f"{name}/").alias("location"), "row_count"
        )
        parts = part if parts is None else parts.unionByName(part)
    parts.write.mode("overwrite").json(f"{root}/{run_id}/manifest")
    return spark.read.json(f"{root}/{run_id}/manifest")


def append_events(events: DataFrame, path: str) -> None:
    """Append-only JSON lines, one folder per run; readable as a stream."""
    events.write.mode("append").partitionBy("run_id").json(path)
