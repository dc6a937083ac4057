"""From outlier hypotheses to findings, coverage and remaining work."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.values import text_of
from ..scale import freeze, join_on, union_all
from . import outliers as out
from .evidence import EVIDENCE_COLUMNS, content_checksum
from .findings import ROUTE_STEPS, steps

CHECK_ID = "BUSINESS_SEMANTIC_CONSTRAINT"
ISSUE_TYPE = "semantic_target_mismatch"
TAGS = (
    "business_hypothesis",
    "material_business_hypothesis",
    "semantic_constraint",
    "requires_policy_grounding",
)


@dataclass
class Investigation:
    """What became of each hypothesis, and an evidence record for each promoted one."""

    hypotheses: DataFrame
    evidence: DataFrame


def investigate_hypotheses(
    hypotheses: DataFrame, sources: Mapping[str, DataFrame], *, run_id: str, minimum_confidence: float = 0.8
) -> Investigation:
    """Run the selection of every hypothesis on the sources again and say what became of it.

    A hypothesis carries its selection as data (sources, keys and predicate, see
    :data:`~assayer.operators.outliers.SELECTION`); nothing found before is used.  The status is
    BELOW_MATERIALITY_THRESHOLD, ERROR (a source or column is missing or can't be read; ``error`` says why),
    NOT_REPRODUCED (no row is selected any more) or PROMOTED_TO_FINDING.  Adds ``investigation``,
    ``error``, ``reproduced_rows``, object, value and sample of the first row, the id of the promoted finding, and
    ``record``, the evidence.  Selections of one pair of sources run together; the driver sees one
    row per pair and set of columns, none per hypothesis.
    """
    spark = hypotheses.sparkSession
    asked = hypotheses.select(
        "hypothesis_id", "confidence", F.from_json("selection", out.SELECTION).alias("s"),
    ).withColumn("route", F.to_json(F.struct(*[F.col(f"s.{name}") for name, _ in out.ROUTE_FIELDS])))
    asked = freeze(asked)
    found, errors = [], []
    for row in asked.select("route").distinct().orderBy("route").collect():
        try:
            found.append(freeze(_rerun(asked.where(F.col("route") == row["route"]), row["route"], sources)))
        except Exception as error:  # noqa: BLE001 - one unreadable source must not stop the rest
            errors.append((row["route"], f"{type(error).__name__}: {error}"))
    reproduced = union_all(found)
    if reproduced is None:
        reproduced = spark.createDataFrame([], _REPRODUCED)
    failed = asked.join(spark.createDataFrame(errors, "route string, error string"), "route").select("hypothesis_id", "error")
    joined = join_on(join_on(hypotheses, reproduced, ["hypothesis_id"], "left"), failed, ["hypothesis_id"], "left")
    count = F.coalesce(F.col("reproduced_rows"), F.lit(0).cast("long"))
    status = (
        F.when(~F.coalesce(F.col("confidence") >= minimum_confidence, F.lit(False)), "BELOW_MATERIALITY_THRESHOLD")
        .when(F.col("error").isNotNull(), "ERROR")
        .when(count == 0, "NOT_REPRODUCED")
        .otherwise("PROMOTED_TO_FINDING")
    )
    promoted = F.col("investigation") == "PROMOTED_TO_FINDING"
    investigated = joined.withColumns({
        "reproduced_rows": count, "investigation": status, "object_id": F.coalesce("object_id", "hypothesis_id"),
    }).withColumns({
        "finding_id": F.when(promoted, ids.finding_id(F.lit(CHECK_ID), F.lit(ISSUE_TYPE), F.col("object_id"))),
        "result": F.when(promoted, F.to_json(F.struct("hypothesis_id", "reproduced_rows", "sample"), {"ignoreNullFields": "false"})),
    })
    recorded = observation_records(investigated, run_id, CHECK_ID)
    return Investigation(recorded, recorded.where(promoted).select("record.*"))


_REPRODUCED = "hypothesis_id string, reproduced_rows long, object_id string, actual_value string, sample string"


def _rerun(asked: DataFrame, route: str, sources: Mapping[str, DataFrame]) -> DataFrame:
    """How many rows each selection of one route returns, and the first of them."""
    fields = {name: tuple(value) if isinstance(value, list) else value for name, value in json.loads(route).items()}
    spec = out.RouteSpec(**fields)
    missing = [s for s in (spec.mapping_source, spec.reference_source) if s not in sources]
    if missing:
        raise KeyError(f"unknown source: {', '.join(missing)}")
    wanted = asked.select("hypothesis_id", *[F.col(f"s.{name}").alias(name) for name in out.PREDICATE_FIELDS])
    rows = out.selected_rows(wanted, sources[spec.mapping_source], sources[spec.reference_source], spec)
    first = F.min_by(F.struct("object_id", "target_value", "sample"), F.struct("row_id", "sample"))
    return rows.groupBy("hypothesis_id").agg(F.count("*").alias("reproduced_rows"), first.alias("first")).select(
        "hypothesis_id", "reproduced_rows", "first.object_id", F.col("first.target_value").alias("actual_value"), "first.sample")


def observation_records(investigated: DataFrame, run_id: str, check_id: str) -> DataFrame:
    """Adds ``record``: an evidence record whose query is the selection that was run."""
    described = investigated.withColumns({
        "run_id": F.lit(run_id),
        "rule_id": F.lit(check_id),
        "rule_version": F.lit("1"),
        "rule_hash": ids.sha256(F.col("selection")),
        "rule_kind": F.lit("observation"),
        "source_ids": F.array("mapping_source", "reference_source"),
        "query": F.col("selection"),
    })
    summed = described.withColumn("checksum", content_checksum())
    identified = summed.withColumn("evidence_id", ids.evidence_id(F.col("run_id"), F.col("checksum")))
    return identified.select(*investigated.columns, F.struct(*EVIDENCE_COLUMNS).alias("record")).drop("result")


def hypothesis_candidates(investigated: DataFrame, position: int = 0) -> DataFrame:
    """Promoted hypotheses in the shape of finding candidates, with references to their stored records."""
    h = investigated.where("investigation = 'PROMOTED_TO_FINDING'")
    attributes = F.map_keys("outlier_attributes")
    values = F.from_json("sample", "map<string,string>")
    actual = F.map_from_arrays(
        attributes, F.transform(attributes, lambda a: F.try_element_at(values, F.concat(F.lit("target_"), a)))
    )
    facts = F.struct(
        F.col("context"),
        F.col("hypothesis_id"),
        F.col("outlier_attributes").alias("expected"),
        actual.alias("actual"),
        F.col("reproduced_rows"),
        F.col("sample"),
    )
    content = F.to_json(facts, {"ignoreNullFields": "false"})
    evidence = F.struct(
        F.col("record.evidence_id"),
        F.col("record.checksum"),
        F.concat_ws(", ", "mapping_source", "reference_source").alias("source_name"),
        F.col("object_id").alias("object_id"),
        F.lit("Re-run selection returned the deviating row").alias("description"),
        content.alias("fields"),
        F.col("record.query").alias("query"),
        F.lit(False).alias("constraint_match"),
    )

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    expected = F.to_json("outlier_attributes", {"ignoreNullFields": "false"})
    return h.select(
        "finding_id",
        F.lit(CHECK_ID).alias("check_id"),
        F.lit(ISSUE_TYPE).alias("issue_type"),
        "object_id",
        text("Target of route ", F.col("object_id"), " does not fit its context").alias("title"),
        text("In context ", F.col("context"), " the expected target is ", expected).alias("summary"),
        F.lit("The route leads to an entity unlike that of comparable routes.").alias("root_cause"),
        text("In context ", F.col("context"), " the target should be ", expected).alias("criterion"),
        F.lit("The operation may be booked in the wrong business class.").alias("risk"),
        F.lit("Check the route against its policy, then trace the object downstream.").alias("recommendation"),
        F.when(F.col("confidence") >= 0.9, "HIGH").otherwise("MEDIUM").alias("severity"),
        "confidence",
        content.alias("facts"),
        F.array(*[F.lit(t) for t in TAGS]).alias("tags"),
        F.lit(position).cast("long").alias("seq"),
        "hypothesis_id",
        evidence.alias("evidence"),
    )


def hypothesis_coverage(expected: DataFrame, findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Verdict of every expected or represented hypothesis.

    ``expected``: hypothesis_id; ``findings``: hypothesis_id, finding_id;
    ``reviews``: finding_id, verdict.
    """
    represented = join_on(
        findings.select("hypothesis_id", "finding_id"), reviews.select("finding_id", "verdict"), ["finding_id"], "left"
    ).select(
        "hypothesis_id", "finding_id", F.coalesce("verdict", F.lit("MISSING_REVIEW")).alias("verdict")
    )
    absent = join_on(expected.select("hypothesis_id").distinct(), represented, ["hypothesis_id"], "left_anti").select(
        "hypothesis_id",
        F.lit(None).cast("string").alias("finding_id"),
        F.lit("MISSING_FINDING").alias("verdict"),
    )
    return represented.unionByName(absent)


def coverage_summary(coverage: DataFrame) -> DataFrame:
    missing = F.col("verdict").isin("MISSING_FINDING", "MISSING_REVIEW")
    return coverage.agg(
        F.count("*").alias("material_hypotheses_count"),
        F.count_if(missing | (F.col("verdict") == "REQUIRES_VALIDATION")).alias("unresolved_count"),
        (F.count_if(missing) == 0).alias("complete"),
    )


def hypothesis_plan(hypotheses: DataFrame, promoted: DataFrame) -> DataFrame:
    """Work items for hypotheses that did not become findings."""
    rest = join_on(hypotheses, promoted.select("hypothesis_id"), ["hypothesis_id"], "left_anti")
    high = (F.col("pattern") == "OUTLIER") & (F.col("confidence") >= 0.8)
    return rest.select(
        F.concat(F.lit("PLAN-"), F.col("hypothesis_id")).alias("plan_id"),
        F.when(high, "HIGH").otherwise("MEDIUM").alias("priority"),
        F.lit("POTENTIAL_RISK").alias("status"),
        F.concat(F.lit("Untypical value of "), F.col("attribute")).alias("title"),
        F.concat(
            text_of(F.col("mismatch_rows")),
            F.lit(" of "),
            text_of(F.col("joined_rows")),
            F.lit(" comparable routes differ from the dominant value"),
        ).alias("rationale"),
        F.lit(None).cast("string").alias("finding_id"),
        F.array("mapping_source", "reference_source").alias("sources"),
        F.array().cast("array<string>").alias("source_locations"),
        steps(ROUTE_STEPS).alias("next_steps"),
    )
