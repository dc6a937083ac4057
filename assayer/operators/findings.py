"""Findings: texts, deduplication, review and the ranked plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.values import render
from ..scale import attach_small, checked_broadcast, join_on, stored
from ..specs import SEVERITIES, RuleSpec
from .evidence import build_evidence
from .ordering import top_per_group

TEXTS = (
    "check_id", "issue_type", "object_id", "title", "summary", "root_cause", "criterion",
    "risk", "recommendation", "severity", "facts", "tags", "hypothesis_id",
)
REFERENCE = (
    "evidence_id", "checksum", "source_name", "object_id", "description", "fields", "query",
    "constraint_match",
)
RENDERED = ("title", "summary", "root_cause", "criterion", "risk", "recommendation")
LOW_CONFIDENCE = 0.75


def rule_candidates(
    exceptions: DataFrame, rule: RuleSpec, run_id: str, object_id_column: str | None = None, position: int = 0
) -> DataFrame:
    """One finding candidate with its evidence reference per exception row.

    ``position`` is the rule's place in the run; of candidates for one finding the first rule's comes first.
    """
    return record_candidates(rule_records(exceptions, rule, run_id, object_id_column), rule, position)


def rule_records(exceptions: DataFrame, rule: RuleSpec, run_id: str, object_id_column: str | None = None) -> DataFrame:
    """The evidence record of each exception row, with its finding's id and texts.

    Evidence and texts come from the same row, column by column: no join is needed.
    """
    rendered = {name: render(getattr(rule.finding, name), exceptions) for name in RENDERED}
    rows = build_evidence(exceptions, rule, run_id, object_id_column, keep=rendered)
    return rows.withColumn("finding_id", ids.finding_id(F.lit(rule.rule_id), F.lit(rule.finding.issue_type), F.col("object_id")))


def record_candidates(records: DataFrame, rule: RuleSpec, position: int = 0) -> DataFrame:
    """The finding candidates of a rule's records (:func:`rule_records`)."""
    texts = rule.finding
    description = f"Rule {rule.rule_id} returned an exception row"
    constants = {
        "check_id": F.lit(rule.rule_id),
        "issue_type": F.lit(texts.issue_type),
        "severity": F.lit(texts.severity),
        "confidence": F.lit(float(texts.confidence)),
        "tags": F.array(*[F.lit(t) for t in (*rule.tags, *texts.tags)]).cast("array<string>"),
        "source_name": F.lit(", ".join(rule.source_ids)),
        "description": F.lit(description),
    }
    return records.withColumns(constants).select(
        "finding_id",
        "check_id",
        "issue_type",
        "object_id",
        *RENDERED,
        "severity",
        "confidence",
        F.col("result").alias("facts"),
        "tags",
        F.lit(position).cast("long").alias("seq"),
        F.expr("CAST(NULL AS STRING) AS hypothesis_id"),
        F.expr(
            "struct(evidence_id, checksum, source_name, object_id, description, result AS fields, query, "
            "false AS constraint_match) AS evidence"
        ),
    )


def dedupe_findings(candidates: DataFrame) -> DataFrame:
    """One row per finding: texts of its first candidate (by rule, then evidence id), highest confidence.

    The highest confidence is aggregated over two narrow columns.  The first candidate is a limit of one row per
    finding, applied before the shuffle, so a finding with very many exceptions sends one row per task; its
    evidence stays a table of its own (:func:`finding_evidence`).
    """
    highest = candidates.groupBy("finding_id").agg(F.max("confidence").alias("confidence"))
    order = [F.asc("seq"), F.asc("evidence.evidence_id"), F.asc("title"), F.asc("summary")]
    first = top_per_group(candidates.drop("confidence"), ["finding_id"], order, 1, "place").select("finding_id", *TEXTS)
    return join_on(first, highest, ["finding_id"])


def finding_evidence(candidates: DataFrame) -> DataFrame:
    """Distinct evidence references of each finding, in long form."""
    return candidates.select("finding_id", *[F.col(f"evidence.{n}").alias(n) for n in REFERENCE]).distinct()


def written_finding_evidence(candidates: DataFrame) -> DataFrame:
    """:func:`finding_evidence` of candidates that lie in written tables.

    Equal references have one finding and one checksum, so only rows that share a hash of both with another row are
    compared whole.  Where there are none, the references are columns of the written tables: no row is moved or written again.
    """
    rows = candidates.select("finding_id", *[F.col(f"evidence.{n}").alias(n) for n in REFERENCE])
    keyed = rows.withColumn("__key", F.xxhash64("finding_id", "checksum"))
    repeated = stored(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"))
    if repeated.isEmpty():
        return rows
    shared = checked_broadcast(repeated)
    single = join_on(keyed, shared, ["__key"], "left_anti")
    compared = join_on(keyed, shared, ["__key"], "left_semi").distinct()
    return stored(single.unionByName(compared).drop("__key"))


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("confidence"), F.asc("finding_id"))


def evidence_facts(evidence: DataFrame) -> DataFrame:
    """Per finding: how many references there are and of which kind."""
    reproducible = (
        (F.coalesce("evidence_id", F.lit("")) != "")
        & (F.coalesce("checksum", F.lit("")) != "")
        & (F.coalesce("query", F.lit("")) != "")
    )
    return evidence.groupBy("finding_id").agg(
        F.count("*").alias("evidence_count"),
        F.count_if(reproducible).alias("table_evidence"),
        F.count_if("constraint_match").alias("policy_evidence"),
    )


def evidence_sources(evidence: DataFrame) -> DataFrame:
    """Distinct source ids of each finding (names are comma-separated)."""
    return (
        evidence.select("finding_id", "source_name")
        .distinct()
        .select("finding_id", F.explode(F.split("source_name", ",")).alias("name"))
        .select("finding_id", F.trim("name").alias("source_id"))
        .where("source_id <> ''")
        .distinct()
    )


def _verdict() -> Column:
    semantic = F.array_contains("tags", "semantic_constraint")
    weak = (F.col("confidence") < LOW_CONFIDENCE) | F.col("partial_vocabulary")
    return (
        F.when(F.col("table_evidence") == 0, "REJECTED")
        .when(semantic & (F.col("policy_evidence") == 0), "REQUIRES_VALIDATION")
        .when(weak, "REQUIRES_VALIDATION")
        .otherwise("CONFIRMED")
    )


def _rationale() -> Column:
    semantic = F.array_contains("tags", "semantic_constraint")
    return (
        F.when(F.col("table_evidence") == 0, "No reproducible row with checksum and query supports it.")
        .when(
            semantic & (F.col("policy_evidence") == 0),
            "The untypical route was reproduced but no policy confirms the criterion.",
        )
        .when(
            F.col("verdict") == "REQUIRES_VALIDATION",
            "The signal is reproducible but its confidence or vocabulary coverage is too low.",
        )
        .when(semantic, "A reproducible row and an independent policy confirm the mismatch.")
        .otherwise("A reproducible rule result with checksum and query confirms it.")
    )


def _limitations() -> Column:
    semantic = F.array_contains("tags", "semantic_constraint")
    return F.array_compact(
        F.array(
            F.when(semantic, "rarity_is_not_proof").otherwise("root_cause_not_proven"),
            F.when(semantic & (F.col("policy_evidence") == 0), "no_policy_match"),
            F.when(F.size("source_locations") == 0, "no_source_location"),
            F.when(F.col("confidence") < LOW_CONFIDENCE, "low_confidence"),
            F.when(F.col("partial_vocabulary"), "partial_vocabulary"),
        )
    )


def review_findings(
    findings: DataFrame,
    evidence: DataFrame,
    *,
    applicability: DataFrame | None = None,
    locations: DataFrame | None = None,
) -> DataFrame:
    """Challenge every finding; one verdict each.

    ``applicability`` has rule_id and status, ``locations`` has source_id and
    location.  Order of precedence: no reproducible evidence, no policy for a
    semantic finding, low confidence or partial vocabulary, confirmed.
    """
    sources = evidence_sources(evidence)
    if locations is None:
        placed = sources.withColumn("location", F.lit(None).cast("string"))
    else:
        placed = attach_small(sources, locations.select("source_id", "location"), ["source_id"], "left")
    lists = placed.groupBy("finding_id").agg(
        F.sort_array(F.collect_set("source_id")).alias("sources"),
        F.sort_array(F.collect_set("location")).alias("source_locations"),
    )
    facts = join_on(evidence_facts(evidence), lists, ["finding_id"], "left")
    joined = join_on(findings, facts, ["finding_id"], "left")
    if applicability is None:
        joined = joined.withColumn("partial_vocabulary", F.lit(False))
    else:
        partial = applicability.where("status = 'PARTIAL'").select(
            F.col("rule_id").alias("check_id"), F.lit(True).alias("partial_vocabulary")
        )
        joined = attach_small(joined, partial.distinct(), ["check_id"], "left")
    empty = F.array().cast("array<string>")
    counts = {n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in ("evidence_count", "table_evidence", "policy_evidence")}
    reviewed = (
        joined.withColumns(
            {
                **counts,
                "partial_vocabulary": F.coalesce("partial_vocabulary", F.lit(False)),
                "sources": F.coalesce("sources", empty),
                "source_locations": F.coalesce("source_locations", empty),
            }
        )
        .withColumn("verdict", _verdict())
        .withColumns({"rationale": _rationale(), "limitations": _limitations()})
    )
    return reviewed.select(
        "finding_id", "verdict", "rationale", "evidence_count", "table_evidence", "policy_evidence",
        "limitations", "sources", "source_locations",
    )


def severity_rank(column: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for number, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(column == name, F.lit(number)).otherwise(rank)
    return rank


# What to do about an item, most urgent first.
FINDING_STEPS = (
    "Run the query of the evidence again and compare the source row.",
    "Hold the fact against the criterion and its document.",
    "Establish the root cause on its own; the deviation does not prove it.",
)
ROUTE_STEPS = (
    "Run the reproduction query and compare the untypical route.",
    "Look for a permitted exception in the policy or the code.",
    "Follow the same object through linked operations and measure the effect.",
)
BLOCKED_STEPS = ("Mend the source or the rule and run the audit again.",)


def steps(texts: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def audit_plan(findings: DataFrame, reviews: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One item per finding that was not rejected and one per failed check, with where to look and what to do.

    ``errors`` has position (1-based) and message.
    """
    kept = reviews.where("verdict <> 'REJECTED'").select("finding_id", "verdict", "rationale", "sources", "source_locations")
    items = join_on(findings, kept, ["finding_id"]).select(
        ids.plan_id(F.col("finding_id")).alias("plan_id"),
        F.col("severity").alias("priority"),
        F.when(F.col("verdict") == "CONFIRMED", "CONFIRMED_ISSUE").otherwise("POTENTIAL_RISK").alias("status"),
        "title",
        "rationale",
        "finding_id",
        "sources",
        "source_locations",
        F.when(F.array_contains("tags", "semantic_constraint"), steps(ROUTE_STEPS)).otherwise(steps(FINDING_STEPS)).alias("next_steps"),
    )
    if errors is not None:
        blocked = errors.select(
            F.format_string("PLAN-BLOCKED-%03d", F.col("position")).alias("plan_id"),
            F.lit("HIGH").alias("priority"),
            F.lit("BLOCKED_CHECK").alias("status"),
            F.lit("A check could not be run").alias("title"),
            F.col("message").alias("rationale"),
            F.lit(None).cast("string").alias("finding_id"),
            F.array().cast("array<string>").alias("sources"),
            F.array().cast("array<string>").alias("source_locations"),
            steps(BLOCKED_STEPS).alias("next_steps"),
        )
        items = items.unionByName(blocked)
    return items


def ordered_plan(plan: DataFrame) -> DataFrame:
    return plan.orderBy(severity_rank(F.col("priority")), "plan_id")
