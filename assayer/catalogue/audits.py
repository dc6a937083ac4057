"""Whole runs: inference, rules, grounding in documents, reviews and plan together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evidence import verify_evidence
from ..operators.retrieval import HashingEmbedder
from ..plans.run import AuditRun, run_full_audit
from ..scale import join_on, union_all
from .findings import _FINDINGS_SQL, IQR_RULE, RUN, TIMELINE_RULE, ZSCORE_RULE
from .links import _DOC_PAIRS, relationship_sql
from .registry import query, table
from .retrieval import chunk_index

EVENT_RULES = (ZSCORE_RULE, IQR_RULE, TIMELINE_RULE)


def whole_run(spark, sf_dir) -> AuditRun:
    sources = {n: table(spark, sf_dir, n) for n in ("events", "documents", "labels")}
    return run_full_audit(
        spark, sources, EVENT_RULES, run_id=RUN, chunks=chunk_index(spark, sf_dir), make_embedder=HashingEmbedder
    )


# In a run an anomaly is a finding of its own for each check, known by its whole row.
_RUN_SQL = f"""{_FINDINGS_SQL}, g AS (SELECT check_id, object_id AS object, confidence, severity, count(*) AS evidence_count FROM cand GROUP BY ALL)"""


@query("run_full_audit_findings", f"""WITH {_RUN_SQL}
SELECT check_id, object, confidence, severity, CASE WHEN requires THEN 'REQUIRES_VALIDATION' ELSE 'CONFIRMED' END AS verdict,
  CASE WHEN requires THEN 'POTENTIAL_RISK' ELSE 'CONFIRMED_ISSUE' END AS plan_status, evidence_count AS table_evidence,
  evidence_count AS verified_evidence, evidence_count + 3 AS reference_count, true AS grounded
FROM (SELECT *, confidence < 0.75 OR (check_id = 'EVENT_ORDER' AND EXISTS (
  SELECT 1 FROM events WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase') OR event_type IS NULL)) AS requires FROM g)""")
def q_whole_findings(spark, sf_dir):
    """Every finding with its verdict, its place in the plan, and how many of its evidence records hold."""
    run = whole_run(spark, sf_dir)
    sound = join_on(run.evidence.select("evidence_id"), verify_evidence(run.evidence).select("evidence_id"), ["evidence_id"], "left_anti").distinct()
    references = run.finding_evidence.select("finding_id", "evidence_id")
    known = join_on(references, sound.withColumn("sound", F.lit(1)), ["evidence_id"], "left")
    counts = known.groupBy("finding_id").agg(F.count("*").alias("reference_count"), F.count("sound").alias("verified_evidence"))
    plan = run.plan.select("finding_id", F.col("status").alias("plan_status"))
    reviews = run.reviews.select("finding_id", "verdict", "table_evidence")
    found = run.findings.select(
        "finding_id", "check_id", "confidence", "severity", F.array_contains("tags", "rag_grounded").alias("grounded"),
        F.when(F.col("check_id") == "EVENT_VALUE", F.get_json_object("facts", "$.event_id")).otherwise(F.col("object_id")).alias("object"),
    )
    for part in (reviews, plan, counts):
        found = join_on(found, part, ["finding_id"], "left")
    return found.drop("finding_id")


@query("run_full_audit_tables", f"""WITH {_RUN_SQL}, n AS (SELECT count(*) AS findings, sum(evidence_count)::BIGINT AS records FROM g)
SELECT 'findings' AS table_name, findings AS row_count FROM n
UNION ALL SELECT 'reviews', findings FROM n UNION ALL SELECT 'plan', findings FROM n UNION ALL SELECT 'evidence', records FROM n
UNION ALL SELECT 'finding_evidence', records + 3 * findings FROM n UNION ALL SELECT 'rule_results', 3 UNION ALL SELECT 'applicability', 1
UNION ALL SELECT 'profiles', (SELECT count(*) FROM (DESCRIBE events)) + (SELECT count(*) FROM (DESCRIBE documents)) + (SELECT count(*) FROM (DESCRIBE labels))
UNION ALL SELECT 'relationships', (SELECT count(*) FROM ({relationship_sql(_DOC_PAIRS)}))
UNION ALL SELECT 'lineage', (SELECT count(*) FROM ({relationship_sql(_DOC_PAIRS)}) WHERE dependency_type = 'join_key_candidate' AND confidence >= 0.8)
""")
def q_whole_tables(spark, sf_dir):
    """The size of every table that a run returns, but for its log and its one-row summary."""
    tables = {k: v for k, v in whole_run(spark, sf_dir).tables().items() if k not in ("events", "summary")}
    return union_all(df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items())
