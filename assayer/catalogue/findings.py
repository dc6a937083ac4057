"""Evidence, findings, reviews and plans from exceptions in the given tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import findings as fnd
from ..operators.anomaly import iqr_outliers, zscore_outliers
from ..operators.applicability import rule_applicability
from ..operators.evidence import build_evidence, verify_evidence
from ..operators.report import confirmed_findings, report_digest, run_summary, urgent_counts, verdict_counts
from ..operators.timeline import timeline
from ..plans.run import count_results, execute_rules, rule_results, run_full_audit
from ..scale import freeze
from ..sources.sinks import sink_evidence, sink_run_outputs, stored_evidence
from ..specs import AnomalySpec, FindingTemplate, RuleSpec, SqlSpec, TimelineSpec
from .checks import CONTRADICTION, CONTRADICTION_SQL, STEPS, contradictions
from .registry import query, scratch, table

RUN = "RUN-CATALOGUE"


def _template(title: str, severity: str, confidence: float, issue: str) -> FindingTemplate:
    return FindingTemplate(
        title=title,
        summary=title,
        issue_type=issue,
        root_cause="Not established.",
        criterion="Declared by the rule.",
        risk="Misstatement.",
        severity=severity,
        confidence=confidence,
        tags=("audit",),
    )


CONTRADICTION_RULE = RuleSpec(
    "OPEN_LINE_OF_FINISHED_ORDER",
    "contradiction",
    ("orders", "lineitem"),
    _template("Finished order {o_orderkey} has an open line", "HIGH", 1.0, "contradiction"),
    tags=("orders",),
    max_findings=None,
    sql=CONTRADICTION,
)
ZSCORE_RULE = RuleSpec(
    "EVENT_VALUE",
    "anomaly",
    ("events",),
    _template("Unusual value of event {event_id}", "LOW", 0.6, "statistical_anomaly"),
    max_findings=None,
    anomaly=AnomalySpec("events", "value", ("event_type",), "zscore", 4.0),
)
IQR_RULE = RuleSpec(
    "EVENT_VALUE",
    "anomaly",
    ("events",),
    _template("Unusual value of event {event_id}", "LOW", 0.8, "statistical_anomaly"),
    max_findings=None,
    anomaly=AnomalySpec("events", "value", ("event_type",), "iqr", 3.0),
)
TIMELINE_RULE = RuleSpec(
    "EVENT_ORDER",
    "timeline",
    ("events",),
    _template("Events of user {object_id} are out of order", "MEDIUM", 0.95, "invalid_event_sequence"),
    max_findings=None,
    timeline=TimelineSpec("events", ("user_id",), "ts", "event_type", STEPS, None, ("event_id",)),
)


def _hash(rule: RuleSpec) -> str:
    return hashlib.sha256(rule.contract().encode()).hexdigest()


def _quote(text: str) -> str:
    return text.replace("'", "''")


_EVIDENCE_SQL = f"""
x AS ({CONTRADICTION_SQL}),
ev AS (SELECT o_orderkey, concat('{{"query":"{_quote(CONTRADICTION.query)}","rule_hash":"{_hash(CONTRADICTION_RULE)}",',
  '"rule_id":"OPEN_LINE_OF_FINISHED_ORDER","rule_kind":"contradiction","rule_version":"1","source_ids":["orders","lineitem"],"object_id":"',
  o_orderkey, '"}}|', '{{"o_custkey":', o_custkey, ',"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '"}}') AS content FROM x),
evd AS (SELECT o_orderkey, sha256(content) AS checksum,
  concat('EVD-', upper(substr(sha256(concat('{RUN}:', sha256(content))), 1, 20))) AS evidence_id FROM ev)
"""


def _contradiction_evidence(spark, sf_dir):
    return build_evidence(contradictions(spark, sf_dir), CONTRADICTION_RULE, RUN, "o_orderkey")


@query("build_evidence", f"WITH {_EVIDENCE_SQL} SELECT o_orderkey::VARCHAR AS object_id, checksum, evidence_id FROM evd")
def q_evidence(spark, sf_dir):
    return _contradiction_evidence(spark, sf_dir).select("object_id", "checksum", "evidence_id")


@query("verify_evidence", f"WITH {_EVIDENCE_SQL} SELECT evidence_id, checksum AS expected_checksum, false AS malformed_id FROM evd WHERE o_orderkey % 10 = 0")
def q_verify(spark, sf_dir):
    stored = _contradiction_evidence(spark, sf_dir)
    altered = F.when(F.col("object_id").cast("long") % 10 == 0, F.reverse("checksum")).otherwise(F.col("checksum"))
    return verify_evidence(stored.withColumn("checksum", altered)).select("evidence_id", "expected_checksum", "malformed_id")


@query("sink_evidence", f"WITH {_EVIDENCE_SQL} SELECT evidence_id, checksum, '{RUN}' AS run_id FROM evd")
def q_sink(spark, sf_dir):
    """Written twice; the second time nothing is added."""
    path = scratch(spark)
    evidence = _contradiction_evidence(spark, sf_dir)
    sink_evidence(evidence, path)
    sink_evidence(evidence, path)
    return stored_evidence(spark, path).select("evidence_id", "checksum", "run_id")


@query("finding_id", """
SELECT event_id, concat('FND-', upper(substr(sha256(concat('ZSCORE', '|', 'statistical_anomaly', '|', event_id::VARCHAR)), 1, 16))) AS finding_id FROM events
""")
def q_finding_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        ids.finding_id(F.lit("ZSCORE"), F.lit("statistical_anomaly"), F.col("event_id").cast("string")).alias("finding_id"),
    )


def event_candidates(spark, sf_dir):
    """Two anomaly checks with one id, and the order check by user."""
    events = table(spark, sf_dir, "events")
    z = fnd.rule_candidates(zscore_outliers(events, ZSCORE_RULE.anomaly), ZSCORE_RULE, RUN, "event_id")
    q = fnd.rule_candidates(iqr_outliers(events, IQR_RULE.anomaly), IQR_RULE, RUN, "event_id")
    t = fnd.rule_candidates(timeline(events, TIMELINE_RULE.timeline), TIMELINE_RULE, RUN, "object_id")
    return z.unionByName(q).unionByName(t)


_FINDINGS_SQL = """
z AS (SELECT event_id FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY event_type))
      WHERE sd > 0 AND abs((value - m) / sd) > 4.0),
st AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
q AS (SELECT event_id FROM events e JOIN st ON e.event_type IS NOT DISTINCT FROM st.event_type
      WHERE value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1)),
r AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS er FROM events),
o AS (SELECT *, lag(er) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST) AS pr FROM r),
t AS (SELECT user_id FROM o WHERE er IS NULL OR (pr IS NULL AND er <> 1) OR (pr IS NOT NULL AND (er < pr OR er > pr + 1))),
cand AS (SELECT 'EVENT_VALUE' AS check_id, 'statistical_anomaly' AS issue, event_id::VARCHAR AS object_id, 0.6::DOUBLE AS confidence, 'LOW' AS severity,
                concat('Unusual value of event ', event_id) AS title FROM z
         UNION ALL SELECT 'EVENT_VALUE', 'statistical_anomaly', event_id::VARCHAR, 0.8, 'LOW', concat('Unusual value of event ', event_id) FROM q
         UNION ALL SELECT 'EVENT_ORDER', 'invalid_event_sequence', user_id::VARCHAR, 0.95, 'MEDIUM', concat('Events of user ', user_id, ' are out of order') FROM t),
f AS (SELECT concat('FND-', upper(substr(sha256(concat(check_id, '|', issue, '|', object_id)), 1, 16))) AS finding_id,
             check_id, object_id, max(confidence) AS confidence, any_value(severity) AS severity, any_value(title) AS title, count(*) AS evidence_count
      FROM cand GROUP BY check_id, issue, object_id)
"""


@query("dedupe_findings", f"WITH {_FINDINGS_SQL} SELECT finding_id, check_id, object_id, confidence, severity, title, evidence_count FROM f")
def q_dedupe(spark, sf_dir):
    candidates = freeze(event_candidates(spark, sf_dir))
    counts = fnd.evidence_facts(fnd.finding_evidence(candidates))
    return (
        fnd.dedupe_findings(candidates)
        .join(counts, "finding_id")
        .select("finding_id", "check_id", "object_id", "confidence", "severity", "title", "evidence_count")
    )


def reviewed(spark, sf_dir):
    """Reviews where order findings of even users lost their evidence and the vocabulary is partial."""
    candidates = freeze(event_candidates(spark, sf_dir))
    findings, evidence = freeze(fnd.dedupe_findings(candidates)), fnd.finding_evidence(candidates)
    stripped = (F.col("source_name") == "events") & (F.col("object_id").cast("long") % 2 == 0) & (
        F.col("description").contains("EVENT_ORDER")
    )
    evidence = evidence.withColumn("checksum", F.when(~stripped, F.col("checksum")))
    events = table(spark, sf_dir, "events")
    fit = rule_applicability(events, TIMELINE_RULE).select("rule_id", "status")
    places = spark.createDataFrame([("events", "events.parquet")], "source_id string, location string")
    evidence = freeze(evidence)
    return findings, evidence, freeze(fnd.review_findings(findings, evidence, applicability=fit, locations=places))


_REVIEW_SQL = f"""{_FINDINGS_SQL},
rv AS (SELECT *, CASE WHEN check_id = 'EVENT_ORDER' AND object_id::BIGINT % 2 = 0 THEN 'REJECTED'
    WHEN confidence < 0.75 OR (check_id = 'EVENT_ORDER' AND EXISTS (SELECT 1 FROM events WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase') OR event_type IS NULL))
    THEN 'REQUIRES_VALIDATION' ELSE 'CONFIRMED' END AS verdict FROM f),
pl AS (SELECT concat('PLAN-', upper(substr(sha256(finding_id), 1, 12))) AS plan_id, severity AS priority,
    CASE WHEN verdict = 'CONFIRMED' THEN 'CONFIRMED_ISSUE' ELSE 'POTENTIAL_RISK' END AS status, title, finding_id, object_id, check_id, verdict FROM rv WHERE verdict <> 'REJECTED')
"""


@query("review_findings", f"""WITH {_REVIEW_SQL} SELECT finding_id, verdict, evidence_count,
  CASE WHEN verdict = 'REJECTED' THEN 0 ELSE evidence_count END AS table_evidence, 'events' AS sources, 'events.parquet' AS source_locations,
  concat('root_cause_not_proven', CASE WHEN confidence < 0.75 THEN ',low_confidence' ELSE '' END,
    CASE WHEN check_id = 'EVENT_ORDER' THEN ',partial_vocabulary' ELSE '' END) AS limitations FROM rv""")
def q_review(spark, sf_dir):
    _, _, reviews = reviewed(spark, sf_dir)
    return reviews.select(
        "finding_id", "verdict", "evidence_count", "table_evidence",
        *[F.array_join(c, ",").alias(c) for c in ("sources", "source_locations", "limitations")],
    )


@query("audit_plan", f"""WITH {_REVIEW_SQL} SELECT plan_id, priority, status, title, finding_id, 'events.parquet' AS source_locations,
  'Run the query of the evidence again and compare the source row.' AS action, 3::BIGINT AS n_steps FROM pl
UNION ALL SELECT 'PLAN-BLOCKED-001', 'HIGH', 'BLOCKED_CHECK', 'A check could not be run', NULL, '', 'Mend the source or the rule and run the audit again.', 1""")
def q_plan(spark, sf_dir):
    findings, _, reviews = reviewed(spark, sf_dir)
    errors = spark.createDataFrame([(1, "x: no such source")], "position int, message string")
    return fnd.ordered_plan(fnd.audit_plan(findings, reviews, errors)).select(
        "plan_id", "priority", "status", "title", "finding_id", F.array_join("source_locations", ",").alias("source_locations"),
        F.element_at("next_steps", 1).alias("action"), F.size("next_steps").cast("long").alias("n_steps"),
    )


@query("report_digest", f"""WITH {_REVIEW_SQL},
b AS (SELECT *, rtrim(regexp_replace(replace(title, object_id, ''), '[\\s:-]+$', '')) AS bare FROM pl)
SELECT priority, status, bare AS title, count(*) AS cases, min(plan_id) AS first_plan_id,
  'Run the query of the evidence again and compare the source row.' AS action, array_to_string(list(object_id ORDER BY plan_id)[1:3], ', ') AS examples
FROM b GROUP BY priority, status, bare""")
def q_digest(spark, sf_dir):
    findings, _, reviews = reviewed(spark, sf_dir)
    digest = report_digest(fnd.audit_plan(findings, reviews), findings)
    return digest.select("priority", "status", "title", "action", "cases", "first_plan_id", "examples")


@query("verdict_counts", f"""WITH {_REVIEW_SQL} SELECT count(*) AS signals, count(*) FILTER (WHERE verdict = 'CONFIRMED') AS confirmed,
  count(*) FILTER (WHERE verdict = 'REQUIRES_VALIDATION') AS requires_validation, count(*) FILTER (WHERE verdict = 'REJECTED') AS rejected FROM rv""")
def q_verdicts(spark, sf_dir):
    return verdict_counts(reviewed(spark, sf_dir)[2])


@query("confirmed_findings", f"WITH {_REVIEW_SQL} SELECT finding_id, severity, confidence FROM rv WHERE verdict = 'CONFIRMED'")
def q_confirmed(spark, sf_dir):
    findings, _, reviews = reviewed(spark, sf_dir)
    return confirmed_findings(findings, reviews).select("finding_id", "severity", "confidence")


@query("urgent_counts", f"""WITH {_REVIEW_SQL} SELECT count(*) AS confirmed,
  count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS high_or_critical FROM rv WHERE verdict = 'CONFIRMED'""")
def q_urgent(spark, sf_dir):
    findings, _, reviews = reviewed(spark, sf_dir)
    return urgent_counts(findings, reviews)


def _rule_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    z = zscore_outliers(events, ZSCORE_RULE.anomaly).select(F.lit("ZSCORE").alias("rule_id"))
    t = timeline(events, TIMELINE_RULE.timeline).select(F.lit("ORDER").alias("rule_id"))
    c = contradictions(spark, sf_dir).select(F.lit("CONTRADICTION").alias("rule_id"))
    n = events.where("event_id IS NULL").select(F.lit("NO_ID").alias("rule_id"))
    rules = spark.createDataFrame([("ZSCORE",), ("ORDER",), ("CONTRADICTION",), ("NO_ID",)], "rule_id string")
    return z.unionByName(t).unionByName(c).unionByName(n), rules


@query("rule_results", f"""WITH {_FINDINGS_SQL}, x AS ({CONTRADICTION_SQL}),
k AS (SELECT 'ZSCORE' AS rule_id, (SELECT count(*) FROM z) AS n UNION ALL SELECT 'ORDER', (SELECT count(*) FROM t)
  UNION ALL SELECT 'CONTRADICTION', (SELECT count(*) FROM x) UNION ALL SELECT 'NO_ID', (SELECT count(*) FROM events WHERE event_id IS NULL))
SELECT rule_id, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS evaluated_rows, n AS findings_count, false AS truncated FROM k""")
def q_rule_results(spark, sf_dir):
    exceptions, rules = _rule_rows(spark, sf_dir)
    return count_results(exceptions, rules)


@query("run_summary", f"""WITH {_REVIEW_SQL} SELECT (SELECT count(*) FROM f) AS findings_count,
  (SELECT count(*) FROM rv WHERE verdict = 'CONFIRMED') AS confirmed_findings_count,
  (SELECT count(*) FROM pl WHERE status = 'POTENTIAL_RISK') AS potential_risks_count, (SELECT count(*) FROM pl) AS audit_plan_items_count,
  0::BIGINT AS execution_errors_count, 3::BIGINT AS executed_rules_count,
  (SELECT sum(evidence_count)::BIGINT FROM f) AS evidence_count""")
def q_summary(spark, sf_dir):
    findings, evidence, reviews = reviewed(spark, sf_dir)
    results = spark.createDataFrame([("A", "FAIL"), ("B", "FAIL"), ("C", "FAIL")], "rule_id string, status string")
    return run_summary(findings, reviews, fnd.audit_plan(findings, reviews), results, evidence)


@query("execute_rules", f"""WITH {_FINDINGS_SQL}, x AS ({CONTRADICTION_SQL}),
k AS (SELECT 'OPEN_LINE_OF_FINISHED_ORDER' AS rule_id, (SELECT count(*) FROM x) AS n UNION ALL SELECT 'EVENT_VALUE', (SELECT count(*) FROM z)
  UNION ALL SELECT 'EVENT_ORDER', (SELECT count(*) FROM t))
SELECT rule_id, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS evaluated_rows, n AS findings_count, false AS truncated, false AS failed FROM k
UNION ALL SELECT 'BROKEN', 'ERROR', 0, 0, false, true""")
def q_execute(spark, sf_dir):
    """A rule that cannot run becomes an error result; the others are not affected."""
    sources = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")}
    broken = RuleSpec("BROKEN", "sql", ("events",), CONTRADICTION_RULE.finding, sql=SqlSpec("SELECT no_such_column FROM {{events}}"))
    outcomes = execute_rules(spark, [*AUDIT_RULES, broken], sources, run_id=RUN)
    results = rule_results(spark, outcomes)
    return results.select(
        "rule_id", "status", "evaluated_rows", "findings_count", "truncated", F.col("error").isNotNull().alias("failed")
    )


AUDIT_RULES = (CONTRADICTION_RULE, ZSCORE_RULE, TIMELINE_RULE)
_AUDIT_SQL = f"""WITH {_FINDINGS_SQL}, x AS ({CONTRADICTION_SQL}),
k AS (SELECT (SELECT count(*) FROM z) AS nz, (SELECT count(DISTINCT user_id) FROM t) AS nu, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM x) AS nx)
"""


@query("run_full_audit", _AUDIT_SQL + """
SELECT nx + nz + nu AS findings_count, nx AS confirmed_findings_count, nz + nu AS potential_risks_count, nx + nz + nu AS audit_plan_items_count,
  0::BIGINT AS execution_errors_count, 3::BIGINT AS executed_rules_count, nx + nz + nt AS evidence_count FROM k""")
def q_full_audit(spark, sf_dir):
    sources = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")}
    return run_full_audit(spark, sources, AUDIT_RULES, run_id=RUN, infer=False).summary


@query("sink_run_outputs", _AUDIT_SQL + """
SELECT 'RUN-CATALOGUE' AS run_id, 'findings' AS table_name, nx + nz + nu AS row_count FROM k
UNION ALL SELECT 'RUN-CATALOGUE', 'plan', nx + nz + nu FROM k
UNION ALL SELECT 'RUN-CATALOGUE', 'evidence', nx + nz + nt FROM k""")
def q_outputs(spark, sf_dir):
    sources = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")}
    run = run_full_audit(spark, sources, AUDIT_RULES, run_id=RUN, infer=False)
    tables = {k: v for k, v in run.tables().items() if k in ("findings", "plan", "evidence")}
    return sink_run_outputs(run.run_id, tables, scratch(spark)).select("run_id", "table_name", "row_count")
