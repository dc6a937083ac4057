"""Evidence, findings, reviews, outliers, lineage and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from assayer import FindingTemplate, RelationshipSpec, RuleSpec, run_full_audit, run_rule, run_rule_group
from assayer.functions import ids
from assayer.operators import findings as fnd
from assayer.operators import hypotheses as hyp
from assayer.operators import outliers as out
from assayer.operators.evidence import build_evidence, get_evidence, verify_evidence
from assayer.operators.grounding import ground_findings, semantic_constraint_match
from assayer.operators.lineage import declared_edges, impact_paths, lineage_edges
from assayer.operators.profile import profile_table
from assayer.operators.relationships import infer_relationships
from assayer.operators.report import report_digest
from assayer.operators.retrieval import HashingEmbedder, embed
from assayer.plans.run import analyze_business_logic, list_data_sources, select_rules
from assayer.scale import union_all
from assayer.specs import AnomalySpec, ReconcileSpec, SourceSpec, SqlSpec, TimelineSpec

TEXTS = FindingTemplate("Order {id} over limit", "{v}", "limit", "?", "c", "r", "HIGH", confidence=0.9, tags=("t",))
RULE = RuleSpec("LIMIT", "sql", ("t",), TEXTS, tags=("limits",), sql=SqlSpec("SELECT * FROM {{t}} WHERE v > 2", "id"))

FINDING = (
    "finding_id string, check_id string, issue_type string, object_id string, title string, summary string, root_cause string, "
    "criterion string, risk string, recommendation string, severity string, facts string, tags array<string>, "
    "hypothesis_id string, confidence double"
)
REFERENCE = (
    "finding_id string, evidence_id string, checksum string, source_name string, object_id string, description string, "
    "fields string, query string, constraint_match boolean"
)


def _finding(spark, confidence=0.9, tags=(), facts="{}", finding_id="FND-TEST"):
    row = (finding_id, "CHECK-1", "i", "row-1", "Balance mismatch", "s", "c", "Balances must agree", "r", None, "HIGH", facts, list(tags), None, confidence)
    return spark.createDataFrame([row], FINDING)


def _reference(spark, source="ledger", finding_id="FND-TEST"):
    return spark.createDataFrame([(finding_id, "EVD-1", "abc", source, "row-1", "d", "{}", "SELECT 1", False)], REFERENCE)


def test_evidence_round_trip(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, None)], "id long, v double")
    evidence = build_evidence(df, RULE, "RUN-1", "id")
    rows = evidence.collect()
    assert rows[0]["evidence_id"] == rows[1]["evidence_id"] != rows[2]["evidence_id"]
    assert json.loads(rows[2]["result"]) == {"id": 2, "v": None}
    assert verify_evidence(evidence).count() == 0
    altered = evidence.withColumn("result", F.replace("result", F.lit("5.0"), F.lit("6.0")))
    assert verify_evidence(altered).count() == 2
    assert get_evidence(evidence.dropDuplicates(), "RUN-1", rows[0]["evidence_id"]).count() == 1
    with pytest.raises(ValueError):
        get_evidence(evidence, "RUN-1", "EVD-1")
    unnamed = build_evidence(df, RULE, "RUN-1").first()["object_id"]
    assert len(unnamed) == 20


def test_finding_id(spark):
    value = spark.range(1).select(ids.finding_id(F.lit("ZSCORE"), F.lit("statistical_anomaly"), F.lit("1"))).first()[0]
    assert value == "FND-90F9A45F0CA3809C"


def test_uuid5_equals_the_standard_library(spark):
    import uuid

    keys = [f"source:{i}:é" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", ids.uuid5(F.col("k")).alias("u"))
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["k"])) for r in df.collect())


def test_dedupe_keeps_the_highest_confidence(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 9.0)], "id long, v double")
    low = fnd.rule_candidates(df, RULE, "R", "id")
    high = low.withColumn("confidence", F.lit(1.0)).where("object_id = '1'")
    candidates = low.unionByName(high)
    findings = {r["object_id"]: r for r in fnd.ordered_findings(fnd.dedupe_findings(candidates)).collect()}
    assert findings["1"]["confidence"] == 1.0 and findings["1"]["title"] == "Order 1 over limit"
    assert fnd.finding_evidence(candidates).count() == 3


def test_review_and_plan(spark):
    places = spark.createDataFrame([("ledger", "/data/ledger.csv")], "source_id string, location string")
    sure = _finding(spark)
    reviews = fnd.review_findings(sure, _reference(spark), locations=places)
    row = reviews.first()
    assert (row["verdict"], row["source_locations"], row["sources"]) == ("CONFIRMED", ["/data/ledger.csv"], ["ledger"])
    item = fnd.audit_plan(sure, reviews).first()
    assert (item["status"], item["next_steps"], item["source_locations"]) == ("CONFIRMED_ISSUE", list(fnd.FINDING_STEPS), ["/data/ledger.csv"])
    semantic = sure.withColumn("tags", F.array(F.lit("semantic_constraint")))
    assert fnd.audit_plan(semantic, reviews).first()["next_steps"] == list(fnd.ROUTE_STEPS)
    both = fnd.audit_plan(sure, reviews).unionByName(fnd.audit_plan(semantic, reviews))
    assert [(r["action"], r["cases"]) for r in report_digest(both, sure).orderBy("action").collect()] == [(s[0], 1) for s in (fnd.FINDING_STEPS, fnd.ROUTE_STEPS)]
    weak = _finding(spark, 0.6)
    reviews = fnd.review_findings(weak, _reference(spark))
    assert reviews.first()["verdict"] == "REQUIRES_VALIDATION"
    assert set(reviews.first()["limitations"]) == {"root_cause_not_proven", "no_source_location", "low_confidence"}
    assert fnd.audit_plan(weak, reviews).first()["status"] == "POTENTIAL_RISK"
    bare = _reference(spark).withColumn("query", F.lit(None).cast("string"))
    assert fnd.review_findings(sure, bare).first()["verdict"] == "REJECTED"
    assert fnd.review_findings(sure, bare.where("false")).first()["verdict"] == "REJECTED"
    partial = spark.createDataFrame([("CHECK-1", "PARTIAL")], "rule_id string, status string")
    assert fnd.review_findings(sure, _reference(spark), applicability=partial).first()["verdict"] == "REQUIRES_VALIDATION"


def _chunks(spark, text, source="policy"):
    df = spark.createDataFrame([("chunk-1", source, text)], "chunk_id string, source_id string, text string")
    return embed(df, "text", HashingEmbedder)


def test_grounding_attaches_documents(spark):
    findings, references = ground_findings(
        _finding(spark), _chunks(spark, "The balance must be reconciled daily."), HashingEmbedder, request="Check balances"
    )
    assert "rag_grounded" in findings.first()["tags"]
    both = references.unionByName(_reference(spark))
    assert both.count() == 2 and references.first()["source_name"] == "policy"
    assert fnd.review_findings(findings, both).first()["verdict"] == "CONFIRMED"


def test_only_a_matching_policy_confirms_a_semantic_finding(spark):
    facts = json.dumps({
        "context": '{"event_type":"TRANSFER_TO_SETTLEMENT"}', "expected": {"account_class": "SETTLEMENT"}, "actual": {"account_class": "SPECULATIVE"},
    })
    finding = _finding(spark, 0.95, ("semantic_constraint",), facts)
    norm = "For event TRANSFER_TO_SETTLEMENT the target must have class SETTLEMENT."
    for text, verdict in ((norm, "CONFIRMED"), (norm.replace("must", "may"), "REQUIRES_VALIDATION"), ("must", "REQUIRES_VALIDATION")):
        tagged, references = ground_findings(finding, _chunks(spark, text), HashingEmbedder)
        row = fnd.review_findings(tagged, references.unionByName(_reference(spark))).first()
        assert row["verdict"] == verdict, text


def test_constraint_match(spark):
    df = spark.createDataFrame([("Account\n MUST   be Settlement", ["settlement", "x"], ["account"])], "t string, e array<string>, c array<string>")
    assert df.select(semantic_constraint_match(F.col("t"), F.col("e"), F.col("c"))).first()[0]
    assert not df.select(semantic_constraint_match(F.col("t"), F.array(F.lit("x")), F.col("c"))).first()[0]


def _routes(spark):
    rules = spark.createDataFrame(
        [(f"R{i}", f"A{i}", "PHYSICAL" if i <= 10 else "NON_CASH", "2026-01-01") for i in range(1, 12)],
        "rule_id string, target_account_id string, asset_class string, valid_from string",
    )
    accounts = spark.createDataFrame(
        [(f"A{i}", "PHYSICAL" if i <= 9 else "NON_CASH") for i in range(1, 12)], "account_id string, asset_class string"
    )
    events = spark.createDataFrame([(f"E{i}", f"R{i}") for i in range(1, 12)], "event_id string, mapping_rule_id string")
    return {"routing_rules": rules, "account_reference": accounts, "processed_events": events}


def test_untypical_route_is_found_and_promoted(spark):
    sources = _routes(spark)
    run = run_full_audit(spark, sources, [], run_id="RUN-NEUTRAL")
    (h,) = run.hypotheses.collect()
    assert (h["mapping_source"], h["reference_source"], h["attribute"]) == ("routing_rules", "account_reference", "asset_class")
    assert (h["mismatch_rows"], h["joined_rows"], h["pattern"], h["investigation"]) == (1, 10, "OUTLIER", "PROMOTED_TO_FINDING")
    assert (h["object_id"], h["expected_value"], h["actual_value"]) == ("R10", "PHYSICAL", "NON_CASH")
    assert json.loads(h["sample"])["target_account_id"] == "A10"
    (finding,) = run.findings.collect()
    assert finding["check_id"] == hyp.CHECK_ID and "material_business_hypothesis" in finding["tags"]
    assert json.loads(finding["facts"])["actual"] == {"asset_class": "NON_CASH"}
    assert run.reviews.first()["verdict"] == "REQUIRES_VALIDATION"
    summary = hyp.coverage_summary(run.coverage).first()
    assert summary["complete"] and summary["unresolved_count"] == 1
    assert [r["status"] for r in run.plan.collect()] == ["POTENTIAL_RISK"]
    assert run.paths.where("target = 'processed_events'").count() == 1
    missing = hyp.hypothesis_coverage(
        spark.createDataFrame([("BIZ-1",)], "hypothesis_id string"),
        run.coverage.select("hypothesis_id", "finding_id").where("false"),
        run.reviews,
    )
    assert missing.first()["verdict"] == "MISSING_FINDING" and not hyp.coverage_summary(missing).first()["complete"]


def test_selections_run_on_the_sources_as_they_are(spark):
    sources = _routes(spark)
    profiles = union_all(profile_table(df, name) for name, df in sources.items())
    found = analyze_business_logic(spark, sources, profiles, infer_relationships(sources)).hypotheses

    def status(**changed):
        done = hyp.investigate_hypotheses(found, sources | changed, run_id="R")
        (row,) = done.hypotheses.collect()
        assert done.evidence.count() == (row["investigation"] == "PROMOTED_TO_FINDING")
        assert verify_evidence(done.evidence).isEmpty()
        return row["investigation"], row["reproduced_rows"], row["error"]

    accounts = sources["account_reference"]
    assert status() == ("PROMOTED_TO_FINDING", 1, None)
    mended = accounts.withColumn("asset_class", F.when(F.col("account_id") == "A10", "PHYSICAL").otherwise(F.col("asset_class")))
    assert status(account_reference=mended) == ("NOT_REPRODUCED", 0, None)
    worse = accounts.withColumn("asset_class", F.lit("NON_CASH"))
    assert status(account_reference=worse)[:2] == ("PROMOTED_TO_FINDING", 10)
    assert status(account_reference=accounts.drop("asset_class"))[0] == "ERROR"
    failing = accounts.withColumn("asset_class", F.raise_error(F.lit("unreadable")).cast("string"))
    assert status(account_reference=failing)[0] == "ERROR"
    lost = hyp.investigate_hypotheses(found, {"routing_rules": sources["routing_rules"]}, run_id="R").hypotheses.first()
    assert lost["investigation"] == "ERROR" and "account_reference" in lost["error"]
    low = hyp.investigate_hypotheses(found, sources, run_id="R", minimum_confidence=0.999).hypotheses.first()
    assert low["investigation"] == "BELOW_MATERIALITY_THRESHOLD" and low["finding_id"] is None


def test_every_reference_of_a_run_is_a_stored_record(spark):
    sources = _routes(spark)
    rule = RuleSpec("ALL", "sql", ("processed_events",), FindingTemplate("E {event_id}", "s", "i", "r", "c", "k", "LOW"),
                    sql=SqlSpec("SELECT * FROM {{processed_events}}", "event_id"))
    chunks = _chunks(spark, "For asset_class PHYSICAL the target must be PHYSICAL.")
    run = run_full_audit(spark, sources, [rule], run_id="RUN-1", chunks=chunks, make_embedder=HashingEmbedder)
    assert verify_evidence(run.evidence).isEmpty() and run.evidence.count() == 12
    stored = run.evidence.select("evidence_id", "checksum")
    rows = run.finding_evidence.where("NOT constraint_match AND query IS NOT NULL").join(stored, ["evidence_id", "checksum"], "left_anti")
    assert [r for r in rows.collect() if r["evidence_id"] and r["evidence_id"].startswith("EVD-")] == []
    assert run.hypotheses.first()["record"]["evidence_id"] in {r["evidence_id"] for r in run.evidence.collect()}


def test_first_rule_gives_the_texts(spark):
    df = spark.createDataFrame([(1, 5.0)] * 5 + [(1, 7.0), (2, 9.0)], "id long, v double")
    later = fnd.rule_candidates(df, RULE, "R", "id", 1).withColumn("title", F.lit("later"))
    findings = fnd.dedupe_findings(later.unionByName(fnd.rule_candidates(df, RULE, "R", "id", 0)))
    assert {r["title"] for r in findings.collect()} == {"Order 1 over limit", "Order 2 over limit"} and findings.count() == 2
    assert "SortAggregate" not in findings._jdf.queryExecution().toString()


def _route(**kwargs):
    return out.RouteSpec("m", "target_id", "r", "ref_id", ("type_a", "type_b"), ("class_x", "class_y"), ("rule_id",), **kwargs)


def _route_tables(spark, rows):
    mapping = spark.createDataFrame([(i, i, a, b) for i, (a, b, _, _) in enumerate(rows)], "rule_id long, target_id long, type_a string, type_b string")
    reference = spark.createDataFrame([(i, x, y) for i, (_, _, x, y) in enumerate(rows)], "ref_id long, class_x string, class_y string")
    return mapping, reference


def test_outlier_thresholds_and_merge(spark):
    rows = [("a", "p", "X", None)] * 9 + [("a", "p", "Z", "Y")] + [("b", "p", "X", None)] * 4
    mapping, reference = _route_tables(spark, rows)
    minority = out.minority_rows(mapping, reference, _route())
    candidates = out.contextual_outliers(minority, _route()).collect()
    # share 0.9 counts; NULL is a dominant value; the group of four is too small to judge
    assert {(c["context"], c["attribute"]) for c in candidates} == {
        (context, attribute)
        for context in ('{"type_a":"a"}', '{"type_b":"p"}', '{"type_a":"a","type_b":"p"}')
        for attribute in ("class_x", "class_y")
    }
    assert all(c["mismatch_rows"] == 1 for c in candidates)
    (merged,) = out.merge_outlier_candidates(out.contextual_outliers(minority, _route()), _route()).collect()
    assert merged["attribute"] == "class_x, class_y" and merged["outlier_attributes"] == {"class_x": "X", "class_y": None}
    assert merged["context"] == '{"type_a":"a","type_b":"p"}' and merged["confidence"] == 0.9
    assert out.minority_rows(mapping, reference, _route(min_share=0.95)).count() == 0


def test_no_mapping_table_no_hypothesis(spark):
    sources = _routes(spark)
    sources["routing_rules"] = sources["routing_rules"].drop("valid_from")
    profiles = None
    for name, df in sources.items():
        part = profile_table(df, name)
        profiles = part if profiles is None else profiles.unionByName(part)
    analysis = analyze_business_logic(spark, sources, profiles, infer_relationships(sources))
    assert analysis.hypotheses is None and analysis.lineage.count() == 2


def _bfs(edges, seed, depth):
    """All simple paths whose every prefix is a shortest one."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best, level, found = {seed: 0}, [(seed,)], set()
    for d in range(1, depth + 1):
        level = [p + (n,) for p in level for n in near.get(p[-1], ()) if n not in p and best.get(n, d) >= d]
        for p in level:
            best[p[-1]] = d
        found |= set(level)
    return found


def test_paths_equal_breadth_first_search(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("b", "c"), ("d", "b")]
    links = [RelationshipSpec(f"r{i}", a, b, (("x", "y"), ("x2", "y2"))) for i, (a, b) in enumerate(pairs)]
    edges = lineage_edges(declared_edges(spark, links), None)
    seeds = spark.createDataFrame([("a",), ("e",)], "seed string")
    for bound, depth in ((None, len(pairs)), (4, 4), (1, 1)):
        rows = impact_paths(edges, seeds, max_depth=bound).collect()
        for seed in ("a", "e"):
            mine = [tuple(r["sources"]) for r in rows if r["seed"] == seed]
            assert len(mine) == len(set(mine)) and set(mine) == _bfs(pairs, seed, depth)
    assert impact_paths(edges, spark.createDataFrame([("nowhere",)], "seed string")).count() == 0
    assert impact_paths(edges, seeds, max_paths=3).count() == 6


def test_lineage_prefers_declared_edges(spark):
    declared = declared_edges(spark, [RelationshipSpec("r", "a", "b", (("x", "y"),))])
    inferred = spark.createDataFrame(
        [("a", "x", "b", "y", "join_key_candidate", 1.0), ("a", "x", "c", "y", "join_key_candidate", 0.79), ("a", "q", "c", "q", "shared_domain_candidate", 1.0)],
        "left_source string, left_column string, right_source string, right_column string, dependency_type string, confidence double",
    )
    assert [r["basis"] for r in lineage_edges(declared, inferred).collect()] == ["declared_relationship"]


def _rules():
    timeline = TimelineSpec("t", ("id",), "ts", "kind", ("A", "B"))
    return [
        RULE,
        RuleSpec("ORDER", "timeline", ("t",), TEXTS, tags=("limits",), timeline=timeline),
        RuleSpec("BROKEN", "sql", ("t",), TEXTS, tags=("other",), sql=SqlSpec("SELECT nope FROM {{t}}")),
        RuleSpec("CUT", "anomaly", ("t",), TEXTS, tags=("stat",), max_findings=1, anomaly=AnomalySpec("t", "v", (), "iqr", 0.01)),
        RuleSpec("SUMS", "reconciliation", ("t", "u"), TEXTS, tags=("stat",), reconciliation=ReconcileSpec("rel", "v", "w")),
        RuleSpec("OFF", "sql", ("t",), TEXTS, enabled=False, sql=SqlSpec("SELECT * FROM {{t}}")),
    ]


def _table(spark):
    rows = [(i, float(i), "2024-01-01 00:00:00", "unknown") for i in range(6)]
    return spark.createDataFrame(rows, "id long, v double, ts string, kind string")


def test_run_isolates_errors_and_reports_status(spark):
    run = run_full_audit(spark, {"t": _table(spark)}, _rules(), run_id="R-1", infer=False)
    results = {r["rule_id"]: r for r in run.rule_results.collect()}
    assert {k: v["status"] for k, v in results.items()} == {"LIMIT": "FAIL", "ORDER": "ERROR", "BROKEN": "ERROR", "CUT": "FAIL"}
    assert results["ORDER"]["evaluated_rows"] == 6 and "coverage 0.0%" in results["ORDER"]["error"]
    cut = results["CUT"]
    assert cut["truncated"] and cut["findings_count"] == 1 and cut["evaluated_rows"] > 1
    assert results["LIMIT"]["findings_count"] == 3 and not results["LIMIT"]["truncated"]
    fit = run.tables()["applicability"].first()
    assert (fit["status"], fit["observed_values"]) == ("INCOMPATIBLE", '[{"value":"unknown","rows_count":6,"mapped":false}]')
    assert run.status == "COMPLETED_WITH_ERRORS"
    plan = run.plan.collect()
    assert [p["status"] for p in plan].count("BLOCKED_CHECK") == 3  # two failed rules and one without its source
    summary = run.summary.first()
    assert (summary["findings_count"], summary["evidence_count"], summary["execution_errors_count"]) == (4, 4, 2)
    assert run.events.where("event = 'rule_completed' AND level = 'ERROR'").count() == 2
    assert verify_evidence(run.evidence).count() == 0


def test_run_one_rule_and_a_group(spark):
    sources = {"t": _table(spark)}
    assert run_rule(spark, sources, _rules(), "LIMIT").findings.count() == 3
    assert run_rule_group(spark, sources, _rules(), "stat").rule_results.count() == 1
    for bad in (lambda: run_rule(spark, sources, _rules(), "OFF"), lambda: run_rule_group(spark, sources, _rules(), "none")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        run_rule(spark, sources, _rules(), "LIMIT", run_id="bad id")


def test_rule_selection(spark):
    rules = _rules()
    assert [r.rule_id for r in select_rules(spark, rules, "only BROKEN rules please")] == ["BROKEN"]
    assert [r.rule_id for r in select_rules(spark, rules, "limits")] == ["LIMIT", "ORDER"]
    assert len(select_rules(spark, rules, "xyzzy")) == 5 and len(select_rules(spark, rules, "check only")) == 5


def test_source_list(spark):
    catalog = [SourceSpec("a", location="/x/a.csv"), SourceSpec("db", format="greenplum", connection="c", location="t")]
    rows = list_data_sources(spark, catalog).collect()
    assert [(r["source_id"], r["format"]) for r in rows] == [("a", "auto"), ("db", "greenplum")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_builds_its_records_once(spark):
    run = run_rule(spark, {"t": _table(spark)}, _rules(), "LIMIT", run_id="R-1")
    for table in (run.evidence, run.finding_evidence):
        assert table.count() == 3
        plan = _plan(table.select("evidence_id"))
        assert "parquet" in plan and "sha2" not in plan and "StructsToJson" not in plan and "Aggregate" not in plan
    assert _plan(verify_evidence(run.evidence).select("evidence_id")).count("StructsToJson") == 1


def test_a_run_keeps_equal_rows_as_evidence_and_one_reference(spark):
    df = spark.createDataFrame([(1, 5.0)] * 3 + [(1, 7.0), (None, 9.0), (None, 9.0), (2, None)], "id long, v double")
    run = run_rule(spark, {"t": df}, [RULE], "LIMIT", run_id="R-1")
    assert run.evidence.count() == 6 and verify_evidence(run.evidence).isEmpty()
    expected = fnd.finding_evidence(fnd.rule_candidates(df.where("v > 2"), RULE, "R-1", "id"))
    order = ["finding_id", "evidence_id"]
    assert run.finding_evidence.orderBy(order).collect() == expected.orderBy(order).collect() and expected.count() == 3


def test_references_that_share_finding_and_checksum_are_compared_whole(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 9.0)], "id long, v double")
    one = fnd.rule_candidates(df, RULE, "R", "id")
    other = one.withColumn("evidence", F.expr("struct(evidence.evidence_id, evidence.checksum, 'other' AS source_name, evidence.object_id, "
                                              "evidence.description, evidence.fields, evidence.query, evidence.constraint_match)"))
    both = one.unionByName(other)
    written = fnd.written_finding_evidence(both)
    order = ["finding_id", "source_name"]
    assert written.orderBy(order).collect() == fnd.finding_evidence(both).orderBy(order).collect() and written.count() == 4


def test_a_record_is_wrong_by_its_content_or_its_id(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(5)], "id long, v double")
    evidence = build_evidence(df, RULE, "R", "id")
    changed = evidence.withColumns({
        "result": F.when(F.col("object_id") == "0", "{}").otherwise(F.col("result")),
        "checksum": F.when(F.col("object_id") == "1", F.lit(None)).when(F.col("object_id") == "2", F.reverse("checksum")).otherwise(F.col("checksum")),
        "evidence_id": F.when(F.col("object_id") == "3", "EVD-" + "A" * 20).otherwise(F.col("evidence_id")),
    })
    wrong = verify_evidence(changed).join(changed, "evidence_id").select("object_id").collect()
    assert sorted(r["object_id"] for r in wrong) == ["0", "1", "2", "3"]
