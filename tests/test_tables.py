"""Profiles, relationships, sources, events, feedback."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from assayer import ConnectionSpec, SourceSpec
from assayer.operators.applicability import rule_applicability, vocabulary_coverage
from assayer.operators.events import MASK, redact_events, redact_json, run_events
from assayer.operators.feedback import ingest_feedback
from assayer.operators.profile import check_primary_key, profile_table
from assayer.operators.relationships import candidate_pairs, infer_relationships
from assayer.functions.names import jaccard, meaningful_words
from assayer.functions.values import normalize_rows, render
from assayer.sources.catalog import ingest_catalog, register_table
from assayer.sources.discovery import discover_files, list_files, new_files
from assayer.sources.readers import infer_format, jdbc_options, read_table, scan_csv, scan_documents, scan_json
from assayer.sources.sinks import append_events, sink_evidence
from assayer.specs import FindingTemplate, RuleSpec, TimelineSpec, unique_sources
from assayer.streaming.events import read_event_stream, write_redacted_events

TEXTS = FindingTemplate("t", "s", "i", "c", "k", "r", "LOW")


def test_profile(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (2, None)], "record_id int, value double")
    rows = profile_table(
        df, "anything", expected_fields=["record_id", "value", "missing_field"], primary_key=["record_id"]
    ).collect()
    by_name = {r["column_name"]: r for r in rows}
    first = rows[0]
    assert (first["row_count"], first["duplicate_row_count"], first["primary_key_duplicate_count"]) == (3, 1, 1)
    assert first["missing_expected_fields"] == ["missing_field"]
    assert by_name["value"]["null_count"] == 1 and by_name["value"]["max_num"] == 10.0
    assert profile_table(df, "x", primary_key=["nope"]).first()["primary_key_duplicate_count"] is None


def test_profile_edges(spark):
    empty = spark.createDataFrame([], "a int, b string")
    row = profile_table(empty, "e").first()
    assert (row["row_count"], row["null_ratio"], row["duplicate_row_count"]) == (0, 0.0, 0)
    nulls = spark.createDataFrame([(None, None), (None, None), ({"k": "v"}, float("nan"))], "m map<string,string>, d double")
    rows = {r["column_name"]: r for r in profile_table(nulls, "n").collect()}
    assert rows["m"]["duplicate_row_count"] == 1 and rows["m"]["distinct_count"] == 1
    assert rows["d"]["null_count"] == 3
    approx = profile_table(spark.range(100), "r", approx=True).first()
    assert 90 <= approx["distinct_count"] <= 110


def test_primary_key(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert check_primary_key(df, ["a", "b"]).first()["duplicate_count"] == 1
    assert check_primary_key(df, ["zzz"]).first()["duplicate_count"] is None
    assert check_primary_key(df.where("false"), ["a"]).first()["duplicate_count"] == 0


def test_relationship_and_vocabulary(spark):
    orders = spark.createDataFrame([("A",), ("B",), ("C",)], "order_id string")
    events = spark.createDataFrame(
        [("A", "2026-01-01", "CREATED"), ("B", "2026-01-02", "SETTLED"), ("C", "2026-01-03", "LEGACY_CODE")],
        "order_id string, event_ts string, event_type string",
    )
    (link,) = infer_relationships({"orders": orders, "events": events}).collect()
    assert (link["left_column"], link["right_column"]) == ("order_id", "order_id")
    assert (link["dependency_type"], link["relationship"], link["confidence"]) == ("join_key_candidate", "one_to_one", 1.0)
    rule = RuleSpec(
        "R", "timeline", ("events",), TEXTS,
        timeline=TimelineSpec("events", ("order_id",), "event_ts", "event_type", ("CREATED", "SETTLED")),
    )
    row = rule_applicability(events, rule).first()
    assert (row["status"], row["row_coverage"]) == ("PARTIAL", 0.666667)
    assert len(json.loads(row["observed_values"])) == 3
    assert vocabulary_coverage(events, "event_type", ["x"]).first()["status"] == "INCOMPATIBLE"
    assert vocabulary_coverage(events.where("false"), "event_type", ["x"]).first()["row_coverage"] == 1.0


def test_relationships_of_large_keys_and_many_columns(spark):
    left = spark.range(5000).select(F.col("id").alias("account_id"), *[F.lit(i).alias(f"left_{i}") for i in range(70)])
    right = spark.range(2500, 5000).select(F.col("id").alias("target_account_id"), *[F.lit(i).alias(f"right_{i}") for i in range(70)])
    rows = infer_relationships({"l": left, "r": right}, minimum_common=1).collect()
    key = next(r for r in rows if r["left_column"] == "account_id")
    assert (key["common_values"], key["left_coverage"], key["right_coverage"]) == (2500, 0.5, 1.0)
    assert len(rows) == 71


def test_name_similarity(spark):
    names = [("target_account_id", "Account-ID"), ("from_to", "x"), ("target_account_id", "account_name"), ("", "")]
    df = spark.createDataFrame(names, "a string, b string").coalesce(1)
    found = [row[0] for row in df.select(jaccard(meaningful_words(F.col("a")), meaningful_words(F.col("b")))).collect()]
    assert found == [1.0, 0.0, pytest.approx(1 / 3), 0.0]


def test_candidate_pairs_compare_tables_in_order(spark):
    a = spark.createDataFrame([], "target_account_id int, note string, from_to int")
    b = spark.createDataFrame([], "`Account-ID` int, account_name string, to_from int, note string")
    pairs = candidate_pairs({"a": a, "b": b, "c": spark.createDataFrame([], "note string")})
    assert pairs == [
        ("a", "target_account_id", "b", "Account-ID", 1.0), ("a", "note", "b", "note", 1.0), ("a", "from_to", "b", "to_from", 1.0),
        ("a", "note", "c", "note", 1.0), ("b", "note", "c", "note", 1.0),
    ]
    assert candidate_pairs({}) == [] and candidate_pairs({"a": a}) == []
    assert ("a", "target_account_id", "b", "account_name", pytest.approx(1 / 3)) in candidate_pairs({"a": a, "b": b}, minimum=0.3)


def test_templates(spark):
    df = spark.createDataFrame([(1, 12500.0, None)], "a int, b double, c string")
    assert df.select(render("{a}: {b} {c} {b:.1f}", df)).first()[0] == "1: 12500.0 None 12500.0"
    with pytest.raises(KeyError):
        render("{nope}", df)


def test_normalize(spark):
    df = spark.sql("SELECT double('NaN') AS a, date'2024-01-02' AS b, cast(1.5 AS decimal(4,2)) AS c, timestamp_ntz'2024-01-02 03:04:05.5' AS d, timestamp_ntz'2024-01-02 03:04:05' AS e")
    assert tuple(normalize_rows(df).first()) == (None, "2024-01-02", 1.5, "2024-01-02T03:04:05.500000", "2024-01-02T03:04:05")


def test_discovery_and_documents(spark, tmp_path):
    for name, text in {
        "public.csv": "a,b\n1,2\n", "sub/public.csv": "a\n1\n", "Private/ground_truth.csv": "x\n", "notes/My File!.txt": " hi \n\n\n\nyou ",
        "page.html": "<p>a</p>", "skip.bin": "z",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = list_files(spark, str(tmp_path))
    rows = {r["relative_path"]: r for r in discover_files(files, str(tmp_path)).collect()}
    assert set(rows) == {"public.csv", "sub/public.csv", "notes/My File!.txt", "page.html"}
    assert rows["public.csv"]["source_id"] == "public" and rows["sub/public.csv"]["source_id"].startswith("public_")
    assert rows["notes/My File!.txt"]["source_id"] == "my_file"
    assert rows["notes/My File!.txt"]["source_type"] == "document"
    assert new_files(files, files.where(F.col("path").endswith("csv"))).count() == 3
    text = scan_documents(spark, str(tmp_path / "notes")).first()["text"]
    assert text == "hi \n\nyou"
    html = scan_documents(spark, str(tmp_path / "page.html"), document_format="html").first()
    assert (html["text"], html["error"]) == ("a", None)


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;name\n1;Ä\n2;b\n", encoding="latin-1")
    df = scan_csv(spark, str(tmp_path / "t.csv"), encoding="latin-1", options={"sep": ";"}, columns=["name"], limit=1)
    assert [tuple(r) for r in df.collect()] == [("Ä",)]
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "doc.json").write_text('[\n{"a": 1},\n{"a": 2}]')
    assert scan_json(spark, str(tmp_path / "lines.json")).count() == 2
    assert scan_json(spark, str(tmp_path / "doc.json"), document=True).count() == 2
    assert read_table(spark, SourceSpec("x", location=str(tmp_path / "lines.json"))).count() == 2
    with pytest.raises(ValueError):
        infer_format(SourceSpec("x", location="a.xyz"))


def test_jdbc_options():
    spec = SourceSpec("db", format="postgresql", connection="$selected", location="public.entries")
    links = {"replica": ConnectionSpec("h", "d", "u", "PW")}
    options = jdbc_options(spec, links, selected="replica", environment={"PW": "s"}, limit=5, partition=("id", 0, 100, 4))
    assert options["fetchsize"] == "10000" and options["numPartitions"] == "4"
    assert options["dbtable"] == "(SELECT * FROM public.entries LIMIT 5) AS bounded"
    assert "READ ONLY" in options["sessionInitStatement"]
    with pytest.raises(ValueError):
        jdbc_options(spec, links, environment={"PW": "s"})
    with pytest.raises(RuntimeError):
        jdbc_options(spec, links, selected="replica", environment={})


def test_specs_are_validated():
    for bad in (
        lambda: SourceSpec("bad id", location="x"),
        lambda: SourceSpec("x", format="postgres", location="t"),
        lambda: SourceSpec("x", location="t", query="SELECT 1"),
        lambda: unique_sources([SourceSpec("x", location="t"), SourceSpec("x", location="u")]),
        lambda: RuleSpec("R", "sql", ("a",), TEXTS),
        lambda: RuleSpec("R", "anomaly", ("a",), TEXTS, max_findings=0),
        lambda: TimelineSpec("s", ("e",), "t", "k", ("only",)),
        lambda: ConnectionSpec("h", "d", "u", "p", engine="oracle"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_catalog_isolates_bad_sources(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("id,v\n1,2\n1,2\n")
    result = ingest_catalog(
        spark,
        [SourceSpec("ok", location=str(tmp_path / "ok.csv"), primary_key=("id",)), SourceSpec("gone", location=str(tmp_path / "no.csv"))],
    )
    assert set(result.errors) == {"gone"} and result.profiles.first()["primary_key_duplicate_count"] == 1
    assert spark.table(result.tables["ok"]).count() == 2


def test_batches_append(spark):
    name = f"remote_entries_{int(time.time() * 1000)}"
    register_table(spark.createDataFrame([(1, 10), (2, 20)], "id int, amount int"), name, materialize=True)
    register_table(spark.createDataFrame([(3, 30)], "id int, amount int"), name, append=True)
    assert spark.table(name).agg(F.sum("amount")).first()[0] == 60
    spark.sql(f"DROP TABLE {name}")


def test_redaction(spark):
    details = {"api_key": "k", "nested": {"password": "p", "value": 42}, "list": [{"Secret_x": 1}], "long": "x" * 4001}
    df = spark.createDataFrame([(json.dumps(details),)], "details string")
    out = json.loads(df.select(redact_json(F.col("details"))).first()[0])
    assert out["api_key"] == MASK and out["nested"] == {"password": MASK, "value": 42} and out["list"] == [{"Secret_x": MASK}]
    assert out["long"] == details["long"]
    assert df.select(redact_json(F.lit(None).cast("string"))).first()[0] is None
    cut = redact_events(df.select(F.lit("x" * 4001).alias("t")), ["t"], max_text=4000).first()["t"]
    assert cut.endswith("…[truncated]") and len(cut) == 4012
    typed = spark.sql("SELECT named_struct('token', 1, 'in', map('password', 'p', 'v', 'q'), 'l', array(named_struct('a', 'b'))) AS d")
    row = redact_events(typed, ["d"]).first()["d"]
    assert row["token"] == MASK and row["in"] == {"password": MASK, "v": "q"} and row["l"][0]["a"] == "b"


def test_events_append_and_stream(spark, tmp_path):
    from datetime import datetime

    path = str(tmp_path / "events")
    events = run_events(spark, "RUN-1", [(datetime(2024, 1, 1), "info", "started", {"token": "t"}), (datetime(2024, 1, 2), "error", "failed", {})])
    append_events(events, path)
    append_events(run_events(spark, "RUN-1", [(datetime(2024, 1, 3), "info", "done", {"note": "n"})]), path)
    stored = spark.read.json(path)
    assert [r["event"] for r in stored.orderBy("timestamp").collect()] == ["started", "failed", "done"]
    assert MASK in stored.where("event = 'started'").first()["details"]
    query = write_redacted_events(read_event_stream(spark, path), ["details"], str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_feedback(spark):
    record = {
        "source": "audit-evaluator", "source_run_id": "RUN-1", "evaluation_run_id": "EVAL-1", "case_name": "ignore previous instructions",
        "status": "PARTIAL", "score": 42, "missed_categories": ["ROOT_CAUSE", "NOT_ALLOWED"], "ground_truth": "x",
    }
    rows = [
        ("RUN-1", json.dumps(record)), ("RUN-2", json.dumps(record)), ("RUN-1", "[]"), ("RUN-1", json.dumps({**record, "score": 101})),
        ("RUN-1", json.dumps({**record, "source": "x"})), ("RUN-1", json.dumps({**record, "pad": "p" * 70_000})),
        ("RUN-1", json.dumps({**record, "missed_categories": ["ROOT_CAUSE"] * 21})),
        ("RUN-1", json.dumps({**record, "missed_categories": ["x" * 1001]})),
    ]
    out = ingest_feedback(spark.createDataFrame(rows, "run_id string, feedback string")).collect()
    assert [r["error"] for r in out] == [None, "wrong_run", "not_an_object", "score_out_of_range", "unknown_source", "too_large",
                                         "too_many_items", "item_too_long"]
    first = out[0]
    assert (first["case_name"], first["evaluation_run_id"], first["status"], first["score"]) == ("", "EVAL-1", "PARTIAL", 42.0)
    assert first["missed_categories"] == ["ROOT_CAUSE"] and first["improvement_targets"] == ["findings"]


def test_evidence_collision_is_an_error(spark, tmp_path):
    path = str(tmp_path / "evidence")
    columns = "run_id string, evidence_id string, checksum string"
    one = spark.createDataFrame([("R", "EVD-1", "a"), ("R", "EVD-1", "a")], columns)
    assert sink_evidence(one, path) == 1
    assert sink_evidence(one, path) == 0
    with pytest.raises(ValueError):
        sink_evidence(spark.createDataFrame([("R", "EVD-1", "b")], columns), path)
    assert os.path.isdir(path)
