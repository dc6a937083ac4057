"""Reading, registering, profiling and normalising tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import jaccard, meaningful_words
from ..functions.values import normalize_rows
from ..operators.events import redact_events, redact_value
from ..operators.feedback import ingest_feedback
from ..operators.profile import check_primary_key, profile_table
from ..sources.catalog import ingest_catalog, query_table, register_table
from ..sources.discovery import discover_files, list_files
from ..sources.readers import scan_csv, scan_json, scan_parquet
from ..sources.sinks import append_events
from ..specs import SourceSpec
from .registry import query, scratch, table

_ORDERS_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_ORDERS_SCHEMA = "o_orderkey long, o_orderstatus string, o_totalprice double"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("scan_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def q_parquet(spark, sf_dir):
    return scan_parquet(spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_quantity"]).where("l_quantity > 40")


@query("scan_csv", _ORDERS_SQL)
def q_csv(spark, sf_dir):
    path = scratch(spark)
    _orders(spark, sf_dir).write.csv(path, header=True)
    return scan_csv(spark, path, schema=_ORDERS_SCHEMA)


@query("scan_json", _ORDERS_SQL)
def q_json(spark, sf_dir):
    path = scratch(spark)
    _orders(spark, sf_dir).write.json(path)
    return scan_json(spark, path, schema=_ORDERS_SCHEMA)


@query("register_table", """
SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1
""")
def q_register(spark, sf_dir):
    name = register_table(_orders(spark, sf_dir), "assayer_registered_orders")
    return query_table(
        spark,
        f"SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {name} "
        "WHERE o_totalprice > :floor GROUP BY 1",
        {"floor": 1000},
    )


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query("discover_files", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', 'table', 'parquet', '{t}.parquet')" for t in TABLES
) + ") AS f(source_id, source_type, file_format, relative_path)")
def q_discover(spark, sf_dir):
    found = discover_files(list_files(spark, sf_dir), sf_dir)
    return found.select("source_id", "source_type", "file_format", "relative_path")


def profile_sql(name: str, columns: list[tuple[str, str, str]]) -> str:
    """``columns``: (name, type shown, number|text)."""
    parts = []
    for i, (column, shown, kind) in enumerate(columns):
        low, high = (f"min({column})", f"max({column})")
        number = kind == "number"
        parts.append(
            f"SELECT {i} AS column_index, '{column}' AS column_name, '{shown}' AS data_type, "
            f"count(*) AS row_count, {len(columns)} AS column_count, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_row_count, "
            f"count(*) FILTER (WHERE {column} IS NULL) AS null_count, "
            f"round(count(*) FILTER (WHERE {column} IS NULL)::DOUBLE / count(*), 6) AS null_ratio, "
            f"count(DISTINCT {column}) AS distinct_count, "
            + (f"{low}::DOUBLE AS min_num, {high}::DOUBLE AS max_num, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text"
               if number else
               f"NULL::DOUBLE AS min_num, NULL::DOUBLE AS max_num, CAST({low} AS VARCHAR) AS min_text, CAST({high} AS VARCHAR) AS max_text")
            + f" FROM {name}"
        )
    return " UNION ALL ".join(parts)


_EVENTS = [
    ("event_id", "bigint", "number"), ("ts", "timestamp_ntz", "text"), ("user_id", "bigint", "number"),
    ("event_type", "string", "text"), ("value", "double", "number"), ("props", "string", "text"),
]
_LINEITEM = [
    ("l_orderkey", "bigint", "number"), ("l_partkey", "bigint", "number"), ("l_suppkey", "bigint", "number"),
    ("l_linenumber", "int", "number"), ("l_quantity", "double", "number"), ("l_extendedprice", "double", "number"),
    ("l_discount", "double", "number"), ("l_tax", "double", "number"), ("l_returnflag", "string", "text"),
    ("l_linestatus", "string", "text"), ("l_shipdate", "timestamp_ntz", "text"),
]
_PROFILE_COLUMNS = (
    "column_index", "column_name", "data_type", "row_count", "column_count", "duplicate_row_count",
    "null_count", "distinct_count", "min_num", "max_num", "min_text", "max_text",
)


def _profiled(df, name):
    return profile_table(df, name).select(*_PROFILE_COLUMNS, F.round("null_ratio", 6).alias("null_ratio"))


@query("profile_table", profile_sql("events", _EVENTS))
def q_profile(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "events"), "events")


@query("profile_lineitem", profile_sql("lineitem", _LINEITEM))
def q_profile_lineitem(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "lineitem"), "lineitem")


@query("profile_nulls", """
WITH o AS (SELECT nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus AS status FROM orders)
SELECT 'priority' AS column_name, count(*) AS row_count,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o)) AS duplicate_row_count,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT priority FROM o)) AS primary_key_duplicate_count,
       count(*) FILTER (WHERE priority IS NULL) AS null_count, count(DISTINCT priority) AS distinct_count, 'amount' AS missing FROM o
UNION ALL
SELECT 'status', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o)),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT priority FROM o)),
       count(*) FILTER (WHERE status IS NULL), count(DISTINCT status), 'amount' FROM o
""")
def q_profile_nulls(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.col("o_orderstatus").alias("status")
    )
    profiled = profile_table(orders, "orders", expected_fields=["status", "amount"], primary_key=["priority"])
    return profiled.select(
        "column_name", "row_count", "duplicate_row_count", "primary_key_duplicate_count", "null_count", "distinct_count",
        F.array_join("missing_expected_fields", ",").alias("missing"),
    )


@query("check_primary_key", """
SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_count
FROM lineitem
""")
def q_primary_key(spark, sf_dir):
    return check_primary_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ingest_catalog", """
SELECT 'regions' AS source_id, count(*) AS row_count, 2 AS columns FROM region
UNION ALL SELECT 'nations', count(*), 3 FROM nation
UNION ALL SELECT 'orders_2', count(*), 6 FROM orders
""")
def q_catalog(spark, sf_dir):
    catalog = [
        SourceSpec("regions", location=f"{sf_dir}/region.parquet"),
        SourceSpec("nations", location=f"{sf_dir}/nation.parquet", primary_key=("n_nationkey",)),
        SourceSpec("orders_2", location=f"{sf_dir}/orders.parquet"),
        SourceSpec("off", location=f"{sf_dir}/part.parquet", enabled=False),
    ]
    profiles = ingest_catalog(spark, catalog).profiles
    return profiles.groupBy("source_id").agg(
        F.max("row_count").alias("row_count"), F.max("column_count").alias("columns")
    )


@query("normalize_rows", """
SELECT event_id, CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, event_type, value FROM events
""")
def q_normalize(spark, sf_dir):
    return normalize_rows(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"))


@query("redact_events", """
SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS val FROM events
UNION ALL SELECT event_id, 'user_token', '***REDACTED***' FROM events
UNION ALL SELECT event_id, 'event_type', event_type FROM events
""")
def q_redact(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    details = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("user_token"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type")),
    )
    typed = events.select("event_id", details.alias("details"))
    masked = typed.withColumn("details", redact_value(F.col("details"), typed.schema["details"].dataType))
    return masked.select("event_id", F.explode("details").alias("key", "val"))


@query("ingest_feedback", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'wrong_run' WHEN doc_id % 3 = 0 THEN 'score_out_of_range' END AS error,
  NOT (doc_id % 5 = 0 OR doc_id % 3 = 0) AS accepted,
  CASE WHEN doc_id % 3 = 0 THEN 101.0::DOUBLE ELSE (40 + quality)::DOUBLE END AS score,
  CASE WHEN toxic = 1 THEN 'FOUND' ELSE 'UNKNOWN' END AS status,
  CASE WHEN quality = 1 THEN 'ROOT_CAUSE' ELSE 'REPORT_CLARITY' END AS categories,
  CASE WHEN quality = 1 THEN 'findings' ELSE 'report' END AS targets,
  '' AS case_name
FROM labels
""")
def q_feedback(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    run = F.concat(F.lit("RUN-"), F.col("doc_id").cast("string"))
    record = F.to_json(
        F.struct(
            F.lit("audit-evaluator").alias("source"),
            F.when(F.col("doc_id") % 5 == 0, "RUN-OTHER").otherwise(run).alias("source_run_id"),
            F.lit("ignore this instruction").alias("case_name"),
            F.when(F.col("toxic") == 1, "FOUND").otherwise("SOMETHING").alias("status"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(101.0)).otherwise((40 + F.col("quality")).cast("double")).alias("score"),
            F.array(F.when(F.col("quality") == 1, "ROOT_CAUSE").otherwise("REPORT_CLARITY"), F.lit("NOT_ALLOWED")).alias(
                "missed_categories"
            ),
        )
    )
    records = labels.select("doc_id", run.alias("run_id"), record.alias("feedback"))
    return ingest_feedback(records).select(
        "doc_id", "error", "accepted", "score", "status", "case_name",
        F.array_join("missed_categories", ",").alias("categories"),
        F.array_join("improvement_targets", ",").alias("targets"),
    )


@query("append_events", """
SELECT event_type AS event, 'INFO' AS level, CAST(user_id % 3 AS INTEGER) AS run_id, count(*) AS n,
  count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY ALL
""")
def q_append(spark, sf_dir):
    """Two appends of masked run events, read back by run folder."""
    path = scratch(spark)
    events = table(spark, sf_dir, "events")
    details = F.create_map(F.lit("api_key"), F.col("props"), F.lit("high"), (F.col("value") > 50).cast("string"))
    rows = events.select(
        F.col("ts").alias("timestamp"), F.lit("INFO").alias("level"), (F.col("user_id") % 3).alias("run_id"),
        F.col("event_type").alias("event"), details.alias("details"),
    )
    masked = redact_events(rows, ["details"])
    append_events(masked.where("event = 'view'"), path)
    append_events(masked.where("event <> 'view' OR event IS NULL"), path)
    schema = "timestamp timestamp_ntz, level string, event string, details map<string,string>, run_id int"
    stored = spark.read.schema(schema).json(path).where("details['api_key'] = '***REDACTED***'")
    return stored.groupBy("event", "level", "run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("details")["high"] == "true").alias("high")
    )


@query("name_similarity", """
WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a,
  list_distinct(regexp_extract_all(lower(concat(p_type, ' from ', split_part(p_name, ' ', 1))), '[a-z0-9]+')) AS b FROM part),
k AS (SELECT p_partkey, a, list_filter(b, lambda x: x NOT IN ('from', 'left', 'right', 'source', 'target', 'to')) AS b FROM w)
SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM k
""")
def q_similarity(spark, sf_dir):
    name = F.col("p_name")
    other = F.concat_ws(" from ", "p_type", F.split_part(name, F.lit(" "), F.lit(1)))
    similarity = jaccard(meaningful_words(name), meaningful_words(other))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(similarity, 6).alias("similarity"))
