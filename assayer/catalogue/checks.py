"""Rule kinds on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.anomaly import iqr_outliers, zscore_outliers
from ..operators.applicability import rule_applicability, value_frequencies
from ..operators.reconcile import reconcile
from ..operators.rules import bounded_result, in_vocabulary, null_safe_neq, rule_contradiction, rule_sql
from ..operators.timeline import timeline
from ..specs import AnomalySpec, FindingTemplate, ReconcileSpec, RelationshipSpec, RuleSpec, SqlSpec, TimelineSpec
from .registry import query, table

STEPS = ("signup", "view", "click", "purchase")
TIMELINE = TimelineSpec("events", ("user_id",), "ts", "event_type", STEPS, 3600, ("event_id",))

TIMELINE_SQL = """
WITH r AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS event_rank
  FROM events),
o AS (
  SELECT *, lag(event_rank) OVER w AS previous_rank, lag(ts) OVER w AS previous_timestamp
  FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST))
SELECT CAST(user_id AS VARCHAR) AS object_id, event_id, ts, event_type, event_rank, previous_rank, previous_timestamp
FROM o
WHERE event_rank IS NULL OR (previous_rank IS NULL AND event_rank <> 1)
   OR (previous_rank IS NOT NULL AND (event_rank < previous_rank OR event_rank > previous_rank + 1))
   OR date_diff('second', previous_timestamp, ts) > 3600
"""
_TIMELINE_COLUMNS = ("object_id", "event_id", "ts", "event_type", "event_rank", "previous_rank", "previous_timestamp")


@query("timeline", TIMELINE_SQL)
def q_timeline(spark, sf_dir):
    return timeline(table(spark, sf_dir, "events"), TIMELINE).select(*_TIMELINE_COLUMNS)


@query("timeline_split_entities", TIMELINE_SQL)
def q_timeline_split(spark, sf_dir):
    """The form used for hot entities: the rows of every entity above 40 lie in several ranges."""
    events = table(spark, sf_dir, "events")
    return timeline(events, TIMELINE, max_group_rows=40).select(*_TIMELINE_COLUMNS)


@query("anomaly_zscore", """
SELECT event_id, event_type, value, round(m, 6) AS expected_mean, round(sd, 6) AS expected_stddev,
       round((value - m) / sd, 6) AS anomaly_score
FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS sd FROM events)
WHERE sd > 0 AND abs((value - m) / sd) > 4.0
""")
def q_zscore(spark, sf_dir):
    found = zscore_outliers(table(spark, sf_dir, "events"), AnomalySpec("events", "value", ("event_type",), "zscore", 4.0))
    return _rounded(found, "event_id", "event_type", "value", numbers=("expected_mean", "expected_stddev", "anomaly_score"))


@query("anomaly_zscore_global", """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id, value, round(m, 6) AS expected_mean, round(sd, 6) AS expected_stddev, round((value - m) / sd, 6) AS anomaly_score
FROM events, s WHERE sd > 0 AND abs((value - m) / sd) > 4.0
""")
def q_zscore_global(spark, sf_dir):
    found = zscore_outliers(table(spark, sf_dir, "events"), AnomalySpec("events", "value", (), "zscore", 4.0))
    return _rounded(found, "event_id", "value", numbers=("expected_mean", "expected_stddev", "anomaly_score"))


@query("anomaly_zscore_user", """
SELECT event_id, user_id, value, round((value - m) / sd, 6) AS anomaly_score
FROM (SELECT *, avg(value) OVER (PARTITION BY user_id, event_type) AS m, stddev_pop(value) OVER (PARTITION BY user_id, event_type) AS sd FROM events)
WHERE sd > 0 AND abs((value - m) / sd) > 3.0
""")
def q_zscore_user(spark, sf_dir):
    found = zscore_outliers(
        table(spark, sf_dir, "events"), AnomalySpec("events", "value", ("user_id", "event_type"), "zscore", 3.0)
    )
    return _rounded(found, "event_id", "user_id", "value", numbers=("anomaly_score",))


IQR_SQL = """
WITH st AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT e.event_id, e.event_type, e.value, round(q1, 6) AS q1, round(q3, 6) AS q3,
       CASE WHEN q3 = q1 THEN 0.0::DOUBLE ELSE round(abs(value - (q1 + q3) / 2) / (q3 - q1), 6) END AS anomaly_score
FROM events e JOIN st ON e.event_type IS NOT DISTINCT FROM st.event_type
WHERE value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1)
"""
IQR = AnomalySpec("events", "value", ("event_type",), "iqr", 3.0)


@query("anomaly_iqr", IQR_SQL)
def q_iqr(spark, sf_dir):
    found = iqr_outliers(table(spark, sf_dir, "events"), IQR)
    return _rounded(found, "event_id", "event_type", "value", numbers=("q1", "q3", "anomaly_score"))


@query("anomaly_iqr_bracketed", IQR_SQL)
def q_iqr_bracketed(spark, sf_dir):
    """The form used at scale: brackets that narrow to the wanted ranks."""
    found = iqr_outliers(table(spark, sf_dir, "events"), IQR, gathered_rows=500)
    return _rounded(found, "event_id", "event_type", "value", numbers=("q1", "q3", "anomaly_score"))


@query("anomaly_iqr_global", """
WITH st AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(abs(l_extendedprice - (q1 + q3) / 2) / (q3 - q1), 6) AS anomaly_score
FROM lineitem, st WHERE l_extendedprice < q1 - 0.45 * (q3 - q1) OR l_extendedprice > q3 + 0.45 * (q3 - q1)
""")
def q_iqr_global(spark, sf_dir):
    found = iqr_outliers(table(spark, sf_dir, "lineitem"), AnomalySpec("lineitem", "l_extendedprice", (), "iqr", 0.45))
    return _rounded(found, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", numbers=("anomaly_score",))


def _rounded(df, *names, numbers):
    return df.select(*names, *[F.round(n, 6).alias(n) for n in numbers])


ORDER_TOTALS = RelationshipSpec("order_to_lines", "orders", "lines", (("o_orderkey", "l_orderkey"),), "one_to_many")


def order_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge")
    )


# Six decimals are exact here, so rounding never meets a tie.
@query("reconcile", """
WITH l AS (SELECT o_orderkey AS k, sum(o_totalprice) AS lv FROM orders GROUP BY 1),
     r AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS rv FROM lineitem GROUP BY 1)
SELECT CAST(coalesce(l.k, r.k) AS VARCHAR) AS object_id, coalesce(l.k, r.k) AS key_0, round(lv, 6) AS left_value,
       round(rv, 6) AS right_value, round(coalesce(lv, 0) - coalesce(rv, 0), 6) AS difference
FROM l FULL OUTER JOIN r ON l.k IS NOT DISTINCT FROM r.k
WHERE abs(coalesce(lv, 0) - coalesce(rv, 0)) > 0.01
""")
def q_reconcile(spark, sf_dir):
    found = reconcile(
        table(spark, sf_dir, "orders"),
        order_lines(spark, sf_dir),
        ORDER_TOTALS,
        ReconcileSpec("order_to_lines", "o_totalprice", "charge", "sum", 0.01),
    )
    return found.select("object_id", "key_0", *[F.round(n, 6).alias(n) for n in ("left_value", "right_value", "difference")])


@query("reconcile_null_keys", """
WITH l AS (SELECT nullif(o_orderpriority, '5-LOW') AS a, o_orderstatus AS b, count(o_orderkey) AS lv FROM orders GROUP BY 1, 2),
     r AS (SELECT nullif(o_orderpriority, '5-LOW') AS a, nullif(o_orderstatus, 'P') AS b, count(o_orderkey) AS rv
           FROM orders WHERE o_totalprice > 100000 GROUP BY 1, 2)
SELECT concat_ws('|', coalesce(l.a, r.a), coalesce(l.b, r.b)) AS object_id, coalesce(l.a, r.a) AS key_0, coalesce(l.b, r.b) AS key_1,
       lv AS left_value, rv AS right_value, coalesce(lv, 0) - coalesce(rv, 0) AS difference
FROM l FULL OUTER JOIN r ON l.a IS NOT DISTINCT FROM r.a AND l.b IS NOT DISTINCT FROM r.b
WHERE abs(coalesce(lv, 0) - coalesce(rv, 0)) > 0
""")
def q_reconcile_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    priority = F.nullif("o_orderpriority", F.lit("5-LOW"))
    left = orders.select(priority.alias("a"), F.col("o_orderstatus").alias("b"), "o_orderkey")
    right = orders.where("o_totalprice > 100000").select(
        priority.alias("a"), F.nullif("o_orderstatus", F.lit("P")).alias("b"), "o_orderkey"
    )
    link = RelationshipSpec("r", "left", "right", (("a", "a"), ("b", "b")))
    return reconcile(left, right, link, ReconcileSpec("r", "o_orderkey", "o_orderkey", "count"))


for _kind in ("avg", "min", "max"):

    @query(f"reconcile_{_kind}", f"""
    WITH l AS (SELECT o_custkey AS k, {_kind}(o_totalprice) AS lv FROM orders GROUP BY 1),
         r AS (SELECT c_custkey AS k, {_kind}(c_acctbal) AS rv FROM customer GROUP BY 1)
    SELECT coalesce(l.k, r.k) AS key_0, round(lv, 7) AS left_value, round(rv, 7) AS right_value,
           round(coalesce(lv, 0) - coalesce(rv, 0), 7) AS difference
    FROM l FULL OUTER JOIN r ON l.k IS NOT DISTINCT FROM r.k
    WHERE abs(coalesce(lv, 0) - coalesce(rv, 0)) > 50000.5
    """)
    def q_reconcile_kind(spark, sf_dir, kind=_kind):
        found = reconcile(
            table(spark, sf_dir, "orders"),
            table(spark, sf_dir, "customer"),
            RelationshipSpec("c", "orders", "customer", (("o_custkey", "c_custkey"),)),
            ReconcileSpec("c", "o_totalprice", "c_acctbal", kind, 50000.5),
        )
        return found.select("key_0", *[F.round(n, 7).alias(n) for n in ("left_value", "right_value", "difference")])


@query("rule_sql", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_acctbal, round(abs(o.o_totalprice) - 50 * abs(c.c_acctbal), 4) AS excess
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE abs(o.o_totalprice) > 50 * abs(c.c_acctbal)
""")
def q_rule_sql(spark, sf_dir):
    spec = SqlSpec(
        "SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_acctbal, "
        "round(abs(o.o_totalprice) - 50 * abs(c.c_acctbal), 4) AS excess "
        "FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey "
        "WHERE abs(o.o_totalprice) > 50 * abs(c.c_acctbal)",
        "o_orderkey",
    )
    return rule_sql(spark, spec, {n: table(spark, sf_dir, n) for n in ("orders", "customer")})


CONTRADICTION = SqlSpec(
    "SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus FROM {{orders}} o WHERE o.o_orderstatus = 'F' "
    "AND EXISTS (SELECT 1 FROM {{lineitem}} l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')",
    "o_orderkey",
)


def contradictions(spark, sf_dir):
    return rule_contradiction(spark, CONTRADICTION, {n: table(spark, sf_dir, n) for n in ("orders", "lineitem")})


CONTRADICTION_SQL = CONTRADICTION.query.replace("{{", "").replace("}}", "")


@query("rule_contradiction", CONTRADICTION_SQL)
def q_contradiction(spark, sf_dir):
    return contradictions(spark, sf_dir)


@query("rule_limit_breach", """
SELECT c_custkey, c_acctbal, round(abs(c_acctbal) - 9000, 4) AS excess_amount FROM customer WHERE abs(c_acctbal) > 9000
""")
def q_limit(spark, sf_dir):
    spec = SqlSpec(
        "SELECT c_custkey, c_acctbal, round(abs(c_acctbal) - 9000, 4) AS excess_amount "
        "FROM {{customer}} WHERE abs(c_acctbal) > 9000",
        "c_custkey",
    )
    return rule_sql(spark, spec, {"customer": table(spark, sf_dir, "customer")})


@query("rule_join_limit", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, round(l.l_quantity * (p.p_retailprice / 100.0), 6) AS notional, p.p_size
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
WHERE l.l_returnflag = 'A' AND p.p_size > 10 AND l.l_quantity * (p.p_retailprice / 100.0) > 12 * p.p_size
""")
def q_join_limit(spark, sf_dir):
    spec = SqlSpec(
        "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, round(l.l_quantity * (p.p_retailprice / 100.0), 6) AS notional, "
        "p.p_size FROM {{lineitem}} l JOIN {{part}} p ON p.p_partkey = l.l_partkey "
        "WHERE l.l_returnflag = 'A' AND p.p_size > 10 AND l.l_quantity * (p.p_retailprice / 100.0) > 12 * p.p_size"
    )
    return rule_sql(spark, spec, {n: table(spark, sf_dir, n) for n in ("lineitem", "part")})


@query("in_vocabulary", """
SELECT event_id, event_type, coalesce(CAST(event_type AS VARCHAR) IN ('signup', 'view', 'click', 'purchase'), false) AS mapped FROM events
""")
def q_vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", in_vocabulary(F.col("event_type"), STEPS).alias("mapped")
    )


@query("null_safe_neq", """
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders
WHERE nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'
""")
def q_null_safe(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return rows.where(null_safe_neq(F.col("priority"), F.lit("1-URGENT")))


@query("bounded_result", """
WITH x AS (
  SELECT event_id, event_type, value FROM (
    SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS sd FROM events)
  WHERE sd > 0 AND abs((value - m) / sd) > 4.0)
SELECT event_id, event_type, value, (SELECT count(*) FROM x) > 20 AS truncated FROM x ORDER BY event_id LIMIT 20
""")
def q_bounded(spark, sf_dir):
    found = zscore_outliers(table(spark, sf_dir, "events"), AnomalySpec("events", "value", ("event_type",), "zscore", 4.0))
    return bounded_result(found.select("event_id", "event_type", "value"), 20, [F.asc("event_id")])


@query("rule_applicability", """
WITH v AS (SELECT event_type AS value, count(*) AS n, event_type IN ('signup', 'view', 'click', 'purchase') AS mapped FROM events
  WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, value LIMIT 50)
SELECT 'EVENT_ORDER' AS rule_id, 'timeline' AS rule_kind, 'events' AS source_id, 'event_type' AS column_name,
       (SELECT concat('[', string_agg(concat('{"value":"', value, '","rows_count":', n, ',"mapped":', mapped, '}'), ',' ORDER BY n DESC, value), ']') FROM v) AS observed_values,
       'signup,view,click,purchase' AS expected_values,
       CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE event_type IN ('signup', 'view', 'click', 'purchase')) = 0 THEN 'No observed value is in the vocabulary.'
            WHEN count(*) FILTER (WHERE event_type IN ('signup', 'view', 'click', 'purchase')) < count(*) THEN 'Some observed values are not in the vocabulary.'
            ELSE 'The vocabulary covers the observed values.' END AS reason,
       count(*) AS total_rows, count(*) FILTER (WHERE event_type IN ('signup', 'view', 'click', 'purchase')) AS matched_rows,
       round(count(*) FILTER (WHERE event_type IN ('signup', 'view', 'click', 'purchase'))::DOUBLE / count(*), 6) AS row_coverage,
       CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE event_type IN ('signup', 'view', 'click', 'purchase')) = 0 THEN 'INCOMPATIBLE'
            WHEN count(*) FILTER (WHERE event_type IN ('signup', 'view', 'click', 'purchase')) < count(*) THEN 'PARTIAL'
            ELSE 'APPLICABLE' END AS status
FROM events
""")
def q_applicability(spark, sf_dir):
    texts = FindingTemplate("Out of order", "Out of order", "order", "Not established", "In order", "Wrong figures", "LOW")
    rule = RuleSpec("EVENT_ORDER", "timeline", ("events",), texts, timeline=TIMELINE)
    fit = rule_applicability(table(spark, sf_dir, "events"), rule)
    return fit.withColumn("expected_values", F.array_join("expected_values", ","))


@query("value_frequencies", """
SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS rows_count, CAST(user_id AS VARCHAR) IN ('1', '2', '3') AS mapped
FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY rows_count DESC, value LIMIT 50
""")
def q_frequencies(spark, sf_dir):
    return value_frequencies(table(spark, sf_dir, "events"), "user_id", ("1", "2", "3"))
