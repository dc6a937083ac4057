"""Timeline, anomalies, reconciliation, SQL rules: edge rows and split groups."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from assayer.operators import ordering
from assayer.operators.anomaly import anomaly, iqr_outliers, zscore_outliers
from assayer.operators.ordering import grouped_quantiles, previous_values, top_per_group
from assayer.operators.reconcile import reconcile
from assayer.operators.rules import bounded_result, in_vocabulary, rule_sql
from assayer.operators.timeline import timeline
from assayer.specs import AnomalySpec, ReconcileSpec, RelationshipSpec, SqlSpec, TimelineSpec
from pyspark.sql import functions as F

SPEC = TimelineSpec("e", ("entity",), "ts", "kind", ("A", "B", "C"), 100, ("id",))
T0 = datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(
        [(i, entity, T0 + timedelta(seconds=s) if s is not None else None, kind) for i, (entity, s, kind) in enumerate(rows)],
        "id long, entity string, ts timestamp_ntz, kind string",
    )


def test_short_ranges_do_not_make_as_many_tasks(spark, monkeypatch):
    tasks, write = [], ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda df: tasks.append(df.rdd.getNumPartitions()) or write(df))
    rows = spark.range(2000).selectExpr("id % 3 AS entity", "id * 7 % 2000 AS at", "id AS kind")
    found = previous_values(rows, ["entity"], "at", [], {"before": "kind"}, max_group_rows=4)
    expected = rows.selectExpr("*", "lag(kind) OVER (PARTITION BY entity ORDER BY at) AS before")
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)
    # 1000 ranges: cut within at most as many tasks as a shuffle has
    assert max(tasks) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_timeline_rules(spark):
    rows = [
        ("x", 0, "A"), ("x", 10, "A"), ("x", 20, "?"), ("x", 30, "B"), ("x", 130, "C"), ("x", 231, "C"),
        ("y", 0, "B"), ("y", 0, "C"), ("y", 5, "A"), ("z", None, "A"), ("z", 1, "A"), (None, 0, "B"),
    ]
    found = {r["id"]: r for r in timeline(_events(spark, rows), SPEC).collect()}
    # no place; after an event without a place; gap of 101 s; first is step 2; step back; NULL entity starts at step 2
    assert set(found) == {2, 3, 5, 6, 8, 11}
    assert found[3]["previous_rank"] is None and found[3]["event_rank"] == 2
    assert found[5]["previous_timestamp"] == T0 + timedelta(seconds=130)
    assert found[11]["object_id"] == ""


def test_timeline_accepts_text_times(spark):
    df = spark.createDataFrame([(1, "x", "2024-01-01 00:00:00", "B")], "id long, entity string, ts string, kind string")
    assert timeline(df, SPEC).count() == 1


def _brute_previous(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: (r[2] is None, r[2] or T0, r[0]))
        for before, row in zip([None, *members], members):
            out[row[0]] = before and before[3]
    return out


@pytest.mark.parametrize("limit", [1, 7, 50, 400])
def test_split_lag_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    rows = []
    for i in range(900):
        entity = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "c"])
        second = None if rng.random() < 0.05 else int(rng.paretovariate(0.5)) % 5000
        rows.append((i, entity, None if second is None else T0 + timedelta(seconds=second), rng.choice("ABC?")))
    df = spark.createDataFrame(rows, "id long, entity string, ts timestamp_ntz, kind string")
    found = previous_values(df, ["entity"], "ts", ["id"], {"before": "kind"}, max_group_rows=limit)
    assert {r["id"]: r["before"] for r in found.collect()} == _brute_previous(rows)


@pytest.mark.parametrize("times", ["one second", "none", "any"])
def test_a_third_of_all_rows_in_one_entity(spark, times):
    rng = random.Random(times)
    rows = []
    for i in range(1500):
        entity = "hot" if i % 3 == 0 else f"e{rng.randrange(60)}"
        second = {"one second": T0, "none": None, "any": T0 + timedelta(seconds=rng.randrange(40))}[times if entity == "hot" else "any"]
        rows.append((i, entity, second, rng.choice("ABC?")))
    df = spark.createDataFrame(rows, "id long, entity string, ts timestamp_ntz, kind string").repartition(4)
    found = previous_values(df, ["entity"], "ts", ["id"], {"before": "kind", "earlier": "id"}, max_group_rows=30).collect()
    assert {r["id"]: r["before"] for r in found} == _brute_previous(rows)
    # Without tie-breakers equal rows may come in any order, but they form one chain.
    untied = previous_values(df, ["entity"], "ts", [], {"earlier": "id"}, max_group_rows=30).where("entity = 'hot'").collect()
    follows = {r["earlier"]: r["id"] for r in untied}
    at, seen = None, []
    while at in follows:
        at = follows[at]
        seen.append(at)
    assert sorted(seen) == [r[0] for r in rows if r[1] == "hot"]


def test_zscore_edges(spark):
    rows = [("flat", 5.0)] * 4 + [("one", 1.0)] + [("g", 1.0)] * 20 + [("g", 100.0), ("g", None), ("g", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    found = zscore_outliers(df, AnomalySpec("t", "v", ("g",), "zscore", 3.0)).collect()
    values = np.array([1.0] * 20 + [100.0])
    assert [(r["g"], r["v"]) for r in found] == [("g", 100.0)]
    assert found[0]["anomaly_score"] == pytest.approx((100 - values.mean()) / values.std())


def test_iqr_edges(spark):
    df = spark.createDataFrame([(None, 5.0)] * 9 + [(None, 6.0), ("n", None)], "g string, v double")
    found = anomaly(df, AnomalySpec("t", "v", ("g",), "iqr", 1.5)).collect()
    assert [(r["v"], r["anomaly_score"]) for r in found] == [(6.0, 0.0)]
    assert iqr_outliers(df, AnomalySpec("t", "v", (), "iqr", 1.5)).count() == 1


@pytest.mark.parametrize("limit", [3, 300])
def test_narrowed_quantiles_have_the_digits_of_the_built_in(spark, limit):
    rng = np.random.default_rng(limit)
    groups = {"hot": rng.pareto(0.3, 3000), "ties": rng.integers(0, 4, 1001).astype(float), "two": np.repeat([1.0, 7.5], [400, 401]),
              "three": np.array([1.0, 2.0, 9.0]), "one": np.array([4.0]), "same": np.full(700, -2.5),
              "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 800), -(10.0 ** rng.integers(-300, 300, 700))]), None: rng.normal(size=900)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"q0": 0.0, "q1": 0.25, "q2": 0.7123}
    builtin = [F.percentile("v", q).alias(n) for n, q in wanted.items()]
    assert sorted(map(str, grouped_quantiles(df, ["g"], "v", wanted, gathered_rows=limit).collect())) == sorted(
        map(str, df.groupBy("g").agg(*builtin).collect()))
    assert grouped_quantiles(df, [], "v", wanted, gathered_rows=limit).collect() == df.agg(*builtin).collect()


def test_quantiles_of_orders_have_the_digits_of_the_built_in(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    wanted = {"q1": 0.25, "q3": 0.75}
    builtin = [F.percentile("o_totalprice", q).alias(n) for n, q in wanted.items()]
    found = grouped_quantiles(orders, ["o_custkey"], "o_totalprice", wanted, gathered_rows=5)
    assert sorted(found.collect()) == sorted(orders.groupBy("o_custkey").agg(*builtin).collect())


def test_reconcile_edges(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 5.0), (None, 2.0), ("d", 1.0), ("d", 1.0)], "k string, v double")
    right = spark.createDataFrame([("a", 1.5), ("e", 0.0), ("f", 3.0), (None, 2.5), ("d", 1.4)], "k string, v double")
    link = RelationshipSpec("r", "l", "r", (("k", "k"),))
    rows = reconcile(left, right, link, ReconcileSpec("r", "v", "v", "sum", 0.5)).collect()
    # exactly at the tolerance (a, NULL) and a missing side worth 0 (b, e) are not reported
    assert {(r["key_0"], round(r["difference"], 6)) for r in rows} == {("c", 5.0), ("f", -3.0), ("d", 0.6)}


def test_rule_sql_is_a_query_only(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0)], "id long, v double")
    sources = {"t.x": df}
    assert rule_sql(spark, SqlSpec("SELECT id FROM {{ t.x }} WHERE v > 2"), sources).collect()[0]["id"] == 1
    bad = [
        "SELECT 1",
        "DROP TABLE {{t.x}}",
        "SELECT * FROM {{t.x}}) x; DROP TABLE y",
        "SELECT java_method('java.lang.System', 'gc') FROM {{t.x}}",
        "SELECT * FROM {{other}}",
    ]
    for text in bad:
        with pytest.raises(Exception):
            rule_sql(spark, SqlSpec(text), sources)
    good = [
        "WITH a AS (SELECT id FROM {{t.x}}) SELECT id FROM a WHERE id IN (SELECT id FROM a) AND EXISTS (SELECT 1 FROM {{t.x}} y WHERE y.id = a.id)",
        "SELECT id, (SELECT max(v) FROM {{t.x}}) AS m FROM {{t.x}} JOIN VALUES (1), (2) AS k(id) USING (id)",
    ]
    assert [rule_sql(spark, SqlSpec(text), sources).count() for text in good] == [2, 2]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("assayer_") and t.isTemporary and len(t.name) > 40]


@pytest.mark.parametrize("text", [
    "SELECT `java_method`('java.lang.System', 'currentTimeMillis') FROM {{t}}",
    "SELECT java_method/**/('java.lang.System', 'currentTimeMillis') FROM {{t}}",
    "SELECT try_reflect('java.lang.System', 'currentTimeMillis') FROM {{t}}",
    "SELECT id FROM {{t}} WHERE id IN (SELECT length(reflect('java.lang.System', 'lineSeparator')) FROM {{t}})",
    "SELECT (SELECT `reflect`('java.lang.System', 'lineSeparator') FROM {{t}} LIMIT 1) AS x FROM {{t}}",
    "SELECT t.id FROM {{t}} t, parquet.`FILE`",
    "SELECT id FROM {{t}} WHERE EXISTS (SELECT 1 FROM parquet.`FILE`)",
    "WITH f AS (SELECT count(*) AS n FROM parquet.`FILE`) SELECT id FROM {{t}} JOIN f ON id < n",
    "SELECT t.id FROM {{t}} t JOIN foreign_view f ON t.id = f.id",
    "SELECT * FROM parquet.`FILE` AS {{t}}",
    "SELECT * FROM (SELECT java_method('java.lang.System', 'getProperty', 'java.version') AS v) AS {{t}}",
    "SELECT * FROM (SELECT 1 AS id) AS {{t}}",
    "SELECT * FROM foreign_view AS {{t}}",
    "WITH {{t}} AS (SELECT * FROM foreign_view) SELECT * FROM {{t}}",
    "SELECT /* {{t}} */ 1 AS id",
    "SELECT 1 AS {{t}}",
    "SELECT id FROM VALUES (1), (2) AS {{t}}(id)",
    "SELECT id FROM {{t}} UNION ALL SELECT r_regionkey FROM parquet.`FILE` AS {{t}}",
])
def test_rule_sql_reads_its_sources_only(spark, sf_dir, text):
    spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey AS id").createOrReplaceTempView("foreign_view")
    with pytest.raises(ValueError, match="check SQL must"):
        rule_sql(spark, SqlSpec(text.replace("FILE", f"{sf_dir}/region.parquet")), {"t": spark.range(3)})


def test_robot_order_over_limit(spark):
    orders = spark.createDataFrame(
        [("ORD-1001", "R1", 10, 10_000, "ACCEPTED"), ("ORD-1002", "R1", 50, 25_000, "ACCEPTED"), ("ORD-1003", "R1", 50, 25_000, "REJECTED")],
        "order_id string, robot_id string, quantity int, price_cents int, status string",
    )
    limits = spark.createDataFrame([("R1", True, 10_000.0)], "robot_id string, enabled boolean, max_order_notional_usd double")
    spec = SqlSpec(
        "SELECT o.order_id, double(o.quantity * (o.price_cents / 100.0)) AS notional FROM {{robot_orders}} o "
        "JOIN {{robot_limits}} l ON l.robot_id = o.robot_id WHERE o.status = 'ACCEPTED' AND l.enabled "
        "AND o.quantity * (o.price_cents / 100.0) > l.max_order_notional_usd",
        "order_id",
    )
    rows = rule_sql(spark, spec, {"robot_orders": orders, "robot_limits": limits}).collect()
    assert [(r["order_id"], r["notional"]) for r in rows] == [("ORD-1002", 12500.0)]


def test_bounded_and_vocabulary(spark):
    df = spark.range(10)
    cut = bounded_result(df, 3, [F.asc("id")]).collect()
    assert [r["id"] for r in cut] == [0, 1, 2] and all(r["truncated"] for r in cut)
    assert not any(r["truncated"] for r in bounded_result(df, 10, [F.asc("id")]).collect())
    words = spark.createDataFrame([("A",), ("a",), (None,)], "w string")
    assert [r[0] for r in words.select(in_vocabulary(F.col("w"), ["A"])).collect()] == [True, False, False]


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    plan = top_per_group(df, ["g"], [F.desc("id")], 2)
    assert [r["id"] for r in plan.orderBy("g", "rank").collect()] == [998, 996, 999, 997]
    assert "WindowGroupLimit" in plan._jdf.queryExecution().toString()
