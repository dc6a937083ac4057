"""Links between the given tables, untypical routes, lineage."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import hypotheses as hyp
from ..operators import outliers as out
from ..operators.lineage import declared_edges, impact_paths, lineage_edges
from ..operators.profile import profile_table
from ..operators.relationships import candidate_pairs, infer_relationships
from ..operators.roles import attribute_roles, infer_column_roles
from ..operators.evidence import verify_evidence
from ..plans.run import analyze_business_logic
from ..specs import RelationshipSpec
from .registry import query, table

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
# Key-like columns of the star tables, by the shared part of their names.
_STAR_PAIRS = [
    ("region", "r_regionkey", "nation", "n_regionkey"),
    ("region", "r_name", "nation", "n_name"),
    ("region", "r_name", "customer", "c_name"),
    ("region", "r_name", "supplier", "s_name"),
    ("region", "r_name", "part", "p_name"),
    ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("nation", "n_name", "customer", "c_name"),
    ("nation", "n_nationkey", "supplier", "s_nationkey"),
    ("nation", "n_name", "supplier", "s_name"),
    ("nation", "n_name", "part", "p_name"),
    ("customer", "c_name", "supplier", "s_name"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"),
    ("customer", "c_acctbal", "supplier", "s_acctbal"),
    ("customer", "c_name", "part", "p_name"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("supplier", "s_name", "part", "p_name"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
]
_DOC_PAIRS = [("documents", "doc_id", "labels", "doc_id")]


def strip_prefix(name: str) -> str:
    """``o_custkey`` and ``c_custkey`` name the same thing."""
    return re.sub(r"^[a-z]_", "", name)


def relationship_sql(pairs, suffixes=("_id",)) -> str:
    """Distinct text values of both columns, their overlap and the resulting confidence."""
    parts = []
    for lt, lc, rt, rc in pairs:
        keyed = lc.endswith(suffixes) and rc.endswith(suffixes)
        kind = "join_key_candidate" if keyed else "shared_domain_candidate"
        parts.append(
            f"SELECT '{lt}' AS left_source, '{lc}' AS left_column, '{rt}' AS right_source, '{rc}' AS right_column, "
            f"'{kind}' AS dependency_type, "
            f"(SELECT count(DISTINCT {lc}) = count(*) FROM {lt}) AS lu, (SELECT count(DISTINCT {rc}) = count(*) FROM {rt}) AS ru, "
            f"(SELECT count(DISTINCT trim(CAST({lc} AS VARCHAR))) FROM {lt}) AS ln, "
            f"(SELECT count(DISTINCT trim(CAST({rc} AS VARCHAR))) FROM {rt}) AS rn, "
            f"(SELECT count(*) FROM (SELECT DISTINCT trim(CAST({lc} AS VARCHAR)) AS v FROM {lt} "
            f"INTERSECT SELECT DISTINCT trim(CAST({rc} AS VARCHAR)) FROM {rt})) AS common_values"
        )
    return (
        "SELECT left_source, left_column, right_source, right_column, dependency_type, "
        "CASE WHEN lu AND ru THEN 'one_to_one' WHEN lu THEN 'one_to_many' WHEN ru THEN 'many_to_one' ELSE 'many_to_many' END AS relationship, "
        "1.0::DOUBLE AS name_similarity, common_values, round(common_values::DOUBLE / ln, 4) AS left_coverage, "
        "round(common_values::DOUBLE / rn, 4) AS right_coverage, "
        "round(least(1.0::DOUBLE, 0.65::DOUBLE * greatest(common_values::DOUBLE / ln, common_values::DOUBLE / rn) + 0.35::DOUBLE), 4) AS confidence "
        f"FROM ({' UNION ALL '.join(parts)}) WHERE common_values >= 2 "
        "AND greatest(common_values::DOUBLE / ln, common_values::DOUBLE / rn) >= 0.8"
    )


def star_links(spark, sf_dir):
    frames = {n: table(spark, sf_dir, n) for n in STAR}
    return infer_relationships(frames, normalize=strip_prefix, key_suffixes=("_id", "key"))


STAR_SQL = relationship_sql(_STAR_PAIRS, ("_id", "key"))


@query("infer_relationships", relationship_sql(_DOC_PAIRS))
def q_links(spark, sf_dir):
    return infer_relationships({n: table(spark, sf_dir, n) for n in ("documents", "labels")})


@query("infer_relationships_star", STAR_SQL)
def q_star_links(spark, sf_dir):
    return star_links(spark, sf_dir)


def expected_star_pairs(spark, sf_dir):
    frames = {n: table(spark, sf_dir, n) for n in STAR}
    return [p[:4] for p in candidate_pairs(frames, normalize=strip_prefix)]


# Documents seen as routes to labelled accounts: the shape role inference looks for.
_ROUTES = {"doc_id": "rule_id", "lang": "asset_class", "source": "business_unit", "n_chars": "valid_from"}


def _routes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*_ROUTES)
    return docs.withColumnsRenamed(_ROUTES).withColumn("target_account_id", F.col("rule_id"))


def _accounts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("account_id"), F.col("toxic").alias("entity_class"))


@query("infer_column_roles", """
WITH c AS (SELECT count(*)::DOUBLE AS common FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)),
     n AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS ln, (SELECT count(DISTINCT doc_id) FROM labels) AS rn)
SELECT 'routes' AS mapping_source, 'target_account_id' AS mapping_key, 'accounts' AS reference_source, 'account_id' AS reference_key,
       round(least(1.0::DOUBLE, 0.65::DOUBLE * greatest(common / ln, common / rn) + 0.35::DOUBLE), 4) AS confidence
FROM c, n
WHERE (SELECT count(DISTINCT doc_id) = count(*) FROM labels) AND common >= 2 AND greatest(common / ln, common / rn) >= 0.8
""")
def q_roles(spark, sf_dir):
    frames = {"routes": _routes(spark, sf_dir), "accounts": _accounts(spark, sf_dir)}
    profiles = None
    for name, df in frames.items():
        part = profile_table(df, name)
        profiles = part if profiles is None else profiles.unionByName(part)
    return infer_column_roles(profiles, infer_relationships(frames))


@query("attribute_roles", """
SELECT 'routes' AS source_id, 'asset_class' AS column_name, 1 AS place WHERE (SELECT count(DISTINCT lang) FROM documents) >= 1
UNION ALL SELECT 'routes', 'business_unit', 2 WHERE (SELECT count(DISTINCT source) FROM documents) >= 1
""")
def q_attribute_roles(spark, sf_dir):
    return attribute_roles(profile_table(_routes(spark, sf_dir), "routes"))


ROUTE = out.RouteSpec(
    "documents", "doc_id", "labels", "doc_id", ("lang", "source"), ("toxic", "quality"), ("doc_id",), 0.97
)


def outlier_rows(spark, sf_dir):
    return out.minority_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ROUTE)


_LANG, _SOURCE = ("lang", "lang"), ("source", "source")
_CONTEXTS = [(_LANG,), (_SOURCE,), (_LANG, _SOURCE)]


def _context_json(names) -> str:
    members = ", ',', ".join(f"'\"{shown}\":\"', {column}, '\"'" for shown, column in names)
    return f"concat('{{', {members}, '}}')"


def minority_sql(contexts, targets, confidence: str) -> str:
    """CTEs j .. c: joined rows, contexts with a dominant value, deviating rows, candidates.

    ``contexts`` are tuples of (shown name, column), ``targets`` (shown name, column).
    """
    views = " UNION ALL ".join(
        f"SELECT doc_id, {len(names)} AS arity, {_context_json(names)} AS context, '{shown}' AS attribute, {column} AS tgt FROM j"
        for names in contexts
        for shown, column in targets
    )
    return (
        "j AS (SELECT d.doc_id, d.lang, d.source, l.toxic, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
        f"v AS ({views}), g AS (SELECT arity, context, attribute, tgt, count(*) AS n FROM v GROUP BY ALL), "
        "t AS (SELECT *, sum(n) OVER w AS tot, count(*) OVER w AS nv, row_number() OVER (PARTITION BY context, attribute ORDER BY n DESC) AS rn "
        "FROM g WINDOW w AS (PARTITION BY context, attribute)), "
        "s AS (SELECT arity, context, attribute, tgt AS expected, n AS expected_rows, tot AS joined_rows FROM t "
        "WHERE rn = 1 AND tot >= 5 AND nv >= 2 AND n::DOUBLE / tot >= 0.9), "
        "m AS (SELECT v.doc_id, v.tgt, s.* FROM v JOIN s ON v.context = s.context AND v.attribute = s.attribute AND v.tgt IS DISTINCT FROM s.expected), "
        "c AS (SELECT arity, context, attribute, expected, joined_rows, count(*) AS mismatch_rows, "
        "round(count(*)::DOUBLE / max(joined_rows), 6) AS mismatch_ratio, "
        f"round(least(0.99::DOUBLE, {confidence}::DOUBLE * (max(expected_rows)::DOUBLE / max(joined_rows))), 4) AS confidence, "
        "string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, min(doc_id::VARCHAR) AS first_id FROM m GROUP BY ALL)"
    )


MINORITY_SQL = minority_sql(_CONTEXTS, [("toxic", "toxic"), ("quality", "quality")], "0.97")

_MERGED_SQL = (
    ", a AS (SELECT *, row_number() OVER (PARTITION BY ids ORDER BY arity DESC, confidence DESC, context DESC, attribute DESC) AS rn FROM c), "
    "h AS (SELECT a.context, a.joined_rows, a.mismatch_rows, a.mismatch_ratio, a.confidence, a.first_id, a.ids, "
    "(SELECT string_agg(DISTINCT x.attribute, ', ' ORDER BY x.attribute) FROM c x WHERE x.ids = a.ids) AS attribute "
    "FROM a WHERE rn = 1)"
)


@query("outlier_rows", f"WITH {MINORITY_SQL} SELECT doc_id::VARCHAR AS row_id, context, attribute, expected::VARCHAR AS expected_value, "
       "tgt::VARCHAR AS target_value, joined_rows::BIGINT AS joined_rows FROM m")
def q_outlier_rows(spark, sf_dir):
    return outlier_rows(spark, sf_dir).select(
        "row_id", "context", "attribute", "expected_value", "target_value", "joined_rows"
    )


@query("contextual_outliers", f"WITH {MINORITY_SQL} SELECT context, attribute, expected::VARCHAR AS expected_value, "
       "joined_rows::BIGINT AS joined_rows, mismatch_rows, mismatch_ratio, confidence FROM c")
def q_outliers(spark, sf_dir):
    return out.contextual_outliers(outlier_rows(spark, sf_dir), ROUTE).select(
        "context", "attribute", "expected_value", "joined_rows", "mismatch_rows", "mismatch_ratio", "confidence"
    )


def _hypotheses(spark, sf_dir):
    minority = outlier_rows(spark, sf_dir)
    return out.merge_outlier_candidates(out.contextual_outliers(minority, ROUTE), ROUTE), minority


@query("merge_outlier_candidates", f"WITH {MINORITY_SQL}{_MERGED_SQL} SELECT attribute, context, joined_rows::BIGINT AS joined_rows, "
       "mismatch_rows, mismatch_ratio, confidence, 'OUTLIER' AS pattern FROM h")
def q_merge(spark, sf_dir):
    return _hypotheses(spark, sf_dir)[0].select(
        "attribute", "context", "joined_rows", "mismatch_rows", "mismatch_ratio", "confidence", "pattern"
    )


@query("hypothesis_samples", f"WITH {MINORITY_SQL}{_MERGED_SQL} SELECT h.context, x.doc_id AS row_id, x.rank FROM h JOIN LATERAL ("
       "SELECT u.doc_id, CAST(row_number() OVER (ORDER BY u.doc_id) AS INTEGER) AS rank FROM (SELECT unnest(string_split(h.ids, ',')) AS doc_id) u) x "
       "ON true WHERE x.rank <= 3")
def q_samples(spark, sf_dir):
    found, minority = _hypotheses(spark, sf_dir)
    samples = out.hypothesis_samples(found, minority, 3)
    return samples.join(found.select("hypothesis_id", "context"), "hypothesis_id").select("context", "row_id", "rank")


def _investigated(spark, sf_dir):
    """The hypotheses' selections run on documents and labels again."""
    found, _ = _hypotheses(spark, sf_dir)
    sources = {name: table(spark, sf_dir, name) for name in ("documents", "labels")}
    return found, hyp.investigate_hypotheses(found, sources, run_id="RUN-CATALOGUE", minimum_confidence=0.93)


@query("investigate_hypotheses", f"WITH {MINORITY_SQL}{_MERGED_SQL} SELECT context, attribute, confidence, "
       "mismatch_rows AS reproduced_rows, CASE WHEN confidence < 0.93 THEN 'BELOW_MATERIALITY_THRESHOLD' ELSE 'PROMOTED_TO_FINDING' END AS investigation, "
       "first_id AS object_id, CASE WHEN confidence >= 0.93 THEN concat('FND-', upper(substr(sha256(concat("
       "'BUSINESS_SEMANTIC_CONSTRAINT|semantic_target_mismatch|', first_id)), 1, 16))) END AS finding_id FROM h")
def q_investigate(spark, sf_dir):
    return _investigated(spark, sf_dir)[1].hypotheses.select(
        "context", "attribute", "confidence", "reproduced_rows", "investigation", "object_id", "finding_id"
    )


_EVEN_SQL = (
    "(SELECT count(*) FROM (SELECT unnest(string_split(h.ids, ',')) AS id) u WHERE id::BIGINT % 2 = 0)"
)


@query("rerun_hypotheses", f"WITH {MINORITY_SQL}{_MERGED_SQL}, x AS (SELECT *, {_EVEN_SQL} AS n FROM h) SELECT context, attribute, "
       "n AS reproduced_rows, "
       "CASE WHEN confidence < 0.8 THEN 'BELOW_MATERIALITY_THRESHOLD' WHEN n = 0 THEN 'NOT_REPRODUCED' ELSE 'PROMOTED_TO_FINDING' END AS investigation FROM x "
       "UNION ALL SELECT context, attribute, 0, CASE WHEN confidence < 0.8 THEN 'BELOW_MATERIALITY_THRESHOLD' ELSE 'ERROR' END FROM x")
def q_rerun(spark, sf_dir):
    """The selections of all hypotheses, run once where the odd labels are gone and once where a source lacks its key."""
    found, _ = _hypotheses(spark, sf_dir)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    changed = hyp.investigate_hypotheses(found, {"documents": documents, "labels": labels.where("doc_id % 2 = 0")}, run_id="RUN-CATALOGUE")
    broken = hyp.investigate_hypotheses(found, {"documents": documents, "labels": labels.drop("doc_id")}, run_id="RUN-CATALOGUE")
    columns = ["context", "attribute", "reproduced_rows", "investigation"]
    return changed.hypotheses.select(*columns).unionAll(broken.hypotheses.select(*columns))


@query("hypothesis_evidence", f"WITH {MINORITY_SQL}{_MERGED_SQL} SELECT context, first_id AS object_id, 'documents,labels' AS source_ids, "
       "mismatch_rows AS reproduced_rows, true AS verified FROM h WHERE confidence >= 0.93")
def q_hypothesis_evidence(spark, sf_dir):
    """The stored record behind each promoted hypothesis, and whether its checksum and id follow from its content."""
    investigation = _investigated(spark, sf_dir)[1]
    wrong = verify_evidence(investigation.evidence).select("evidence_id", F.lit(False).alias("right"))
    return investigation.evidence.join(wrong, "evidence_id", "left").select(
        F.get_json_object("query", "$.context").alias("context"), "object_id", F.array_join("source_ids", ",").alias("source_ids"),
        F.get_json_object("result", "$.reproduced_rows").cast("long").alias("reproduced_rows"),
        F.coalesce("right", F.lit(True)).alias("verified"),
    )


@query("hypothesis_coverage", f"WITH {MINORITY_SQL}{_MERGED_SQL} SELECT context, CASE WHEN confidence < 0.93 THEN 'MISSING_FINDING' "
       "WHEN mismatch_rows > 3 THEN 'MISSING_REVIEW' ELSE 'REQUIRES_VALIDATION' END AS verdict FROM h WHERE confidence >= 0.8")
def q_coverage(spark, sf_dir):
    found, investigation = _investigated(spark, sf_dir)
    done = investigation.hypotheses
    promoted = done.where("finding_id IS NOT NULL")
    # Findings are told apart by hypothesis here, as two may share an object.
    keyed = promoted.select("hypothesis_id", F.concat_ws(":", "finding_id", "hypothesis_id").alias("finding_id"), "mismatch_rows")
    reviews = keyed.where("mismatch_rows <= 3").select("finding_id", F.lit("REQUIRES_VALIDATION").alias("verdict"))
    coverage = hyp.hypothesis_coverage(done.where("confidence >= 0.8").select("hypothesis_id"), keyed, reviews)
    return coverage.join(done.select("hypothesis_id", "context"), "hypothesis_id").select("context", "verdict")


@query("hypothesis_plan", f"WITH {MINORITY_SQL}{_MERGED_SQL} SELECT CASE WHEN confidence >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, "
       "'POTENTIAL_RISK' AS status, concat('Untypical value of ', attribute) AS title, concat(mismatch_rows, ' of ', joined_rows, "
       "' comparable routes differ from the dominant value') AS rationale FROM h WHERE confidence < 0.93")
def q_hypothesis_plan(spark, sf_dir):
    found, investigation = _investigated(spark, sf_dir)
    done = investigation.hypotheses
    return hyp.hypothesis_plan(found, done.where("finding_id IS NOT NULL")).select("priority", "status", "title", "rationale")


DECLARED = (
    RelationshipSpec("region_nation", "region", "nation", (("r_regionkey", "n_regionkey"),), "one_to_many"),
    RelationshipSpec("order_line", "orders", "lineitem", (("o_orderkey", "l_orderkey"),), "one_to_many"),
)
_EDGES_SQL = (
    f"WITH RECURSIVE rel AS ({STAR_SQL}), alle AS ("
    "SELECT 'region' AS left_source, 'r_regionkey' AS left_column, 'nation' AS right_source, 'n_regionkey' AS right_column, "
    "1.0::DOUBLE AS confidence, 'declared_relationship' AS basis "
    "UNION ALL SELECT 'orders', 'o_orderkey', 'lineitem', 'l_orderkey', 1.0, 'declared_relationship' "
    "UNION ALL SELECT left_source, left_column, right_source, right_column, confidence, 'inferred_join_key' FROM rel "
    "WHERE dependency_type = 'join_key_candidate' AND confidence >= 0.8), "
    "e AS (SELECT left_source, left_column, right_source, right_column, confidence, basis FROM ("
    "SELECT *, row_number() OVER (PARTITION BY left_source, left_column, right_source, right_column "
    "ORDER BY confidence DESC, basis) AS rn FROM alle) WHERE rn = 1)"
)


@query("lineage_edges", f"{_EDGES_SQL} SELECT * FROM e")
def q_edges(spark, sf_dir):
    return lineage_edges(declared_edges(spark, DECLARED), star_links(spark, sf_dir))


@query("impact_paths", _EDGES_SQL + """,
s AS (SELECT DISTINCT left_source AS f, right_source AS t FROM e UNION SELECT DISTINCT right_source, left_source FROM e),
p AS (SELECT r AS seed, r AS node, [r] AS nodes, 0 AS depth FROM (SELECT 'region' AS r UNION ALL SELECT 'part')
      UNION ALL SELECT p.seed, s.t, list_append(p.nodes, s.t), p.depth + 1 FROM p JOIN s ON p.node = s.f
      WHERE NOT list_contains(p.nodes, s.t)),
short AS (SELECT seed, node, min(depth) AS d FROM p GROUP BY 1, 2)
SELECT p.seed, p.depth, p.node AS target, array_to_string(p.nodes, '>') AS path
FROM p JOIN short ON p.seed = short.seed AND p.node = short.node AND p.depth = short.d WHERE p.depth > 0
""")
def q_paths(spark, sf_dir):
    edges = lineage_edges(declared_edges(spark, DECLARED), star_links(spark, sf_dir))
    seeds = spark.createDataFrame([("region",), ("part",)], "seed string")
    return impact_paths(edges, seeds).select("seed", "depth", "target", "path")


_ASSET, _UNIT = ("asset_class", "lang"), ("business_unit", "source")
_LINK_CONFIDENCE = (
    "(SELECT least(1.0::DOUBLE, 0.65::DOUBLE * greatest(k / (SELECT count(DISTINCT doc_id) FROM documents), "
    "k / (SELECT count(DISTINCT doc_id) FROM labels)) + 0.35::DOUBLE) "
    "FROM (SELECT count(*)::DOUBLE AS k FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)))"
)
_ROUTE_SQL = minority_sql([(_ASSET,), (_UNIT,), (_ASSET, _UNIT)], [("entity_class", "toxic")], _LINK_CONFIDENCE)


@query("analyze_business_logic", f"WITH {_ROUTE_SQL}{_MERGED_SQL} SELECT 'routes' AS mapping_source, 'accounts' AS reference_source, "
       "attribute, context, joined_rows::BIGINT AS joined_rows, mismatch_rows, mismatch_ratio, confidence FROM h")
def q_business(spark, sf_dir):
    """Profiles, links, roles and outliers in one go, nothing told beforehand."""
    frames = {"routes": _routes(spark, sf_dir), "accounts": _accounts(spark, sf_dir)}
    profiles = None
    for name, df in frames.items():
        part = profile_table(df, name)
        profiles = part if profiles is None else profiles.unionByName(part)
    analysis = analyze_business_logic(spark, frames, profiles, infer_relationships(frames))
    return analysis.hypotheses.select(
        "mapping_source", "reference_source", "attribute", "context", "joined_rows", "mismatch_rows", "mismatch_ratio", "confidence"
    )
