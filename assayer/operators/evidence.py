"""Checksummed evidence for every exception row."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.values import canonical_json, quoted, text_of
from ..scale import join_on
from ..specs import RuleSpec

EVIDENCE_COLUMNS = (
    "run_id", "evidence_id", "checksum", "rule_id", "rule_version", "rule_hash", "rule_kind",
    "source_ids", "object_id", "query", "result",
)
EVIDENCE_FORMAT = r"^EVD-[A-F0-9]{20}$"


# The checksum covers this JSON text of the rule and object, then the row itself.
_CONTENT = (
    "concat(to_json(struct(query, rule_hash, rule_id, rule_kind, rule_version, source_ids, object_id)), '|', result)"
)


def content_checksum() -> Column:
    """The checksum of a record's content, from its columns."""
    return F.expr(f"sha2({_CONTENT}, 256)")


def row_object_id(exceptions: DataFrame, column: str | None) -> Column:
    """The named column's text, else 20 hex digits of the row's own hash."""
    own = F.substring(ids.sha256(canonical_json(exceptions, exceptions.columns)), 1, 20)
    return own if column is None else F.coalesce(text_of(F.col(quoted(column))), own)


def build_evidence(
    exceptions: DataFrame,
    rule: RuleSpec,
    run_id: str,
    object_id_column: str | None = None,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One evidence record per exception row; equal rows give equal ids in a run.

    ``keep`` adds further columns computed from the exception row.  Each stage
    builds on the one before, so no hash is computed twice.
    """
    sources = F.array(*[F.lit(s) for s in rule.source_ids])
    row = exceptions.select(
        canonical_json(exceptions, exceptions.columns).alias("result"),
        (F.lit(None) if object_id_column is None else F.col(quoted(object_id_column))).cast("string").alias("named"),
        *[c.alias(n) for n, c in (keep or {}).items()],
    )
    described = row.select(
        "result",
        F.expr("coalesce(named, substring(sha2(result, 256), 1, 20))").alias("object_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(rule.reproduction()).alias("query"),
        F.lit(hashlib.sha256(rule.contract().encode()).hexdigest()).alias("rule_hash"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.kind).alias("rule_kind"),
        F.lit(rule.version).alias("rule_version"),
        sources.alias("source_ids"),
        *(keep or {}),
    )
    summed = described.selectExpr("*", f"sha2({_CONTENT}, 256) AS checksum")
    identified = summed.withColumn("evidence_id", ids.evidence_id(F.col("run_id"), F.col("checksum")))
    return identified.select(*EVIDENCE_COLUMNS, *(keep or {}))


def verify_evidence(evidence: DataFrame) -> DataFrame:
    """Records whose checksum or id does not follow from their content."""
    expected = content_checksum()
    wrong = ~F.col("checksum").eqNullSafe(F.col("expected_checksum"))
    malformed = ~F.coalesce(F.col("evidence_id").rlike(EVIDENCE_FORMAT), F.lit(False))
    # Asked only where the checksum is the expected one, so the content is hashed once.
    foreign = ~F.col("evidence_id").eqNullSafe(ids.evidence_id(F.col("run_id"), F.col("checksum")))
    return (
        evidence.withColumn("expected_checksum", expected)
        .where(wrong | malformed | foreign)
        .select("run_id", "evidence_id", "checksum", "expected_checksum", malformed.alias("malformed_id"))
    )


def get_evidence(evidence: DataFrame, run_id: str, evidence_id: str) -> DataFrame:
    """One record, only if it verifies."""
    if not re.fullmatch(EVIDENCE_FORMAT, evidence_id):
        raise ValueError("invalid evidence id")
    record = evidence.where((F.col("run_id") == run_id) & (F.col("evidence_id") == evidence_id))
    return join_on(record, verify_evidence(record), ["run_id", "evidence_id"], "left_anti")


def new_evidence(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Records not stored yet, one per id (writing twice changes nothing)."""
    return join_on(evidence.dropDuplicates(["run_id", "evidence_id"]), stored, ["run_id", "evidence_id"], "left_anti")


def evidence_collisions(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids already stored with another checksum."""
    known = stored.select("run_id", "evidence_id", F.col("checksum").alias("stored_checksum"))
    return join_on(evidence, known, ["run_id", "evidence_id"]).where("checksum <> stored_checksum").select(
        "run_id", "evidence_id", "checksum", "stored_checksum"
    )
