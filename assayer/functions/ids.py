"""Stable identifiers built from SHA-2 and SHA-1, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 namespace for URLs.
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def short_upper(column: Column, length: int) -> Column:
    return F.upper(F.substring(sha256(column), 1, length))


def finding_id(check_id: Column, issue_type: Column, object_id: Column) -> Column:
    key = F.concat(check_id, F.lit("|"), issue_type, F.lit("|"), object_id)
    return F.concat(F.lit("FND-"), short_upper(key, 16))


def evidence_id(run_id: Column, checksum: Column) -> Column:
    return F.concat(F.lit("EVD-"), short_upper(F.concat(run_id, F.lit(":"), checksum), 20))


def plan_id(finding: Column) -> Column:
    return F.concat(F.lit("PLAN-"), short_upper(finding, 12))


def uuid5(key: Column, namespace: str = UUID_NAMESPACE_URL) -> Column:
    """Name-based UUID (version 5) of a text key."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), nibble + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
