"""Declarative specifications: sources, relationships, checks and texts.

They are validated when built and only describe work; no DataFrame is touched
here.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from typing import Any

# Names that appear in stored results.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
RULE_KINDS = ("sql", "contradiction", "reconciliation", "timeline", "anomaly")
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
AGGREGATIONS = ("sum", "count", "avg", "min", "max")
DATABASE_FORMATS = ("postgresql", "postgres", "greenplum")

_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class SourceSpec:
    source_id: str
    source_type: str = "table"
    location: str = ""
    format: str = "auto"
    enabled: bool = True
    table_name: str | None = None
    expected_fields: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    encoding: str = "utf-8"
    options: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    connection: str | None = None
    query: str | None = None
    schema: str | None = None

    def __post_init__(self) -> None:
        _check(bool(_NAME.fullmatch(self.source_id)), f"invalid source_id {self.source_id!r}")
        _check(self.source_type in ("table", "document"), "source_type must be table or document")
        if self.is_database:
            _check(self.source_type == "table", "a database source must be a table")
            _check(bool(self.connection), "a database source needs a connection alias")
            _check(bool(self.location or self.query), "a database source needs location or query")
        else:
            _check(not (self.connection or self.query), "connection/query belong to database sources")
            _check(bool(self.location), "a file source needs a location")

    @property
    def is_database(self) -> bool:
        return self.format.lower() in DATABASE_FORMATS

    @property
    def view_name(self) -> str:
        name = re.sub(r"\W", "_", self.table_name or self.source_id, flags=re.ASCII).strip("_")
        _check(bool(name), "cannot derive a view name")
        return f"source_{name}" if name[0].isdigit() else name


def unique_sources(sources) -> tuple[SourceSpec, ...]:
    """A source catalog: every id may appear once."""
    sources = tuple(sources)
    _check(len({s.source_id for s in sources}) == len(sources), "source_id values must be unique")
    return sources


@dataclass(frozen=True)
class ConnectionSpec:
    """A registered read replica; the password stays in the environment."""

    host: str
    database: str
    user: str
    password_env: str
    engine: str = "postgresql"
    port: int = 5432
    sslmode: str = "prefer"
    connect_timeout_seconds: int = 15

    def __post_init__(self) -> None:
        _check(self.engine in ("postgresql", "greenplum"), "unsupported engine")
        _check(all((self.host, self.database, self.user, self.password_env)), "incomplete connection")
        _check(1 <= self.port <= 65535, "port out of range")
        _check(1 <= self.connect_timeout_seconds <= 120, "timeout out of range")


@dataclass(frozen=True)
class RelationshipSpec:
    relationship_id: str
    left_source: str
    right_source: str
    keys: tuple[tuple[str, str], ...]
    cardinality: str = "many_to_many"

    def __post_init__(self) -> None:
        _check(len(self.keys) >= 1, "a relationship needs at least one key pair")
        _check(self.cardinality in CARDINALITIES, f"unknown cardinality {self.cardinality!r}")


@dataclass(frozen=True)
class FindingTemplate:
    title: str
    summary: str
    issue_type: str
    root_cause: str
    criterion: str
    risk: str
    severity: str
    recommendation: str | None = None
    confidence: float = 1.0
    tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _check(self.severity in SEVERITIES, f"unknown severity {self.severity!r}")
        _check(0.0 <= self.confidence <= 1.0, "confidence must lie in [0, 1]")


@dataclass(frozen=True)
class SqlSpec:
    query: str
    object_id_column: str | None = None


@dataclass(frozen=True)
class ReconcileSpec:
    relationship_id: str
    left_value: str
    right_value: str
    aggregation: str = "sum"
    tolerance: float = 0.0

    def __post_init__(self) -> None:
        _check(self.aggregation in AGGREGATIONS, f"unknown aggregation {self.aggregation!r}")
        _check(self.tolerance >= 0, "tolerance must not be negative")


@dataclass(frozen=True)
class TimelineSpec:
    source_id: str
    entity_fields: tuple[str, ...]
    timestamp_field: str
    event_field: str
    expected_order: tuple[str, ...]
    max_gap_seconds: int | None = None
    tie_breakers: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _check(len(self.entity_fields) >= 1, "a timeline needs an entity")
        _check(len(self.expected_order) >= 2, "a timeline needs at least two steps")
        _check(self.max_gap_seconds is None or self.max_gap_seconds > 0, "max_gap_seconds must be positive")


@dataclass(frozen=True)
class AnomalySpec:
    source_id: str
    field: str
    group_by: tuple[str, ...] = ()
    method: str = "zscore"
    threshold: float = 3.0

    def __post_init__(self) -> None:
        _check(self.method in ("zscore", "iqr"), f"unknown method {self.method!r}")
        _check(self.threshold > 0, "threshold must be positive")


@dataclass(frozen=True)
class RuleSpec:
    """One declarative check; the specification must match ``kind``.

    All exceptions become findings unless ``max_findings`` bounds them; the
    result then says ``truncated`` and still counts every exception.
    """

    rule_id: str
    kind: str
    source_ids: tuple[str, ...]
    finding: FindingTemplate
    version: str = "1"
    description: str = ""
    tags: tuple[str, ...] = ()
    enabled: bool = True
    max_findings: int | None = None
    sql: SqlSpec | None = None
    reconciliation: ReconcileSpec | None = None
    timeline: TimelineSpec | None = None
    anomaly: AnomalySpec | None = None

    def __post_init__(self) -> None:
        _check(bool(_NAME.fullmatch(self.rule_id)), f"invalid rule_id {self.rule_id!r}")
        _check(self.kind in RULE_KINDS, f"unknown rule kind {self.kind!r}")
        _check(len(self.source_ids) >= 1, f"rule {self.rule_id} needs a source")
        _check(
            self.max_findings is None or self.max_findings > 0,
            "max_findings must be positive",
        )
        given = [s for s in (self.sql, self.reconciliation, self.timeline, self.anomaly) if s is not None]
        _check(
            len(given) == 1 and given[0] is self.spec,
            f"rule {self.rule_id} must carry exactly its {self.kind} specification",
        )

    @property
    def spec(self) -> Any:
        slot = "sql" if self.kind in ("sql", "contradiction") else self.kind
        return getattr(self, slot)

    def contract(self) -> str:
        """Canonical text of the whole rule; its hash identifies the rule version."""
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def reproduction(self) -> str:
        """What to re-run: the rule's SQL, or its specification."""
        if self.sql is not None:
            return self.sql.query
        return json.dumps(asdict(self.spec), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
