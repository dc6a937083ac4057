"""Audit analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .plans.run import (
    AuditRun,
    build_findings,
    list_data_sources,
    profile_data_source,
    run_full_audit,
    run_rule,
    run_rule_group,
    search_documents,
)
from .specs import (
    AnomalySpec,
    ConnectionSpec,
    FindingTemplate,
    ReconcileSpec,
    RelationshipSpec,
    RuleSpec,
    SourceSpec,
    SqlSpec,
    TimelineSpec,
)

# Functions of this package travel to the Python workers by value, so executors
# need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "AnomalySpec",
    "AuditRun",
    "ConnectionSpec",
    "FindingTemplate",
    "ReconcileSpec",
    "RelationshipSpec",
    "RuleSpec",
    "SourceSpec",
    "SqlSpec",
    "TimelineSpec",
    "build_findings",
    "list_data_sources",
    "profile_data_source",
    "run_full_audit",
    "run_rule",
    "run_rule_group",
    "search_documents",
]
