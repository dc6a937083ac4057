"""Rare target classifications inside otherwise stable contexts."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sha256, short_upper
from ..functions.values import text_of
from ..scale import attach_small
from .ordering import top_per_group

CANDIDATE_KEY = ("context", "attribute")


@dataclass(frozen=True)
class RouteSpec:
    """A mapping table, the reference table its key leads to, and what to compare."""

    mapping_source: str
    mapping_key: str
    reference_source: str
    reference_key: str
    context_columns: tuple[str, ...]
    target_attributes: tuple[str, ...]
    id_columns: tuple[str, ...]
    confidence: float = 1.0
    min_rows: int = 5
    min_share: float = 0.9
    context_sizes: tuple[int, ...] = field(default=(1, 2))

    def context_sets(self) -> list[tuple[str, ...]]:
        return [c for size in self.context_sizes for c in combinations(self.context_columns, size)]


def _joined(mapping: DataFrame, reference: DataFrame, route: RouteSpec) -> DataFrame:
    ids = list(dict.fromkeys([*route.id_columns, route.mapping_key]))
    left = mapping.select(
        text_of(F.col(f"`{route.mapping_key}`")).alias("__key"),
        *[F.col(f"`{c}`").alias(f"id_{c}") for c in ids],
        *[F.col(f"`{c}`").alias(f"context_{c}") for c in route.context_columns],
    )
    right = reference.select(
        text_of(F.col(f"`{route.reference_key}`")).alias("__key"),
        *[F.col(f"`{c}`").alias(f"target_{c}") for c in route.target_attributes],
    )
    return left.join(right, "__key").drop("__key")


def _tuple_columns(route: RouteSpec) -> list[str]:
    return [f"context_{c}" for c in route.context_columns] + [f"target_{c}" for c in route.target_attributes]


def _views_of(route: RouteSpec) -> Column:
    """Every (context set, attribute) seen from one combination of values."""
    entries = []
    for names in route.context_sets():
        parts = F.struct(*[F.col(f"context_{n}").alias(n) for n in names])
        context = F.to_json(parts, {"ignoreNullFields": "false"})
        for attribute in route.target_attributes:
            entries.append(
                F.struct(
                    F.lit(len(names)).alias("arity"),
                    context.alias("context"),
                    F.lit(attribute).alias("attribute"),
                    text_of(F.col(f"target_{attribute}")).alias("target_value"),
                )
            )
    return F.array(*entries)


def _stable_contexts(views: DataFrame, route: RouteSpec) -> DataFrame:
    """Contexts with a dominant but not universal target value."""
    per_value = views.groupBy("arity", *CANDIDATE_KEY, "target_value").agg(F.sum("n").alias("n"))
    share = F.col("expected_rows") / F.col("joined_rows")
    return (
        per_value.groupBy("arity", *CANDIDATE_KEY)
        .agg(
            F.sum("n").alias("joined_rows"),
            F.count("*").alias("values"),
            F.max("n").alias("expected_rows"),
            F.max_by("target_value", "n").alias("expected_value"),
        )
        .where((F.col("joined_rows") >= route.min_rows) & (F.col("values") >= 2) & (share >= route.min_share))
        .withColumn("share", share)
        .drop("values")
    )


def minority_rows(mapping: DataFrame, reference: DataFrame, route: RouteSpec) -> DataFrame:
    """Joined rows that differ from their context's dominant target value.

    Rows are first counted per full combination of values.  Every context set is
    derived from those counts (the grouping-sets step), so the rows themselves
    are never multiplied; only rows of a deviating combination are joined back.
    """
    base = _joined(mapping, reference, route)
    names = _tuple_columns(route)
    combos = base.groupBy(*names).agg(F.count("*").alias("n"))
    views = combos.select(*names, "n", F.inline(_views_of(route)))
    stable = _stable_contexts(views, route)
    deviating = attach_small(views.drop("n", "arity"), stable, CANDIDATE_KEY).where(
        ~F.col("target_value").eqNullSafe(F.col("expected_value"))
    )
    rows = attach_small(base, deviating, names, null_safe=True)
    facts = ["arity", "joined_rows", "expected_rows", "expected_value", "share", "target_value"]
    return rows.select(*CANDIDATE_KEY, *facts, *_identified(base, route))


def selected_rows(hypotheses: DataFrame, mapping: DataFrame, reference: DataFrame, route: RouteSpec) -> DataFrame:
    """Run the hypotheses' selections on the sources once more: the joined rows that each one selects.

    ``hypotheses`` has hypothesis_id, context, attribute and expected_value; a row is selected where its
    context is the same and its target's attribute is not the expected one.
    """
    base = _joined(mapping, reference, route)
    names = _tuple_columns(route)
    views = base.groupBy(*names).agg(F.count("*").alias("n")).select(*names, F.inline(_views_of(route)))
    wanted = hypotheses.select("hypothesis_id", *CANDIDATE_KEY, "expected_value")
    selected = attach_small(views.drop("arity"), wanted, CANDIDATE_KEY).where(
        ~F.col("target_value").eqNullSafe(F.col("expected_value")))
    rows = attach_small(base, selected.drop(*CANDIDATE_KEY), names, null_safe=True)
    return rows.select("hypothesis_id", "expected_value", "target_value", *_identified(base, route))


def _identified(base: DataFrame, route: RouteSpec) -> list[Column]:
    """Identity, object and sample of a joined row."""
    identity = F.concat_ws(
        "|", *[F.coalesce(text_of(F.col(f"id_{c}")), F.lit("None")) for c in route.id_columns]
    )
    preferred = [c for c in route.id_columns if c.lower() == "rule_id" or c.lower().endswith("_rule_id")]
    objects = [
        F.when(F.trim(text_of(F.col(f"id_{c}"))) != "", text_of(F.col(f"id_{c}")))
        for c in (*preferred, route.mapping_key)
    ]
    members = [F.col(name).alias(name.removeprefix("id_")) for name in base.columns]
    return [
        identity.alias("row_id"),
        F.coalesce(*objects).alias("object_id"),
        text_of(F.col(f"id_{route.mapping_key}")).alias("target_key"),
        F.to_json(F.struct(*members), {"ignoreNullFields": "false"}).alias("sample"),
    ]


# A hypothesis as data: which sources to join by which keys, and which of the joined rows to select.
ROUTE_FIELDS = (
    ("mapping_source", "string"), ("mapping_key", "string"), ("reference_source", "string"), ("reference_key", "string"),
    ("id_columns", "array<string>"), ("context_columns", "array<string>"), ("target_attributes", "array<string>"),
    ("context_sizes", "array<int>"),
)
PREDICATE_FIELDS = ("context", "attribute", "expected_value")
SELECTION = "struct<" + ",".join(f"{n}:{t}" for n, t in ROUTE_FIELDS) + "".join(f",{n}:string" for n in PREDICATE_FIELDS) + ">"


def _selection(route: RouteSpec, best: Column) -> Column:
    constants = []
    for name, kind in ROUTE_FIELDS:
        value = getattr(route, name)
        constant = F.array(*[F.lit(v) for v in value]).cast(kind) if kind.startswith("array") else F.lit(value)
        constants.append(constant.alias(name))
    predicate = [best[name].alias(name) for name in PREDICATE_FIELDS]
    return F.to_json(F.struct(*constants, *predicate), {"ignoreNullFields": "false"})


def _set_fingerprint(column: Column) -> list[Column]:
    """Order-free fingerprint of a multiset: its size and sums of 4 x 60 hash bits."""
    digest = sha256(column)
    pieces = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return [F.count("*").alias("mismatch_rows"), *[F.sum(p).alias(f"__s{i}") for i, p in enumerate(pieces)]]


def contextual_outliers(minority: DataFrame, route: RouteSpec) -> DataFrame:
    """One candidate per (context, attribute) with its statistics.

    ``rows_key`` identifies the *set* of deviating rows without collecting it.
    """
    confidence = F.least(F.lit(0.99), F.lit(float(route.confidence)) * F.col("share"))
    stats = ["arity", "joined_rows", "expected_value", "share"]
    return (
        minority.groupBy(*CANDIDATE_KEY, *stats)
        .agg(*_set_fingerprint(F.col("row_id")))
        .select(
            *CANDIDATE_KEY,
            "arity",
            "expected_value",
            "joined_rows",
            "mismatch_rows",
            F.round(F.col("mismatch_rows") / F.col("joined_rows"), 6).alias("mismatch_ratio"),
            F.round(confidence, 4).alias("confidence"),
            F.concat_ws(":", text_of(F.col("mismatch_rows")), *[text_of(F.col(f"__s{i}")) for i in range(4)]).alias(
                "rows_key"
            ),
        )
    )


def merge_outlier_candidates(candidates: DataFrame, route: RouteSpec) -> DataFrame:
    """Candidates about the same set of rows become one hypothesis.

    Attributes are united; the statistics come from the most specific context,
    by (number of context columns, confidence, context text, attribute).
    """
    order = F.struct("arity", "confidence", "context", "attribute")
    per_attribute = candidates.groupBy("rows_key", "attribute").agg(
        F.max_by(F.struct("arity", "confidence", *CANDIDATE_KEY, "expected_value", "joined_rows", "mismatch_rows", "mismatch_ratio"), order).alias("best"),
    )
    best_order = F.struct("best.arity", "best.confidence", "best.context", "best.attribute")
    merged = per_attribute.groupBy("rows_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("attribute"), F.col("best.expected_value").alias("expected")))).alias("parts"),
        F.max_by("best", best_order).alias("best"),
    )
    source = [route.mapping_source, route.mapping_key, route.reference_source, route.reference_key]
    identity = F.concat_ws("|", *[F.lit(s) for s in source], F.col("rows_key"))
    return merged.select(
        F.concat(F.lit("BIZ-"), short_upper(identity, 16)).alias("hypothesis_id"),
        F.lit("contextual_target_outlier").alias("kind"),
        F.lit("POTENTIAL_RISK").alias("status"),
        F.lit(route.mapping_source).alias("mapping_source"),
        F.lit(route.mapping_key).alias("mapping_target_key"),
        F.lit(route.reference_source).alias("reference_source"),
        F.lit(route.reference_key).alias("reference_key"),
        F.array_join(F.transform("parts", lambda p: p["attribute"]), ", ").alias("attribute"),
        F.map_from_arrays(
            F.transform("parts", lambda p: p["attribute"]), F.transform("parts", lambda p: p["expected"])
        ).alias("outlier_attributes"),
        F.col("best.context").alias("context"),
        F.col("best.attribute").alias("context_attribute"),
        F.col("best.expected_value").alias("expected_value"),
        F.col("best.joined_rows").alias("joined_rows"),
        F.col("best.mismatch_rows").alias("mismatch_rows"),
        F.col("best.mismatch_ratio").alias("mismatch_ratio"),
        F.lit("OUTLIER").alias("pattern"),
        F.col("best.confidence").alias("confidence"),
        "rows_key",
        _selection(route, F.col("best")).alias("selection"),
    )


def hypothesis_rows(hypotheses: DataFrame, minority: DataFrame) -> DataFrame:
    """The deviating rows behind each hypothesis, from its chosen context."""
    wanted = hypotheses.select("hypothesis_id", "context", F.col("context_attribute").alias("attribute"))
    return attach_small(minority, wanted, CANDIDATE_KEY)


def hypothesis_samples(hypotheses: DataFrame, minority: DataFrame, k: int = 20) -> DataFrame:
    rows = hypothesis_rows(hypotheses, minority).select("hypothesis_id", "row_id", "object_id", "target_key", "sample")
    return top_per_group(rows, ["hypothesis_id"], [F.asc("row_id"), F.asc("sample")], k)

