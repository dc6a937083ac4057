"""Links between tables, inferred from column names and shared values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import Normalizer, meaningful_words
from ..functions.values import quoted
from .profile import distinct_counts

_WORD_BITS = 62


def candidate_pairs(
    tables: Mapping[str, DataFrame], *, normalize: Normalizer | None = None, minimum: float = 0.5
) -> list[tuple[str, str, str, str, float]]:
    """Column pairs of different tables whose names are alike (schemas only), in table and column order.

    Names that share no word have similarity 0, so pairs come from a join on
    words and ``minimum`` must be above 0.
    """
    if minimum <= 0:
        raise ValueError("minimum must be above 0")
    schema = [
        (t, c, table, column, normalize(column) if normalize else column)
        for t, (table, df) in enumerate(tables.items())
        for c, column in enumerate(df.columns)
    ]
    if not schema:
        return []
    spark = next(iter(tables.values())).sparkSession
    named = spark.createDataFrame(schema, "t int, c int, source string, name string, plain string")
    words = named.withColumn("words", meaningful_words(F.col("plain"))).select(
        F.struct("t", "c", "source", "name", F.size("words").alias("n")).alias("end"), F.explode("words").alias("word"))
    left, right = (words.withColumnRenamed("end", side) for side in ("l", "r"))
    shared = left.join(right, "word").where("l.t < r.t").groupBy("l", "r").agg(F.count("*").alias("common"))
    similarity = F.col("common") / (F.col("l.n") + F.col("r.n") - F.col("common"))
    alike = shared.withColumn("similarity", similarity).where(F.col("similarity") >= minimum)
    found = alike.orderBy("l.t", "r.t", "l.c", "r.c").select(
        F.col("l.source"), F.col("l.name"), F.col("r.source"), F.col("r.name"), "similarity")
    return [tuple(row) for row in found.collect()]


def _memberships(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Number of distinct values per combination of columns holding them.

    Every (column, value) becomes a bit; OR-ing the bits per value is one
    map-side combined aggregation, and counting equal masks leaves a table whose
    size depends on the columns, not on the data.  No value is ever joined.
    """
    words = len(columns) // _WORD_BITS + 1
    cells = None
    for table, df in tables.items():
        mine = [(i, c) for i, (t, c) in enumerate(columns) if t == table]
        if not mine:
            continue
        kinds = {f.name: f.dataType for f in df.schema.fields}
        # Adding 0.0 makes -0.0 and 0.0 one value, as equality does.
        zero = {c: " + 0.0D" if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else "" for _, c in mine}
        pairs = ", ".join(f"struct({i} AS i, trim(CAST({quoted(c)}{zero[c]} AS STRING)) AS value)" for i, c in mine)
        part = df.selectExpr(f"inline(array({pairs}))")
        cells = part if cells is None else cells.unionByName(part)
    masks = [
        F.expr(f"bit_or(if(i div {_WORD_BITS} = {w}, shiftleft(1L, CAST(i % {_WORD_BITS} AS INT)), 0L)) AS m{w}")
        for w in range(words)
    ]
    names = [f"m{w}" for w in range(words)]
    return (
        cells.where("value IS NOT NULL AND value <> ''")
        .groupBy("value")
        .agg(*masks)
        .groupBy(*names)
        .agg(F.count("*").alias("n"))
        .selectExpr("n", f"array({', '.join(names)}) AS mask")
    )


def _overlaps(masks: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Distinct values of either column and of both, per candidate pair."""
    listed = ", ".join(f"struct({i} AS l, {j} AS r)" for i, j in pairs)
    bit = "getbit(mask[{0} div %d], CAST({0} %% %d AS INT)) = 1" % (_WORD_BITS, _WORD_BITS)
    return (
        masks.selectExpr("n", "mask", f"inline(array({listed}))")
        .selectExpr("n", "l", "r", f"{bit.format('l')} AS in_l", f"{bit.format('r')} AS in_r")
        .where("in_l OR in_r")
        .groupBy("l", "r")
        .agg(
            F.expr("sum(if(in_l, n, 0)) AS left_n"),
            F.expr("sum(if(in_r, n, 0)) AS right_n"),
            F.expr("sum(if(in_l AND in_r, n, 0)) AS common"),
        )
    )


def _unique_columns(tables, texts: Mapping[tuple[str, str], int]) -> set[tuple[str, str]]:
    """Columns with as many distinct values as rows, given their distinct trimmed texts.

    Only text columns can have more distinct values than trimmed texts; those
    short of the row count are counted again untrimmed.
    """
    rows = {table: tables[table].count() for table in {t for t, _ in texts}}
    unique, doubtful = set(), {}
    for (table, column), n in texts.items():
        if n == rows[table]:
            unique.add((table, column))
        elif isinstance(tables[table].schema[column].dataType, T.StringType):
            doubtful.setdefault(table, []).append(column)
    for table, names in doubtful.items():
        counted = distinct_counts(tables[table], names).collect()
        unique |= {(table, r["name"]) for r in counted if r["n"] == rows[table]}
    return unique


SCHEMA = (
    "left_source string, left_column string, right_source string, right_column string, "
    "dependency_type string, relationship string, name_similarity double, common_values long, "
    "left_coverage double, right_coverage double, confidence double"
)


def infer_relationships(
    tables: Mapping[str, DataFrame],
    *,
    normalize: Normalizer | None = None,
    key_suffixes: Sequence[str] = ("_id",),
    minimum_similarity: float = 0.5,
    minimum_coverage: float = 0.8,
    minimum_common: int = 2,
) -> DataFrame | None:
    """Column pairs that look like links, with coverage, cardinality and confidence.

    Coverage is measured on the full distinct value sets, so a link between
    large keys is found whatever their size.  The result has at most one row per
    pair of schema columns, so it is built from collected counts; the values
    stay on the executors.  ``None`` when no names are alike.
    """
    candidates = candidate_pairs(tables, normalize=normalize, minimum=minimum_similarity)
    if not candidates:
        return None
    columns = sorted({side for lt, lc, rt, rc, _ in candidates for side in ((lt, lc), (rt, rc))})
    index = {column: i for i, column in enumerate(columns)}
    pairs = {(index[lt, lc], index[rt, rc]): similarity for lt, lc, rt, rc, similarity in candidates}
    counts = _overlaps(_memberships(tables, columns), list(pairs)).where(F.col("common") >= max(1, minimum_common))
    linked = counts.where("greatest(common / left_n, common / right_n) >= %r" % float(minimum_coverage)).collect()
    texts = {columns[r[k]]: r[n] for r in linked for k, n in (("l", "left_n"), ("r", "right_n"))}
    unique = _unique_columns(tables, texts)
    rows = []
    for r in linked:
        left, right = columns[r["l"]], columns[r["r"]]
        covers = (r["common"] / r["left_n"], r["common"] / r["right_n"])
        similarity = pairs[r["l"], r["r"]]
        keyed = all(side[1].lower().endswith(tuple(key_suffixes)) for side in (left, right))
        kind = "join_key_candidate" if keyed else "shared_domain_candidate"
        ends = ["one" if side in unique else "many" for side in (left, right)]
        confidence = min(1.0, 0.65 * max(covers) + 0.35 * similarity)
        rows.append(
            (*left, *right, kind, "_to_".join(ends), round(similarity, 4), r["common"],
             round(covers[0], 4), round(covers[1], 4), round(confidence, 4))
        )
    rows.sort(key=lambda row: (-row[-1], *row[:4]))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, SCHEMA)
