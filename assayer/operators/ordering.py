"""Row-before lookups and exact grouped quantiles that survive a hot group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import quoted
from ..scale import HOT_GROUP_ROWS, checked_broadcast, join_on, stored

# Rounds of narrowing stop where a bracket holds at most this many rows.
GATHERED_ROWS = 1_000_000
# Cells of the histogram that narrows a bracket, and accuracy of its sketch.
CELLS = 256
SKETCH_ACCURACY = 20 * CELLS


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie_breakers: Sequence[str],
    values: dict[str, str],
    *,
    max_group_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add ``values[new] = old``: the value of ``old`` in the row before, per ``keys``.

    Rows are ordered by time (NULL last), then by the tie-breakers.  Group sizes are counted first
    (column-pruned and combined before the shuffle).  Groups of at most ``max_group_rows`` are one
    window.  The rows of larger ones are dealt by ranges of (keys, time, tie-breakers, row), so the
    rows of a group, of a second or without a time lie in as many ranges as they need; the window then
    runs per range, and the first row of a range takes its values from the last row of the range before.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot = stored(groups.where(F.col("__rows") > max_group_rows))
    total = hot.agg(F.sum("__rows")).first()[0]
    if total is None:
        return _lag(df, keys, time, tie_breakers, values)
    large = checked_broadcast(hot.drop("__rows"))
    usual = _lag(join_on(df, large, keys, "left_anti", null_safe=True), keys, time, tie_breakers, values)
    crowded = join_on(df, large, keys, "left_semi", null_safe=True)
    return usual.unionByName(_lag_over_ranges(crowded, keys, time, tie_breakers, values, total, max(1, max_group_rows // 2)))


def _row_order(time: str, tie_breakers: Sequence[str]) -> list[Column]:
    return [F.col(quoted(name)).asc_nulls_last() for name in (time, *tie_breakers)]


def _lag(df, keys, time, tie_breakers, values) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*_row_order(time, tie_breakers))
    return df.withColumns({new: F.lag(old).over(window) for new, old in values.items()})


def _lag_over_ranges(rows, keys, time, tie_breakers, values, total: int, range_rows: int) -> DataFrame:
    """Windows over contiguous ranges of one order; the last row of each is carried into the next.

    Tasks sort their share of the order and cut it after every ``range_rows`` rows, so the number of tasks
    follows the rows and not the number of ranges, however short the ranges are.

    Rows that tie in everything are told apart by a number of their own, so no set of equal rows has to
    stay together.  The ranges are written down: their bounds are drawn once, and every later reader sees them.
    """
    names, order = list(values), _row_order(time, tie_breakers)
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(max(2, -(-total // range_rows)), max(shuffled, -(-2 * total // HOT_GROUP_ROWS)))
    place = [*[F.col(quoted(k)) for k in keys], *order, F.col("__row")]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(tasks, *place)
    # The id holds the task above 33 bits, and the place in its order in these; a range is known by the id of its first row.
    placed = dealt.sortWithinPartitions(*place).withColumn("__at", F.monotonically_increasing_id())
    ranged = stored(placed.withColumn("__range", F.expr(f"__at - (__at & {(1 << 33) - 1}) % {range_rows}")).drop("__at"))
    window = Window.partitionBy(*keys, "__range").orderBy(*order, "__row")
    within = ranged.withColumns({
        "__opens": F.lag(F.lit(1)).over(window).isNull(),
        "__closes": F.lead(F.lit(1)).over(window).isNull(),
        **{new: F.lag(old).over(window) for new, old in values.items()},
    })
    # One row per group and range: as many as there are ranges, and one more for each group.
    last = within.where("__closes").select(*keys, "__range", F.struct(*[F.col(values[n]).alias(n) for n in names]).alias("__last"))
    by_range = Window.partitionBy(*keys).orderBy("__range")
    carried = stored(last.select(*keys, "__range", F.lit(True).alias("__opens"), F.lag("__last").over(by_range).alias("__carried")))
    joined = join_on(within, checked_broadcast(carried), [*keys, "__range", "__opens"], "left", null_safe=True)
    resolved = joined.withColumns({n: F.when(F.col("__opens"), F.col(f"__carried.{n}")).otherwise(F.col(n)) for n in names})
    return resolved.drop("__row", "__range", "__opens", "__closes", "__carried")


def _at_rank(low: Column, high: Column, position: Column) -> Column:
    """Between two neighbouring values, in the arithmetic of the built-in exact percentile."""
    below, above = F.floor(position), F.ceil(position)
    mixed = low * (above - position) + high * (position - below)
    return F.when((below == above) | (low == high), low).otherwise(mixed)


def grouped_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    *,
    gathered_rows: int = GATHERED_ROWS,
) -> DataFrame:
    """Exact continuous quantiles (linear interpolation) per group.

    A group of at most ``gathered_rows`` values is left to the built-in exact percentile, which holds a
    group's values in one task.  In larger groups the value at each wanted rank is selected by
    narrowing: a histogram of the bracket that holds the rank proposes a middle value and two
    bounds around it, one pass counts what lies on each side, and the side that holds the rank is
    the next bracket.  All groups and ranks narrow in the same pass; every round leaves out at least the middle value, so none
    can fail, and what remains is gathered once it is small.  Both ways give the same digits.
    """
    keys = list(groups)
    data = df.select(*keys, F.col(quoted(value)).cast("double").alias("__v")).where("__v IS NOT NULL")
    counts = stored(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
                    .where(F.col("__n") > gathered_rows))
    builtin = [F.percentile("__v", q).alias(name) for name, q in quantiles.items()]
    if counts.isEmpty():
        return data.groupBy(*keys).agg(*builtin)
    if not keys:
        return _selected(data, counts, keys, quantiles, gathered_rows)
    large = checked_broadcast(counts.select(*keys))
    usual = join_on(data, large, keys, "left_anti", null_safe=True).groupBy(*keys).agg(*builtin)
    crowded = stored(join_on(data, large, keys, "left_semi", null_safe=True))
    return usual.unionByName(_selected(crowded, counts, keys, quantiles, gathered_rows))


class _Target:
    """One wanted rank of every group: columns of its bracket in the state table."""

    def __init__(self, number: int):
        self.rank, self.low, self.high, self.below, self.inside = (
            f"__{name}{number}" for name in ("rank", "low", "high", "below", "inside"))
        self.number = number

    def columns(self) -> list[str]:
        return [self.rank, self.low, self.high, self.below, self.inside]

    def holds(self) -> Column:
        return (F.col("__v") >= F.col(self.low)) & (F.col("__v") <= F.col(self.high))

    def open(self, limit: int) -> Column:
        return (F.col(self.low) < F.col(self.high)) & (F.col(self.inside) > limit)


def _with_state(data: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return join_on(data, checked_broadcast(state), keys, null_safe=True)
    one = state.select(F.struct("*").alias("s")).scalar()
    return data.withColumn("__s", one).select("__v", "__s.*")


def _selected(data: DataFrame, counts: DataFrame, keys: list[str], quantiles: dict[str, float], limit: int) -> DataFrame:
    targets, positions = [], {}
    for i, (name, q) in enumerate(quantiles.items()):
        positions[name] = (F.col("__n") - 1) * F.lit(float(q))
        targets += [_Target(2 * i), _Target(2 * i + 1)]
    ranks = [f(p).cast("long") for p in positions.values() for f in (F.floor, F.ceil)]
    state = counts.select(*keys, "__n", *[
        column for target, rank in zip(targets, ranks) for column in (
            rank.alias(target.rank), F.col("__min").alias(target.low), F.col("__max").alias(target.high),
            F.lit(0).cast("long").alias(target.below), F.col("__n").alias(target.inside))])
    while True:
        state = stored(state)
        open_ = state.agg(*[F.count_if(t.open(limit)) for t in targets]).first()
        still = [t for t, n in zip(targets, open_) if n]
        if not still:
            break
        state = _narrowed(data, state, keys, still, limit)
    rows = _with_state(data, state, keys)
    held = {f"__held{t.number}": F.sort_array(F.collect_list(F.when(t.holds() & (F.col(t.low) < F.col(t.high)), F.col("__v")))) for t in targets}
    gathered = rows.groupBy(*keys, "__n", *[c for t in targets for c in t.columns()]).agg(*[c.alias(n) for n, c in held.items()])

    def found(t: _Target) -> Column:
        place = (F.col(t.rank) - F.col(t.below) + 1).cast("int")
        return F.when(F.col(t.low) == F.col(t.high), F.col(t.low)).otherwise(F.try_element_at(f"__held{t.number}", place))

    return gathered.select(*keys, *[
        _at_rank(found(targets[2 * i]), found(targets[2 * i + 1]), position).alias(name)
        for i, (name, position) in enumerate(positions.items())])


def _narrowed(data: DataFrame, state: DataFrame, keys: list[str], targets: list[_Target], limit: int) -> DataFrame:
    """One round: the bracket of every open rank shrinks to the part that holds the rank."""
    grid = [i / CELLS for i in range(CELLS + 1)]
    rows = _with_state(data, state, keys)
    inside = {t: F.when(t.holds() & t.open(limit), F.col("__v")) for t in targets}
    sketch = rows.groupBy(*keys).agg(*[
        F.percentile_approx(inside[t], grid, SKETCH_ACCURACY).alias(f"__grid{t.number}") for t in targets])
    cuts = []
    for t in targets:
        cell = F.floor((F.col(t.rank) - F.col(t.below)) * CELLS / F.col(t.inside)).cast("int")
        for name, shift in (("left", -1), ("middle", 0), ("right", 2)):
            place = F.greatest(F.lit(1), F.least(F.lit(CELLS + 1), cell + 1 + shift))
            cuts.append(F.try_element_at(f"__grid{t.number}", place).alias(f"__{name}{t.number}"))
    if keys:
        bounds = stored(join_on(state, sketch, keys, null_safe=True).select(*state.columns, *cuts))
    else:
        one = state.select(F.struct("*").alias("s")).scalar()
        bounds = stored(sketch.withColumn("__s", one).select("__s.*", *sketch.columns).select(*state.columns, *cuts))
    rows, v, counted = _with_state(data, bounds, keys), F.col("__v"), []
    for t in targets:
        left, middle, right = (F.col(f"__{name}{t.number}") for name in ("left", "middle", "right"))
        mine = t.holds() & t.open(limit)
        parts = {"a": v < left, "b": (v >= left) & (v < middle), "c": v == middle, "d": (v > middle) & (v <= right), "e": v > right}
        for name, part in parts.items():
            counted += [F.count_if(mine & part).alias(f"__{name}{t.number}"),
                        F.min(F.when(mine & part, v)).alias(f"__{name}_low{t.number}"),
                        F.max(F.when(mine & part, v)).alias(f"__{name}_high{t.number}")]
    columns = [c for c in bounds.columns if c not in keys]
    sums = rows.groupBy(*keys, *columns).agg(*counted)
    updated = {}
    for t in targets:
        rest, before, options = F.col(t.rank) - F.col(t.below), F.lit(0).cast("long"), []
        for name in "abcde":
            n = F.col(f"__{name}{t.number}")
            bracket = F.struct(F.col(f"__{name}_low{t.number}").alias("low"), F.col(f"__{name}_high{t.number}").alias("high"),
                               (F.col(t.below) + before).alias("below"), n.alias("inside"))
            options.append((rest < before + n, bracket))
            before = before + n
        updated[t] = reduce(lambda chain, option: chain.when(*option), options[1:], F.when(*options[0]))
    chosen = sums.select(*state.columns, *[updated[t].alias(f"__next{t.number}") for t in targets])
    settled = {
        name: F.when(t.open(limit), F.col(f"__next{t.number}.{field}")).otherwise(F.col(name))
        for t in targets for field, name in (("low", t.low), ("high", t.high), ("below", t.below), ("inside", t.inside))}
    return chosen.select(*[settled[c].alias(c) if c in settled else F.col(quoted(c)) for c in state.columns])


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; each map task sends on at most ``k`` of a group."""
    if k <= 0:
        raise ValueError("k must be positive")
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
