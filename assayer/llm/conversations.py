"""Repair of conversations: the cheapest edits after which roles read (s?(ua)+)?, by weighted interval parsing.

The repair grammar is in Chomsky normal form.  Its symbols say how far a legal conversation has
come: nothing yet, after the system turn, after a user turn, after an assistant turn.  A nonterminal
(p, q) stands for rows that lead from p to q; its rules are (p, q) -> (p, r) (r, q) for
every r, and (p, q) -> one edited row.  A cell holds the least (cost, audit) of a nonterminal over
a span of rows.  Edits that need no row, insertions, are closed over in the cell of every
single row, so that they may stand before and after it.

Spans are combined bottom-up by length: 1, 2, 4, ... rows.  Every rule splits at any r, so the
cell of a span is the same for every place where the span is cut, and one cut is enough.
Least audits may be concatenated: equal costs and different letters can't be each other's
prefix, as what follows would be insertions that cost something.

Rows are cut into spans in their order, dealt by ranges of (conversation, turn, role, text), so a
conversation that holds a third of all rows lies in many tasks.  Only the cells of spans, which are
narrow, are brought together for the conversations that have several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import stored

SPAN_ROWS = 2048
NONE, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (NONE, ASSISTANT)
KEEP, INSERT, REROLE, DELETE = 0, 2, 2, 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
BLANKS = " \t\n\x0b\f\r"

Cells = dict[tuple[int, int], tuple[int, str]]


def _add(cells: Cells, key: tuple[int, int], cost: int, audit: str) -> None:
    old = cells.get(key)
    if old is None or (cost, audit) < old:
        cells[key] = (cost, audit)


def combined(left: Cells, right: Cells) -> Cells:
    """The binary rules: the cells of two neighbouring spans taken as one."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None and ((p, q) not in out or cost + other[0] <= out[p, q][0]):
                _add(out, (p, q), cost + other[0], audit + other[1])
    return out


def _closure() -> Cells:
    """What insertions alone lead to: the cells of no row at all."""
    one: Cells = {(p, p): (0, "") for p in range(4)}
    for letter in "ua":
        for p, q in STEPS[letter].items():
            _add(one, (p, q), INSERT, "I")
    return combined(one, one)


NO_ROW = _closure()


def row_cells(initial: str, fault: int, copies: int = 1) -> Cells:
    """The cells of one row, of which ``copies - 1`` duplicates follow."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in (BLANK, DUPLICATE):
        rest = int(fault == TRUNCATED)
        for p, q in STEPS.get(initial, {}).items():
            _add(cells, (p, q), KEEP + rest, "K")
        for letter in "ua":
            for p, q in STEPS[letter].items():
                _add(cells, (p, q), REROLE + rest, "R")
    more = copies - 1
    cells = {key: (cost + DELETE * more, audit + "D" * more) for key, (cost, audit) in cells.items()}
    return combined(combined(NO_ROW, cells), NO_ROW)


def levels(leaves: Sequence[Cells]) -> list[list[Cells]]:
    """Cells of spans of 1, 2, 4, ... leaves, up to the one of all."""
    out = [list(leaves)]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([combined(*below[i:i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    return out


def best_end(cells: Cells) -> int:
    """Where the cheapest legal conversation over all rows ends."""
    return min((cells[NONE, q], q) for q in FINAL if (NONE, q) in cells)[1]


def paths(tree: list[list[Cells]]) -> list[tuple[int, int]]:
    """Top-down: the nonterminal that the best parse gives each leaf."""
    chosen = [(NONE, best_end(tree[-1][0]))]
    for below in tree[-2::-1]:
        lower: list[tuple[int, int]] = []
        for i, (p, q) in enumerate(chosen):
            if 2 * i + 1 == len(below):
                lower.append((p, q))
                continue
            left, right = below[2 * i:2 * i + 2]
            _, r = min(((left[p, r][0] + right[r, q][0], left[p, r][1] + right[r, q][1]), r)
                       for r in range(4) if (p, r) in left and (r, q) in right)
            lower += [(p, r), (r, q)]
        chosen = lower
    return chosen


def edited(start: int, audit: str, rows: Sequence[tuple[str, int]]) -> Iterator[tuple[int | None, str]]:
    """What stays: (number of the row, None for an inserted one; its new role, empty where it keeps its own)."""
    state, owners = start, [i for i, (_, copies) in enumerate(rows) for _ in range(copies)]
    at = 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        row = None if letter == "I" else owners[at]
        initial = rows[row][0] if letter == "K" else "a" if state == USER else "u"
        yield row, "" if letter == "K" else "assistant" if initial == "a" else "user"
        state, at = STEPS[initial][state], at + (letter != "I")


_MESSAGE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("new_role", pa.string())])
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("copies", pa.int64())])
_CELL = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
# Counts of a span, and what its neighbours need of its first and last rows.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
EDGES = (("least_turn", "long"), ("most_turn", "long"), ("first_turn", "long"), ("last_turn", "long"), ("first_initial", "string"), ("last_initial", "string"))


def _stats(rows: Sequence[tuple]) -> dict:
    """Of one span's rows (turn, role, digest, copies, fault)."""
    out = dict.fromkeys(COUNTS, 0) | {name: None for name, _ in EDGES}
    names = {BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated"}
    for turn, role, _, copies, fault in rows:
        initial = role[:1]
        if fault != SOUND:
            out[names[fault]] += 1
        out["blank" if fault == BLANK else "duplicate"] += copies - 1
        if out["last_initial"] is not None:
            out["illegal"] += out["last_initial"] + initial not in ("su", "ua", "au")
        out["illegal"] += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        out["last_initial"] = initial
        if out["first_initial"] is None:
            out["first_initial"] = initial
        if turn is not None:
            if turn != out["last_turn"]:
                out["turns"] += 1
            if out["first_turn"] is None:
                out["first_turn"] = turn
            out["last_turn"] = turn
    out["least_turn"], out["most_turn"] = out["first_turn"], out["last_turn"]
    return out


def _followed(a: dict, b: dict) -> dict:
    """The counts of two neighbouring spans taken as one."""
    if a["last_initial"] is None or b["last_initial"] is None:
        return b if a["last_initial"] is None else a
    out = {name: a[name] + b[name] for name in COUNTS}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    first = a if a["first_turn"] is not None else b
    last = b if b["last_turn"] is not None else a
    return out | {"first_initial": a["first_initial"], "last_initial": b["last_initial"],
                  "first_turn": first["first_turn"], "least_turn": first["first_turn"],
                  "last_turn": last["last_turn"], "most_turn": last["last_turn"]}


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _summary(stats: dict, cost: int, audit: str) -> tuple:
    gaps = 0 if stats["least_turn"] is None else stats["most_turn"] - stats["least_turn"] + 1 - stats["turns"]
    return gaps, stats["blank"], stats["duplicate"], stats["truncated"], stats["illegal"], cost, audit


def _messages(start: int, audit: str, rows: Sequence[tuple]) -> list[dict]:
    out = []
    for row, new_role in edited(start, audit, [(r[1][:1], r[3]) for r in rows]):
        turn, role, digest = (None, None, None) if row is None else rows[row][:3]
        out.append({"turn": turn, "role": role, "digest": digest, "new_role": new_role})
    return out


def _spans(key: pa.DataType):
    """Cut a task's sorted rows into spans; what lies whole inside the task is parsed at once."""
    schema = pa.schema([
        ("conv_id", key), ("span", pa.int64()), ("open", pa.bool_()), *((name, pa.int64()) for name in SUMMARY), ("audit", pa.string()),
        ("messages", pa.list_(_MESSAGE)), ("rows", pa.list_(_ROW)), ("cells", pa.list_(_CELL)),
        *((name, pa.int64()) for name in COUNTS if name not in SUMMARY), *((name, pa.string() if kind == "string" else pa.int64()) for name, kind in EDGES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = TaskContext.get().partitionId() << 33
        out: list[dict] = []
        known: dict[tuple, Cells] = {}

        def cells(row: tuple) -> Cells:
            initial, copies, fault = row[1][:1], row[3], row[4]
            if copies > 1 or initial not in STEPS:
                return row_cells(initial, fault, copies)
            if (initial, fault) not in known:
                known[initial, fault] = row_cells(initial, fault)
            return known[initial, fault]

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def finish(conv_id, held: list[tuple], whole: bool) -> None:
            nonlocal span
            held = [r for r in held if r[3]]
            stats, tree = _stats(held), levels([cells(r) for r in held] or [NO_ROW])
            line = {"conv_id": conv_id, "span": span, "open": not whole}
            if whole:
                cost, audit = tree[-1][0][NONE, best_end(tree[-1][0])]
                line |= dict(zip((*SUMMARY, "audit"), _summary(stats, cost, audit))) | {"messages": _messages(NONE, audit, held)}
            else:
                line |= stats | {"rows": [dict(zip(("turn", "role", "digest", "copies"), r)) for r in held]}
                line["cells"] = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in tree[-1][0].items()]
            out.append(line)
            span += 1

        # The first and the last conversation of a task may go on in another one.
        conversations = groupby(rows(), key=lambda r: r[0])
        first, waiting = True, None
        for conv_id, group in conversations:
            if waiting is not None:
                finish(*waiting)
                waiting = None
            held, whole = [], not first
            for r in group:
                held.append(r[1:])
                if len(held) == SPAN_ROWS:
                    finish(conv_id, held, False)
                    held, whole = [], False
            if held:
                waiting = (conv_id, held, whole)
            first = False
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if waiting is not None:
            finish(waiting[0], waiting[1], False)
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run, schema


def _parse_open(key: pa.DataType):
    """One conversation's spans: combine their cells, and give each span its part of the best parse."""
    schema = pa.schema([("conv_id", key), ("span", pa.int64()), ("leading", pa.bool_()), *((name, pa.int64()) for name in SUMMARY),
                        ("audit", pa.string()), ("messages", pa.list_(_MESSAGE))])

    def run(table: pa.Table) -> pa.Table:
        spans = sorted(table.to_pylist(), key=lambda s: s["span"])
        leaves = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cells"]} for s in spans]
        tree = levels(leaves)
        cost, audit = tree[-1][0][NONE, best_end(tree[-1][0])]
        stats = spans[0]
        for span in spans[1:]:
            stats = _followed(stats, span)
        out = []
        for i, (span, leaf, (p, q)) in enumerate(zip(spans, leaves, paths(tree))):
            line = {"conv_id": span["conv_id"], "span": span["span"], "leading": i == 0}
            line["messages"] = _messages(p, leaf[p, q][1], [tuple(r.values()) for r in span["rows"]])
            out.append(line | dict(zip((*SUMMARY, "audit"), _summary(stats, cost, audit))) if i == 0 else line)
        return pa.Table.from_pylist(out, schema=schema)

    return run, schema


def _spark_schema(spark, schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _last_letter(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def _faulted(rows: DataFrame) -> DataFrame:
    """One row per different (conv_id, turn, role, text) with its number of copies and its first fault."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    last = _last_letter(text)
    narrow = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.col("copies").cast("long").alias("copies"),
        F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND).alias("fault"))
    each = stored(narrow.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies")))
    said = each.where("copies > 0").groupBy("conv_id", "role", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.count("turn").alias("with_turn"), F.min("turn").alias("first_turn"))
    often = said.where("n > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
        (F.col("with_turn") < F.col("n")).alias("untimed"), "first_turn")
    first = F.col("untimed").isNull() | F.when(F.col("untimed"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    joined = each.join(often, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when((F.col("fault") != BLANK) & ~first, DUPLICATE).otherwise(F.col("fault"))
    return joined.select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32('conv_id:turn') % 20; ``copies`` is 0 for a dropped row and 2 for a repeated one."""
    one_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))) % 20
    text = one_space("text")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(one_space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


class Repair:
    """The cheapest repair of every conversation.

    ``rows`` has conv_id (any type that can be ordered), an integer turn, role and text; ``copies``, where
    present, says how often a row stands there (0: not at all, but its conversation counts).  A conversation's rows
    are taken by turn (NULL first), then role, then SHA-256 of the text.  A NULL role or text is one
    space; a NULL conv_id is a conversation of its own.  A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (last letter not one of .!?).

    Keep costs 0, Rerole to user or assistant 2, Delete 3 (required for blank and duplicate rows), Insert of an
    empty user or assistant row 2, and a truncated row that stays 1.  ``summaries`` has one row per
    conversation, ``messages`` the repaired rows in order.  Roles are told by their first letter;
    a role that starts with none of s, u, a, or is empty, can't be kept.  Repeated rows are duplicates.
    Empty tables give empty tables; texts may be of any length, as only their digests are moved until the
    end.  Other columns are ignored.

    The spans of one conversation are combined in one task, some 50 bytes for each of its rows; its texts never
    meet there.
    """

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.rows = rows if "copies" in rows.columns else rows.select("conv_id", "turn", "role", "text", F.lit(1).alias("copies"))
        faulted = stored(_faulted(self.rows))
        order = ["conv_id", "turn", "role", "digest"]
        key = _arrow_type(faulted, "conv_id")
        run, schema = _spans(key)
        dealt = faulted.select(*order, "copies", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
        self.spans = stored(dealt.mapInArrow(run, _spark_schema(spark, schema)))
        run, schema = _parse_open(key)
        opened = self.spans.where("open").select(
            "conv_id", "span", "rows", "cells", *COUNTS, *[name for name, _ in EDGES])
        self.parsed = stored(opened.groupBy("conv_id").applyInArrow(run, _spark_schema(spark, schema)))

    def summaries(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        columns = ["conv_id", *SUMMARY, "audit"]
        return self.spans.where("not open").select(*columns).unionAll(self.parsed.where("leading").select(*columns))

    def messages(self) -> DataFrame:
        """conv_id, place (orders a conversation's rows), turn (NULL: inserted), role, text, edit (keep, rerole, insert)."""
        columns = ["conv_id", "span", F.posexplode("messages").alias("at", "m")]
        kept = self.spans.where("not open").select(*columns).unionAll(self.parsed.select(*columns))
        place = F.struct("span", "at").alias("place")
        inserted = kept.where("m.digest is null").select(
            "conv_id", place, F.lit(None).cast("long").alias("turn"), F.col("m.new_role").alias("role"), F.lit("").alias("text"), F.lit("insert").alias("edit"))
        text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
        texts = self.rows.where("copies > 0").select(
            F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"),
            F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("r"), F.unhex(F.sha2(text, 256)).alias("d"), text.alias("text"),
        ).dropDuplicates(["c", "t", "r", "d"])
        stays = kept.where("m.digest is not null").join(
            texts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("m.turn").eqNullSafe(F.col("t"))
            & (F.col("m.role") == F.col("r")) & (F.col("m.digest") == F.col("d")))
        role = F.when(F.col("m.new_role") == "", F.col("r")).otherwise(F.col("m.new_role"))
        edit = F.when(F.col("m.new_role") == "", "keep").otherwise("rerole")
        return inserted.unionAll(stays.select("conv_id", place, F.col("t").alias("turn"), role.alias("role"), "text", edit.alias("edit")))


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _digests(key: pa.DataType):
    """One SHA-256 per run of rows; a hash is chained, so a conversation's texts pass through one task, as a stream."""
    schema = pa.schema([("c", key), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        ids, hashes = [], []
        for conv_id, group in groupby(rows(), key=lambda r: r[0]):
            digest, between = hashlib.sha256(), b""
            for _, role, text in group:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            ids.append(conv_id)
            hashes.append(digest.hexdigest())
            if len(ids) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(hashes)], schema=schema)
                ids, hashes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(hashes, pa.string())], schema=schema)

    return run, schema


def repaired_digests(repair: Repair) -> DataFrame:
    """The summaries with ``repaired_sha256``: of all repaired ``role:text``, joined by newlines."""
    messages = repair.messages()
    run, schema = _digests(_arrow_type(messages, "conv_id"))
    sorted_ = messages.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    hashed = sorted_.mapInArrow(run, _spark_schema(messages.sparkSession, schema))
    nothing = hashlib.sha256(b"").hexdigest()
    summaries = repair.summaries()
    return summaries.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        *summaries.columns, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
