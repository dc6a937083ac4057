"""Shared passages, hard negatives and conversation repair against brute force on small, awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import conversations
from assayer.llm.conversations import Repair, damaged, repaired_digests
from assayer.llm.hard_negatives import mine_hard_negatives
from assayer.llm.queries import QUERIES
from assayer.llm.substring_dedup import WINDOW, cut_shared_passages

DOCS = "doc_id long, text string, n_words string, unit long, part long, kept string"


def shared_passages(rows):
    lists = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[j:j + WINDOW]) for _, w in lists for j in range(len(w) - WINDOW + 1))
    for doc_id, w in lists:
        gone = {k for j in range(len(w) - WINDOW + 1) if seen[tuple(w[j:j + WINDOW])] > 1 for k in range(j, j + WINDOW)}
        spans = sum(k - 1 not in gone for k in gone)
        yield doc_id, len(w), len(gone), spans, " ".join(x for k, x in enumerate(w) if k not in gone)


def awkward_texts():
    r = random.Random(7)
    prose = lambda n, kinds=500: [f"w{r.randrange(kinds)}" for _ in range(n)]
    passage, other, long_one = prose(60), prose(WINDOW), prose(3000)
    texts = [None, "", " \n\t", "one two", "word " * 34, "word " * 36, "word " * 36, "a b " * 40]
    texts += [" ".join(prose(r.randrange(40)) + passage + prose(r.randrange(40))) for _ in range(9)]
    # The passage with one word changed: shared windows on both sides only.
    for k in (0, 10, 20, 34, 35, 40, 59):
        texts.append(" ".join(prose(5) + passage[:k] + ["changed"] + passage[k + 1:] + prose(5)))
    texts += [" ".join(prose(3) + other), "\n".join(other + prose(3)), " ".join(other[:-1]), " ".join(passage[10:50] + prose(2) + passage[10:50])]
    texts += [" ".join(long_one), " ".join(long_one[:2000]), "\t".join(prose(2000, 3)), " ".join(prose(2000, 2))]
    texts += ["é" * 300 + " " + " ".join(passage), "x\xa0y " * 50, " ".join(prose(50)), "same text", "same text"]
    return texts


@pytest.mark.parametrize("unit_bytes, part_bytes", [(1 << 21, 1 << 24), (3000, 2000)])
def test_shared_passages(spark, unit_bytes, part_bytes):
    rows = [(i, t, "n", 1, 2, "k") for i, t in enumerate(awkward_texts())]
    rows += [rows[10], rows[10], (None, rows[12][1], None, None, None, None), (50, None, None, None, None, None)]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    got = cut_shared_passages(table, unit_bytes=unit_bytes, part_bytes=part_bytes)
    wanted = list(shared_passages([r[:2] for r in rows]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    assert any(0 < removed < n for _, n, removed, _, _ in wanted)


def test_no_shared_passages(spark):
    empty = spark.createDataFrame([], DOCS)
    assert cut_shared_passages(empty, digests=True).collect() == []
    one = spark.createDataFrame([(1, "one two", "n", 1, 2, "k")], DOCS)
    assert [tuple(r) for r in cut_shared_passages(one).collect()] == [(1, 2, 0, 0, "one two")]


def test_shared_passages_of_documents(spark, sf_dir):
    got = QUERIES["op11_substring_dedup"](spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = {(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, _, t in shared_passages(rows)}
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == wanted and len(got) == len(rows)


def test_anchors_fall_into_even_parts():
    from assayer.llm.substring_dedup import Words

    r = random.Random(1)
    _, _, anchors, _ = Words([" ".join(f"w{r.randrange(10**6)}" for _ in range(50_000))]).anchors()
    shares = Counter(int(a) * 8 >> 40 for a in anchors)
    assert max(shares.values()) < 2 * len(anchors) / 8


VECTORS = "vec_id long, embedding array<float>, label long, rank int, score long, anchor_id long, place string"


def hard_negatives(rows, positives=5, negatives=5, low=80, scale=256):
    rows = {r[0]: r for r in sorted(rows, key=str, reverse=True)
            if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    codes = {i: [math.floor(scale * x) for x in v] for i, v, *_ in rows.values()}
    out = set()
    for a in rows:
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(codes[a], codes[b])), b) for b in rows if b != a)
        same = [(-s, b) for s, b in scored if rows[b][2] == rows[a][2]][:positives]
        for p_score, p in same:
            fits = [(-s, b) for s, b in scored if rows[b][2] != rows[a][2] and low * p_score <= -100 * s <= 100 * p_score]
            out |= {(a, p, k + 1, b, p_score, s) for k, (s, b) in enumerate(fits[:negatives])}
    return out


@pytest.mark.parametrize("stripe_rows", [1 << 16, 50])
def test_hard_negatives(spark, stripe_rows):
    r = random.Random(5)
    rows = []
    for i in range(-20, 400):
        centre = [0.5, -0.25, 0.125, 1.0] if i % 3 else [r.gauss(0, 1) for _ in range(4)]
        # One label has a third of all rows; many vectors are the same, so scores tie.
        rows.append((i, [float(round(x + (i % 5 == 0) * r.gauss(0, 0.05), 3)) for x in centre], 1 if i % 3 == 0 else r.randrange(6), 0, 0, 0, "p"))
    rows += [(None, [1.0] * 4, 1, None, None, None, None), (1000, None, 1, None, None, None, None), (1010, [1.0] * 4, None, 0, 0, 0, ""),
             (1020, [1.0, None, 1.0, 1.0], 1, 0, 0, 0, ""), (1030, [float("nan")] * 4, 1, 0, 0, 0, ""), (1040, [float("-inf")] * 4, 1, 0, 0, 0, ""),
             (1050, [0.0] * 4, 2, 0, 0, 0, ""), (1060, [], 3, 0, 0, 0, ""), (1070, [1.0, 2.0], 3, 0, 0, 0, ""), (1080, [1.0] * 4, 77, 0, 0, 0, "")]
    table = spark.createDataFrame(rows + [rows[30], rows[30], rows[7]], VECTORS).repartition(5)
    table = table.withColumn("embedding", F.expr("transform(embedding, x -> round(x * 64) / 64)"))
    exact = [tuple(x) for x in table.collect()]
    got = mine_hard_negatives(table, F.col("vec_id") % 10 == 0, stripe_rows=stripe_rows).collect()
    assert {tuple(x) for x in got} == hard_negatives(exact) and len(got) == len(hard_negatives(exact)) > 300


def test_hard_negatives_of_nothing_and_of_huge_components(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert mine_hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    rows = [(i, [float(2 ** (i % 17))] * 3, i % 2, 0, 0, 0, "") for i in range(60)]
    table = spark.createDataFrame(rows, VECTORS)
    got = mine_hard_negatives(table, F.col("vec_id") % 10 == 0).collect()
    assert {tuple(x) for x in got} == hard_negatives(rows)
    far = spark.createDataFrame([(i, [3e38] * 3, i % 2, 0, 0, 0, "") for i in range(9)], VECTORS)
    assert mine_hard_negatives(far, F.col("vec_id") % 10 == 0).count() == 16
    assert mine_hard_negatives(far, F.col("vec_id") == 500).count() == 0


TALK = "conv_id long, turn long, role string, text string, span long, open boolean, audit string, digest string, m string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All edits tried: the least (cost, audit) whose roles are legal, and what they leave."""
    best = None
    keys = [["D"] if f in ("blank", "duplicate") else ["K", "U", "A", "D"] for f in found]
    gaps = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*keys):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, left = 0, "", []
            for k in range(len(rows) + 1):
                for letter in between[k]:
                    cost, audit = cost + 2, audit + "I"
                    left.append(("user" if letter == "u" else "assistant", ""))
                if k == len(rows):
                    break
                _, role, text = rows[k]
                edit = choice[k]
                if edit == "D":
                    cost, audit = cost + 3, audit + "D"
                    continue
                cost += {"K": 0}.get(edit, 2) + (found[k] == "truncated")
                audit += "K" if edit == "K" else "R"
                left.append(({"K": role, "U": "user", "A": "assistant"}[edit], text))
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in left)):
                best = cost, audit, "\n".join(f"{role}:{text}" for role, text in left)
    return best


def repaired(rows):
    """conv_id: what the contract asks for, from rows (conv_id, turn, role, text) that stand there."""
    talks = defaultdict(list)
    for conv_id, *row in rows:
        talks[conv_id].append(row)
    for conv_id, talk in talks.items():
        talk = [(t, r, x) for t, r, x in talk if t != "gone"]
        talk.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = faults(talk)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        cost, audit, left = cheapest(talk, found)
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        yield (conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest())


def talks():
    r = random.Random(11)
    rows = []
    for conv_id in [None, *range(1, 90)]:
        turn = r.choice([0, 5, -3])
        for _ in range(r.randrange(4)):
            text = r.choice(["Yes.", "No", "a b.", " \t", "", "Good! ", "why? \n", "Yes."])
            rows.append((conv_id, r.choice([turn, None]) if r.random() < 0.2 else turn, r.choice(["user", "assistant", "system", "user", "tool", ""]), text))
            turn += r.choice([0, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("span_rows", [2048, 1, 2])
def test_repair(spark, monkeypatch, span_rows):
    monkeypatch.setattr(conversations, "SPAN_ROWS", span_rows)
    rows = talks()
    table = spark.createDataFrame([(*row, 1, True, "a", "d", "m") for row in rows], TALK).repartition(4)
    got = {tuple(x) for x in repaired_digests(Repair(table)).collect()}
    assert got == set(repaired(rows))


def test_repair_of_damaged_rows(spark):
    rows = [r for r in talks() if r[0] is None or r[0] < 60] + [(100, 1, None, None), (None, None, None, None)]
    table = spark.createDataFrame([(*row, 1, True, "a", "d", "m") for row in rows], TALK).repartition(4)
    expected = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        expected += [(conv_id, "gone" if code == 0 else turn, role, text)] * (2 if code == 3 else 1)
    assert {tuple(x) for x in repaired_digests(Repair(damaged(table))).collect()} == set(repaired(expected))


def test_repair_of_long_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SPAN_ROWS", 64)
    empty = spark.createDataFrame([], TALK)
    assert repaired_digests(Repair(empty)).collect() == [] and Repair(empty).messages().collect() == []
    r = random.Random(2)
    rows = [(1, i, r.choice(["user", "assistant"]), r.choice(["Yes.", f"Text {i}.", "", f"cut {i}"]), 1, True, "a", "d", "m") for i in range(3000)]
    rows += [(2, 5, "user", "Again.", 1, True, "a", "d", "m")] * 500 + [(3, 1, "user", "x" * 3_000_000 + " " * 100_000, 1, True, "a", "d", "m")]
    repair = Repair(spark.createDataFrame(rows, TALK).repartition(6))
    one, two, three = sorted(repair.summaries().collect())
    assert one.audit.count("K") + one.audit.count("R") + one.audit.count("D") == 3000
    assert (two.audit, two.cost, two.duplicate) == ("K" + "D" * 499 + "I", 2 + 3 * 499, 499)
    assert (three.audit, three.cost, three.truncated) == ("D", 3, 1) or (three.audit, three.cost) == ("KI", 3)
    # Straight through all rows, one after the other, gives the same cost and audit.
    talk = sorted(row[1:4] for row in rows if row[0] == 1)
    best = {0: (0, "")}
    best = {q: (c, a) for (p, q), (c, a) in conversations.NO_ROW.items() if p == 0}
    for (_, role, _), fault in zip(talk, faults(talk)):
        cells = conversations.row_cells(role[0], ["", "blank", "duplicate", "truncated"].index(fault))
        after = {}
        for p, (cost, audit) in best.items():
            for (left, q), (c, a) in cells.items():
                if left == p:
                    after[q] = min(after.get(q, (10**9, "")), (cost + c, audit + a))
        best = after
    assert (one.cost, one.audit) == min(best[q] for q in (0, 3) if q in best)
    messages = repair.messages().where("conv_id = 1").orderBy("place").collect()
    roles = "".join(m.role[0] for m in messages)
    assert re.fullmatch("(s?(ua)+)?", roles) and len(roles) == len(one.audit) - one.audit.count("D")


def test_repair_of_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, sf_dir).collect()
    assert len(got) == table.select("conv_id").distinct().count()
    texts = {(m.conv_id): [] for m in got}
    repair = Repair(damaged(table))
    for m in repair.messages().orderBy("conv_id", "place").collect():
        texts[m.conv_id].append(f"{m.role}:{m.text}")
    for r in got:
        assert r.repaired_sha256 == hashlib.sha256("\n".join(texts[r.conv_id]).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in texts[r.conv_id]))
