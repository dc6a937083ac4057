"""Written tables under change: the vector index, evidence with two writers, documents that can't be read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from assayer.operators.grounding import json_leaves
from assayer.operators.retrieval import HashingEmbedder
from assayer.plans.run import search_documents
from assayer.sources.catalog import ingest_catalog
from assayer.sources.readers import scan_documents
from assayer.sources.sinks import sink_evidence, stored_evidence
from assayer.sources.vectors import ChunkIndex
from assayer.sources.versions import Conflict, Versions
from assayer.specs import SourceSpec


def _rows(index):
    return sorted((r.doc_id, r.chunk_index, r.start_char, r.end_char, r.text, r.chunk_id, tuple(r.embedding)) for r in index.read().collect())


def test_reindex_equals_a_full_build_and_embeds_only_changes(spark, tmp_path):
    text = "words of document {} " * 80
    first = [(i, text.format(*[i] * 80)) for i in range(40)] + [(100, None), (101, "")]
    second = [(i, t if i % 10 else f"changed {t}") for i, t in first if i not in (7, 8)] + [(200, "new document")]
    log = str(tmp_path / "log")

    def embedder():
        class Counting(HashingEmbedder):
            def embed_documents(self, texts):
                with open(log, "a") as file:
                    file.writelines(json.dumps(t) + "\n" for t in texts)
                return super().embed_documents(texts)

        return Counting()

    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=8)
    with pytest.raises(ValueError):
        index.read()
    columns = "doc_id long, text string"
    assert index.reindex(spark.createDataFrame(first, columns), embedder).changed_documents == 42
    before = set(Versions(spark, index.versions.root).current()[1]["folders"].items())
    open(log, "w").close()
    done = ChunkIndex(spark, str(tmp_path / "index"), buckets=3).reindex(spark.createDataFrame(second, columns), embedder, size=1200)
    assert (done.changed_documents, done.removed_documents, done.generation) == (6, 2, 2)
    embedded = [json.loads(line) for line in open(log)]
    assert embedded and all(t.startswith(("changed", "new")) or any(f"document {i} " in t for i in (0, 10, 20, 30)) for t in embedded)
    whole = ChunkIndex(spark, str(tmp_path / "whole"), buckets=8)
    whole.reindex(spark.createDataFrame(second, columns), HashingEmbedder)
    assert _rows(index) == _rows(whole)
    after = set(Versions(spark, index.versions.root).current()[1]["folders"].items())
    assert len(after - before) == done.rewritten_buckets - (len(before) > len(after)) or before & after
    assert index.documents().count() == 41
    again = index.reindex(spark.createDataFrame(second, columns), HashingEmbedder)
    assert (again.changed_documents, again.removed_documents, again.rewritten_buckets) == (0, 0, 0) and _rows(index) == _rows(whole)
    with pytest.raises(ValueError):
        index.reindex(spark.createDataFrame([(1, "a"), (1, "b")], columns), HashingEmbedder)
    with pytest.raises(ValueError):
        index.reindex(spark.createDataFrame([("a", "b")], "doc_id string, text string"), HashingEmbedder)
    gone = index.reindex(spark.createDataFrame([], columns), HashingEmbedder)
    assert gone.removed_documents == 41 and index.read().count() == 0


def test_upsert_by_chunk(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=4)
    index.reindex(spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string"), HashingEmbedder)
    rows = index.read().drop("generation")
    changed = rows.where("doc_id < 3").withColumn("text", F.lit("other"))
    added = rows.where("doc_id = 5").withColumn("chunk_id", F.lit("new"))
    assert index.upsert(changed.unionAll(added).unionAll(added)) == 2
    texts = sorted((r.doc_id, r.text, r.generation) for r in index.read().collect())
    assert texts == sorted([(i, "other" if i < 3 else f"text {i}", 2 if i < 3 else 1) for i in range(10)] + [(5, "text 5", 2)])


def test_an_overtaken_writer_starts_over(spark, tmp_path, monkeypatch):
    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=4)
    columns = "doc_id long, text string"
    index.reindex(spark.createDataFrame([(1, "one"), (2, "two")], columns), HashingEmbedder)
    publish, calls = Versions.publish, []

    def overtaken(self, after, state):
        if not calls:
            calls.append(after)
            ChunkIndex(spark, str(tmp_path / "index")).reindex(spark.createDataFrame([(1, "one"), (3, "three")], columns), HashingEmbedder)
        return publish(self, after, state)

    monkeypatch.setattr(Versions, "publish", overtaken)
    index.reindex(spark.createDataFrame([(1, "one"), (4, "four")], columns), HashingEmbedder)
    assert sorted((r.doc_id, r.text) for r in index.read().collect()) == [(1, "one"), (4, "four")]
    versions = Versions(spark, index.versions.root)
    with pytest.raises(Conflict):
        publish(versions, 1, {})


EVIDENCE = "run_id string, evidence_id string, checksum string"


def test_two_writers_of_evidence(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "evidence")
    mine = spark.createDataFrame([("R1", "EVD-1", "a"), ("R1", "EVD-2", "b"), ("R2", "EVD-1", "c")], EVIDENCE)
    theirs = spark.createDataFrame([("R1", "EVD-2", "b"), ("R1", "EVD-3", "d"), ("R3", "EVD-1", "e")], EVIDENCE)
    publish, calls = Versions.publish, []

    def overtaken(self, after, state):
        if not calls:
            calls.append(after)
            assert sink_evidence(theirs, path) == 3
        return publish(self, after, state)

    monkeypatch.setattr(Versions, "publish", overtaken)
    assert sink_evidence(mine, path) == 2
    monkeypatch.setattr(Versions, "publish", publish)
    stored = sorted((r.run_id, r.evidence_id, r.checksum) for r in stored_evidence(spark, path).collect())
    assert stored == [("R1", "EVD-1", "a"), ("R1", "EVD-2", "b"), ("R1", "EVD-3", "d"), ("R2", "EVD-1", "c"), ("R3", "EVD-1", "e")]
    assert stored_evidence(spark, path, "R2").count() == 1 and stored_evidence(spark, path, "R9").count() == 0
    with pytest.raises(ValueError):
        sink_evidence(spark.createDataFrame([("R1", "EVD-3", "x")], EVIDENCE), path)
    assert sink_evidence(mine.unionAll(theirs), path) == 0


def test_a_failed_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "evidence")
    rows = spark.createDataFrame([("R1", "EVD-1", "a")], EVIDENCE)

    def fails(self, after, state):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Versions, "publish", fails)
        with pytest.raises(OSError):
            sink_evidence(rows, path)
    with pytest.raises(ValueError):
        stored_evidence(spark, path)
    assert sink_evidence(rows, path) == 1 and stored_evidence(spark, path).count() == 1
    with pytest.raises(ValueError):
        sink_evidence(spark.createDataFrame([("a/b", "EVD-1", "a")], EVIDENCE), path)


def test_documents_that_cannot_be_read_are_rows(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "good.txt").write_text("Schöne Wörter", "utf-8")
    (folder / "empty.txt").write_text("")
    (folder / "cut.txt").write_bytes("Schö".encode()[:-1])
    (folder / "latin.txt").write_bytes("Schöne Wörter".encode("latin-1"))
    (folder / "bom.txt").write_bytes("﻿marked".encode())
    rows = {os.path.basename(r.path): r for r in scan_documents(spark, str(folder)).collect()}
    assert {n for n, r in rows.items() if r.error} == {"cut.txt", "latin.txt"}
    assert all(rows[n].text is None and rows[n].error.startswith("UnicodeDecodeError") for n in ("cut.txt", "latin.txt"))
    assert (rows["good.txt"].text, rows["bom.txt"].text) == ("Schöne Wörter", "marked") and "empty.txt" not in rows
    western = {os.path.basename(r.path): r.text for r in scan_documents(spark, str(folder), encoding="cp1252").collect()}
    assert western["latin.txt"] == "Schöne Wörter"
    source = SourceSpec("notes", "document", str(folder), "text", metadata={"kind": "policy"})
    broken = SourceSpec("none", "document", str(tmp_path / "nothing"), "text")
    found = ingest_catalog(spark, [source, broken], make_embedder=HashingEmbedder)
    assert sorted(os.path.basename(r.path) for r in found.document_errors.collect()) == ["cut.txt", "latin.txt"]
    assert set(found.errors) == {"none"}
    chunks = found.chunks.collect()
    assert {c.metadata["kind"] for c in chunks} == {"policy"} and all(c.metadata["location"].endswith(".txt") for c in chunks)
    best = search_documents(found.chunks, "marked", HashingEmbedder, where={"kind": "policy"}).first()
    assert best.text == "marked"
    assert search_documents(found.chunks, "marked", HashingEmbedder, where={"kind": "code"}).count() == 0


@pytest.mark.parametrize("value", [
    {"a": {"b": ["x", {"c": 1.5, "d": [True, None, [["deep"]]]}]}, "e:": "f:"}, ["a", "b"], {}, [], {"q": 'say "hi": \\ {x} [y], z', "u": "é\n\t"}, {"n": -1e-7},
])
def test_json_leaves(spark, value):
    def leaves(x):
        if isinstance(x, dict):
            return [y for v in x.values() for y in leaves(v)]
        if isinstance(x, list):
            return [y for v in x for y in leaves(v)]
        return [] if x is None else [x]

    df = spark.createDataFrame([(json.dumps(value),), ("plain: text",), (None,)], "t string")
    nested, plain, none = [r[0] for r in df.select(json_leaves(F.col("t"))).collect()]
    assert [json.loads(x) if not isinstance(w, str) else x for x, w in zip(nested, leaves(value), strict=True)] == leaves(value)
    assert plain == ["plain: text"] and none is None
