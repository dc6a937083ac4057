"""Chunks, HTML text, search, relevance."""

import hashlib
import re
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer import search_documents
from assayer.operators.documents import (
    PART_ROWS,
    chunk_documents,
    chunk_id,
    chunked,
    corpus_fingerprint,
    detect_changed_documents,
    extract_html_text,
    html_text,
    parse_pages,
    removed_documents,
    usable_documents,
    windows,
)
from assayer.operators import retrieval
from assayer.operators.relevance import keyword_relevance
from assayer.operators.retrieval import HashingEmbedder, cosine, embed, metadata_filter, vector_search, vector_search_batch

ROWS = "doc_id long, text string"


def test_chunks_overlap_and_are_stable(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "   \n "), (4, None), (5, "x" * 50), (6, "слово " * 9)], ROWS)
    chunks = chunk_documents(df, "doc_id", size=20, overlap=5).withColumn("id", chunk_id(F.col("doc_id")))
    rows = chunks.orderBy("doc_id", "chunk_index").collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert len(first) > 1 and first[1]["start_char"] < first[0]["end_char"]
    assert [r["id"] for r in rows] == [r["id"] for r in chunks.orderBy("doc_id", "chunk_index").collect()]
    assert {r["doc_id"] for r in rows} == {1, 2, 5, 6}
    assert [(r["start_char"], r["end_char"]) for r in rows if r["doc_id"] == 5] == [(0, 20), (15, 35), (30, 50)]
    with pytest.raises(ValueError):
        chunk_documents(df, "doc_id", size=5, overlap=5)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(2, 30), st.data())
def test_windows_cover_the_text(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    parts = list(windows(text, size, overlap))
    covered = set()
    for start, end, fragment in parts:
        assert 0 < end - start <= size and fragment == text[start:end].strip() and fragment
        late = [i for i in range(start + size // 2 + 1, start + size) if text[i:i + 1] in ("\n", " ")]
        assert end == (len(text) if start + size >= len(text) else max(late, default=start + size))
        covered |= set(range(start, end))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert [p[0] for p in parts] == sorted({p[0] for p in parts})


def test_html_text():
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><p>a<b>b</b> c</p>\n\n  <!-- no --><pre>  x\n </pre><template><i>hid</i></template><br/>end"
    )
    assert html_text(page) == "T & U\na\nb\n c\n\n\n  x\n \nend"


def test_html_errors_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "<p>a</p><p></p>\n<p>b</p>"), (2, None)], "page_id long, html string")
    out = extract_html_text(df)
    rows = {r["page_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "a\n\nb" and rows[2]["error"].startswith("TypeError")
    assert usable_documents(out).count() == 1
    with pytest.raises(RuntimeError):
        usable_documents(out.where("page_id = 2"))


def test_changes_and_fingerprint(spark):
    state = "path string, length long, modificationTime long"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], state)
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], state)
    assert {r["path"] for r in detect_changed_documents(new, old).collect()} == {"b", "d"}
    assert {r["path"] for r in removed_documents(new, old).collect()} == {"c"}

    def print_of(df, **kwargs):
        return corpus_fingerprint(df, **{"model": "m", "collection": "c", **kwargs}).first()["fingerprint"]

    assert print_of(old) == print_of(old.orderBy(F.desc("path")).repartition(3))
    assert len({print_of(old), print_of(new), print_of(old, model="n"), print_of(old.where("false"))}) == 4


def _toy_embedder():
    class Toy:
        dimension = 3

        def embed_documents(self, texts):
            return [[float(word in text.lower()) for word in ("audit", "policy", "risk")] for text in texts]

    return Toy


def test_search_with_a_metadata_filter(spark):
    Toy = _toy_embedder()
    df = spark.createDataFrame(
        [("c1", "Audit policy and controls", {"kind": "policy"}), ("c2", "audit policy", {"kind": "note"}), ("c3", "nothing", {"kind": "policy"})],
        "chunk_id string, text string, metadata map<string,string>",
    )
    chunks = embed(df, "text", Toy)
    best = search_documents(metadata_filter(chunks, {"kind": "policy"}), "audit policy", Toy, limit=1).collect()
    assert [r["chunk_id"] for r in best] == ["c1"] and best[0]["score"] == pytest.approx(1.0)
    assert chunks.select(cosine(F.col("embedding"), F.col("embedding"))).collect()[2][0] == 0.0
    long = search_documents(chunks, "audit policy " + "and more " * 1000, Toy, limit=3)
    assert long.count() == 3
    for bad in ("", " \n"):
        with pytest.raises(ValueError):
            search_documents(chunks, bad, Toy)
    with pytest.raises(ValueError):
        vector_search(chunks, [1.0, 0.0, 0.0], 0)


@pytest.mark.parametrize("blocked", [False, True])
def test_batch_search_equals_brute_force(spark, blocked, monkeypatch):
    import assayer.operators.retrieval as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    index = rng.normal(size=(500, 8)).astype(np.float32)
    index[7] = 0
    queries = rng.normal(size=(130, 8)).astype(np.float32)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], "id long, embedding array<float>").repartition(6)
    right = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "q string, embedding array<float>")
    found = vector_search_batch(left, right, 4, index_key="id", query_key="q", blocked=blocked).collect()

    def unit(m):
        n = np.linalg.norm(m.astype(float), axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros(m.shape), where=n > 0)

    expected = np.argsort(-(unit(queries) @ unit(index).T), axis=1)[:, :4]
    assert len(found) == 520
    for row in found:
        assert expected[int(row["q"][1:])][row["rank"] - 1] == row["id"]


def test_hashing_embedder_is_deterministic():
    a, b = (HashingEmbedder(16).embed_documents(["one two", ""]) for _ in range(2))
    assert a == b and np.linalg.norm(a[0]) == pytest.approx(1.0) and not any(a[1])


def test_relevance(spark):
    df = spark.createDataFrame(
        [(1, "Cash limits and hedging"), (2, "the limit"), (3, "nothing here"), (4, None), (5, "наличная валюта")], "id long, text string"
    )

    def scores(request):
        return {r["id"]: r["score"] for r in keyword_relevance(df, request).collect()}

    assert scores("check limit hedging") == {1: 2, 2: 1}
    assert scores("only limit hedging") == {1: 2}
    assert scores("валюты") == {5: 1}
    assert set(scores("zzzzz")) == {1, 2, 3, 4, 5} and set(scores("check")) == {1, 2, 3, 4, 5}


def test_vector_keys_of_other_types(spark):
    rows = spark.sql("SELECT date'2024-01-01' AS day, array(1f, 0f) AS embedding UNION ALL SELECT date'2024-01-02', array(0f, 1f)")
    wanted = spark.sql("SELECT 1.50BD AS price, array(0f, 2f) AS embedding")
    found = vector_search_batch(rows, wanted, 1, index_key="day", query_key="price").collect()
    assert [(str(r["price"]), str(r["day"]), r["rank"]) for r in found] == [("1.50", "2024-01-02", 1)]


def _wide_embedder():
    class Wide:
        """Wide vectors that hold the most MB of Python objects so far, from the embedder's making on."""

        dimension = 4000

        def __init__(self):
            import tracemalloc

            tracemalloc.start()

        def embed_documents(self, texts):
            import tracemalloc

            peak = tracemalloc.get_traced_memory()[1] / 1e6
            return [[peak] * self.dimension for _ in texts]

    return Wide


def test_embed_holds_few_vectors_of_a_batch(spark):
    rows = embed(spark.range(0, 3000, 1, 1).selectExpr("string(id) AS text"), "text", _wide_embedder())
    found = rows.selectExpr("max(embedding[0]) AS mb", "count_if(size(embedding) = 4000) AS n").first()
    assert found["n"] == 3000 and found["mb"] < 60  # 3000 lists of 4000 take 96 MB


def _pages(n):
    return pa.array([f"<p>{i} &amp; {'x' * 100}</p>" if i % 5 else None for i in range(n)])


def test_pages_are_parsed_in_short_batches():
    out = list(parse_pages([_pages(1000), _pages(0), _pages(3)]))
    assert max(map(len, out)) <= PART_ROWS
    assert [r["text"] for part in out for r in part.to_pylist()] == [
        html_text(page) if page else None for n in (1000, 3) for page in _pages(n).to_pylist()]


def test_documents_are_cut_in_short_batches():
    texts = [None if i % 7 == 0 else "some words " * i for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(300)), "text": texts})
    out = list(chunked(50, 10)([batch]))
    assert len(out) >= 300 // PART_ROWS
    found = [(r["key"], r["start_char"], r["end_char"], r["text"]) for part in out for r in part.to_pylist()]
    assert found == [(i, *w) for i, text in enumerate(texts) if text for w in windows(text, 50, 10)]


def _counted_one_by_one(text, dimension):
    row = np.zeros(dimension)
    for word in re.findall(r"\w+", text.lower()):
        code = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        row[code % dimension] += 1 if code >> 31 else -1
    return (row / (np.linalg.norm(row) or 1)).tolist()


@pytest.mark.parametrize("known", [3, 1 << 18])
def test_vectors_count_every_word(monkeypatch, known):
    monkeypatch.setattr(retrieval, "KNOWN_WORDS", known)
    texts = ["", "a b a", "Été, ΑΣ ſ İx K² ½ x_y-z 一二", "x\x1cy\x85z\u00a0w", "a b c d e f g A B", " . ", "the THE the"]
    embedder = HashingEmbedder(5)
    assert [embedder.embed_documents([t])[0] for t in texts] == embedder.embed_documents(texts) == [_counted_one_by_one(t, 5) for t in texts]
    assert embedder.embed_documents([]) == []


def test_a_word_is_hashed_once_for_a_batch(monkeypatch):
    hashed = []
    monkeypatch.setattr(retrieval, "KNOWN_WORDS", 8)
    monkeypatch.setattr(retrieval.hashlib, "md5", lambda word, **kwargs: hashed.append(word) or md5(word))
    HashingEmbedder().embed_documents(["a b c d e f g h i j", "j i h g f e d c b a"] * 3)
    assert sorted(hashed) == sorted({w.encode() for w in "abcdefghij"})


@given(st.text(alphabet="ab \n\t\u00a0", max_size=60), st.integers(1, 12), st.data())
@settings(max_examples=300, deadline=None)
def test_windows_end_at_the_last_blank_of_their_second_half(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    expected, start, end = [], 0, 0
    while end < len(text):
        blanks = [i for i in range(start + size // 2 + 1, start + size) if text[i:i + 1] in (" ", "\n")]
        end = len(text) if start + size >= len(text) else max(blanks, default=start + size)
        if text[start:end].strip():
            expected.append((start, end, text[start:end].strip()))
        start = max(start + 1, end - overlap)
    assert list(windows(text, size, overlap)) == expected
