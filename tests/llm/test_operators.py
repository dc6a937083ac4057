"""The training-data operators against brute force on small, awkward tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import html_extraction, licenses, mixing, packing, quality, sharding, simhash, suffix_dedup, url_filter
from assayer.llm.exact_dedup import DigestIndex, keep_first_copies
from assayer.llm.queries import ORACLES, QUERIES
from assayer.scale import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, row string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near an old stone bridge and sing "
TEXTS = [
    None, "", " \n\t ", "one two", "A b c d", "a  b c\nd", PROSE * 3, "x" + PROSE * 3, (PROSE * 3).upper(), PROSE + "unlike end",
    "line a\nline a\n\nline b " + PROSE, "é" * 80, "z" * 200, "word " * 3000, "short", "short", "sh ort",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, [None, "b", "a", "a"][i % 4], None, True, "q", "r") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[15], (None, PROSE * 3, None, "a", None, None, None, None), (40, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_sends_passages_on_in_small_batches():
    text = "".join(f"w{i} " for i in range(20_000))
    takes = [{"shard": 0, "slot": s, "low": 500 * (s % 40), "high": 500 * (s % 40) + 500} for s in range(2000)]
    kind = pa.list_(pa.struct([("shard", pa.int64()), ("slot", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 8]), pa.array([text, "a b"]), pa.array([takes, [dict(takes[0], high=2)]], kind)], names=["doc_id", "text", "takes"])
    out = list(mixing._cut([batch], 1, -1))
    assert max(part.nbytes for part in out) < 2 * mixing.CUT_CHARS
    rows = [tuple(r.values()) for part in out for r in part.to_pylist()]
    split = text.split()
    assert rows == [(7, " ".join(split[t["low"]:t["high"]])) for t in takes] + [(8, "a b")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    with oracle.connect(sf_dir) as db:
        assert oracle.differences(QUERIES[name](spark, sf_dir), db, ORACLES[name]) == []


def test_exact_dedup(spark, docs, empty):
    index = DigestIndex(spark, scratch_path(spark), buckets=4)
    got = index.add(docs, "first").collect()
    groups = defaultdict(list)
    for doc_id, text in rows_of(docs):
        groups[hashlib.sha256("".join(words(text)).encode()).hexdigest()].append((-len(text), doc_id is not None, doc_id))
    assert len(got) == docs.count()
    for r in got:
        group = groups[r.text_sha256]
        assert r.group_size == len(group)
        assert r.keep_id == min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
    assert sum(r.kept for r in got) == len(groups)
    assert sorted(map(str, index.add(docs, "first").collect())) == sorted(map(str, got))
    later = index.add(docs, "second").collect()
    assert not any(r.kept for r in later) and index.rows().count() == len(groups)
    assert index.add(empty, "none").count() == 0
    assert keep_first_copies(docs, DigestIndex(spark, scratch_path(spark)), "x").count() == len(groups)
    for buckets in (4, 16, 1):
        reopened = DigestIndex(spark, index.path, buckets=buckets)
        assert reopened.buckets == 4 and reopened.rows().count() == len(groups)
        assert not any(r.kept for r in reopened.add(docs, f"with {buckets}").collect())
    with pytest.raises(ValueError):
        DigestIndex(spark, index.path, id_type="string")


def test_a_reopened_index_knows_all_texts(spark):
    texts = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    path = scratch_path(spark)
    assert DigestIndex(spark, path, buckets=4).add(texts, "one").where("kept").count() == 200
    more = texts.unionAll(texts.selectExpr("doc_id + 1000", "concat('new ', text)"))
    again = DigestIndex(spark, path, buckets=16).add(more, "two").collect()
    assert {r.doc_id for r in again if r.kept} == set(range(1000, 1200))
    assert all(r.keep_id == r.doc_id and r.group_size == (2 if r.doc_id < 1000 else 1) for r in again)


def test_quality(docs, empty):
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed) for r in quality.judge_quality(docs).collect()}
    for doc_id, text in rows_of(docs):
        w = words(text)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (doc_id, len(w), len(covered), len(lines) - len(set(lines)), failed) in got
    assert quality.judge_quality(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_bad_hosts_lose_their_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "junk") for i in range(95)] + [(i, good, "junk") for i in range(95, 100)] + [(i, good, "fine") for i in range(100, 200)]
    table = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    assert {r.doc_id for r in quality.keep_good(table).collect()} == set(range(100, 200))


def test_simhash(spark, docs, empty):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([fps, fps[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)),
                           fps[:80] ^ np.uint64(0b1011), fps[:80] ^ np.uint64(0b1011 | 0b111 << 40)])
    table = spark.createDataFrame([(int(x),) for x in np.unique(near).view(np.int64)], "fp long")
    simhash_links = {(r.u, r.v) for r in simhash.near_links(table).collect()}
    parent = {int(x): int(x) for x in np.unique(near).view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def components(links):
        for k in parent:
            parent[k] = k
        for u, v in links:
            parent[find(u)] = find(v)
        groups = defaultdict(set)
        for k in parent:
            groups[find(k)].add(k)
        return {frozenset(g) for g in groups.values()}

    values = np.unique(near)
    true = [(int(a.view(np.int64)), int(b.view(np.int64))) for a in values for b in values[np.bitwise_count(values ^ a) <= 4]]
    assert components(simhash_links) == components(true)

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and simhash.near_duplicates(empty).count() == 0
    for doc_id, text in rows_of(docs):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert any(r.doc_id == doc_id and r.fingerprint == f"{value:016x}" for r in got)
    assert simhash.keep_one_of_each(docs).count() == len({r.component_id for r in got})


def test_chunks_of_hot_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 5)
    values = [1 << i for i in range(20)] + [0]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert {x for link in links for x in link} == set(values)


def test_mixing(docs, empty, sf_dir, spark):
    targets = mixing.targets({"a": 100, "b": 1000, None: 10})
    assert targets == {"a": 300.0, "b": pytest.approx(780), None: 30.0}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, again = (mixing.Mix(t).taken().collect() for t in (table, table.repartition(5)))
    assert sorted(first) == sorted(again)
    assert all(r.taken <= 3 * r["size"] for r in first)
    taken, target = defaultdict(int), {}
    for r in first:
        taken[r.target] += r.taken
    assert sum(taken.values()) == pytest.approx(sum(r["size"] for r in first), rel=0.03)
    assert mixing.Mix(docs).taken().count() == docs.count()
    assert mixing.Mix(empty).taken().count() == 0
    mixed = mixing.mixed_documents(table, block_words=64)
    assert mixed.columns == table.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORDS)))).first()[0] == sum(r.taken for r in first)
    assert mixing.mixed_documents(empty).count() == 0


def test_permutations():
    for size in (1, 2, 3, 64, 1000):
        out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 7, np.uint64))
        assert sorted(out.tolist()) == list(range(size))


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ["a  b", "a \n b", "  x", " \n", " ", "a ", "a  ", "x\n y\n\n  z ", "it's  we'll 12 34\t\t5", "é\xa0 b\x85 c", *filter(None, TEXTS)]:
        assert list(encoder(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    crcs = {(p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces}
    total = 0
    for doc_id, text in rows_of(docs):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        for start in range(0, len(ids), 1024):
            part = ids[start:start + 1024]
            assert (doc_id, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)) in crcs
    assert sum(p.length for p in pieces) == total
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_packing_plan_covers_and_fills():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.gamma(1.5, 80, 20000).astype(int), 1, 256)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.packing_plan(histogram, 256)
    for length, n in histogram.items():
        ranks = sorted((p[1], p[2]) for p in plan if p[0] == length)
        assert sum(c for _, c in ranks) == n and all(a + c == b for (a, c), (b, _) in zip(ranks, ranks[1:]))
    assert lengths.sum() / 256 / max(p[4] + p[2] // p[3] for p in plan) > 0.98


@pytest.mark.parametrize("sizes", [{}, {"unit_bytes": 300, "part_bytes": 100}])
def test_suffix_dedup(docs, empty, sizes):
    first = {}
    big = 1 << 62
    rows = [(big if d is None else d, t.encode()) for d, t in rows_of(docs)]
    for doc_id, raw in rows:
        for p in range(len(raw) - 49):
            w = raw[p:p + 50]
            first[w] = min(first.get(w, doc_id), doc_id)
    want = []
    for doc_id, raw in rows:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p:p + 50]] < doc_id:
                gone[p:p + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.cut_repeats(docs, digests=True, **sizes).collect()
    assert sorted(want) == sorted((big if r[0] is None else r[0], *r[1:]) for r in got)
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_suffix_digits_are_dealt_evenly():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 1 << 20, dtype=np.uint8).tobytes()
    unit = suffix_dedup.Unit(np.array([1]).tobytes(), b"\0", np.array([len(data)]).tobytes(), data)
    _, _, _, anchor, *_ = unit.anchors()
    sizes = np.bincount(suffix_dedup._anchor_part(np.unique(anchor), 100), minlength=100)
    assert sizes.max() < 1.3 * sizes.mean() and sizes.min() > 0.7 * sizes.mean()
    digits = np.sort(rng.integers(0, 1 << 40, 1 << 20, dtype=np.uint64))
    for parts in (1, 7, 1000, 1 << 20):
        dealt = suffix_dedup._anchor_part(digits, parts)
        assert (np.diff(dealt) >= 0).all() and dealt.min() >= 0 and dealt.max() < parts


def test_long_texts_in_slices(spark, monkeypatch):
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(4000))
    table = spark.createDataFrame([(1, text), (2, "new " + text[100:9000] + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(table, unit_bytes=1000).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 8900 and bytes(got[2].kept).startswith(b"new") and got[2].n_spans == 1


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"),
                                   ("a.example.net", "/", "allow")], url_filter.RULE_SCHEMA)
    urls = [None, "", "example.net/en/", "http://Example.NET/en/1", "http://a.example.net/en/", "http://a.example.net/en/x?y", "https://myexample.net/en/",
            "x://net", "http://net/", "http://net?x", "http://example.org/a#b", "http://é.net/ü", "http://a..net/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    want = [None, None, None, "example.net/en/", "example.net/en/", "example.net/en/x", "net/", None, "net/", None, None, "net/", "net/"]
    assert [got[i].rule for i in range(len(urls))] == want
    assert got[3].host == "example.net" and got[3].path == "/en/1" and got[0].host == "" and got[7].path == ""
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0


def test_sharding(docs, empty):
    for limit in (1, 700, 1 << 30):
        got = sharding.assign_shards(docs, limit).collect()
        assert len(got) == docs.count()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        for shard, rows in by.items():
            assert sum(r.n_bytes for r in rows) == rows[0].shard_bytes and len(rows) == rows[0].shard_docs
            assert rows[0].shard_bytes <= limit or len(rows) == 1
            assert not any(other != shard and other.startswith(shard) for other in by)
    assert sharding.assign_shards(empty).count() == 0


def test_html():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Home</ul></nav>
    <div class="side-bar sidebar">Side</div><article><header><h1>Big &amp; small</h1></header><p>One  <b>two</b><br>three<p>Four&nbsp;five
    <script>var x = "<p>no</p>";</script><div class="ad">Buy</div><form>Mail</form><p>Six &lt;7&gt;</article><section id="comments"><article>me too</article></section>
    <footer>&copy;</footer></body></html>"""
    assert html_extraction.main_text(page) == "Big & small\nOne two three\nFour five\nSix <7>"
    assert html_extraction.main_text("") == "" and html_extraction.main_text("plain") == "plain"
    assert html_extraction.main_text("<div>a<p>b</div>c <!-- d") == "a\nb\nc"


def test_html_template_text_is_left_out(spark):
    page = "<html><body><div>Our slogan</div><div>{0}</div><div>Made with care</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"story {i}"), 0) for i in range(6)] + [(6, None, None, 0), (7, "http://h.example/7", "", 0)]
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string, host int").where("page_id <> 7")).collect()}
    assert got == {**{i: f"story {i}" for i in range(6)}, 6: ""}


def test_html_names_count_as_a_whole():
    page = """<article><div class="header"><h1 id="search-algorithms">Search algorithms</h1></div><section id="related-work" aria-label="form of
    the tree">Related <math><mi>x</mi></math></section><div class="social-history">Past</div><div class="share-buttons">Share</div><div class=adSlot2>Buy
    </div><p title="class=ad" data-id="comments">Kept</p><div id="comments">Me too</div></article><div class=related><article>No</article></div>"""
    assert html_extraction.main_text(page) == "Search algorithms\nRelated x\nPast\nKept\nNo"
    assert html_extraction.main_text('<p>a<!-->b<!-- x --!>c<a href="x"">d</a> e') == "abcd e"


def test_html_of_any_depth_is_read_in_linear_time():
    for page in ("<div>" * 80_000, "<div>" * 40_000 + "</p>" * 40_000, "<a " * 100_000 + '"', "<b =\"" * 60_000, "<!" * 100_000, "<i>" * 50_000 + "</i>" * 50_000):
        assert html_extraction.main_text(f"kept{page}").startswith("kept")


def brute_main_texts(pages):
    """Templates by comparing whole occurrence vectors of the different pages of a host."""
    hosts = defaultdict(set)
    for _, host, page in pages:
        hosts[host].add(page or "")
    known = {}
    for host, different in hosts.items():
        vectors, places = defaultdict(dict), defaultdict(list)
        for page in different:
            for order, (kind, text, place, _, _) in enumerate(html_extraction.page_tokens(page)):
                if kind == "<" or kind == "t" and text.strip():
                    token = (kind, place, text.strip() if kind == "t" else "")
                    if page not in vectors[token]:
                        places[token].append(order)
                    vectors[token][page] = vectors[token].get(page, 0) + 1
        template = [t for t, v in vectors.items() if len(v) >= 3 and 10 * len(v) >= 9 * len(different)]
        template.sort(key=lambda t: sum(places[t]) / len(places[t]))
        spans = defaultdict(list)
        for order, token in enumerate(template):
            spans[frozenset(vectors[token].items())].append(order)
        cuts = [1 for a in spans.values() for b in spans.values() if a[0] < b[0] <= a[-1] < b[-1]]
        assert not cuts  # the classes of these pages nest
        known[host] = {t: len(vectors[t]) for t in template}
    texts = {}
    for page_id, host, page in pages:
        found = defaultdict(list)
        block = defaultdict(str)
        for kind, text, place, outside, main in [*html_extraction.page_tokens(page or ""), ("|", "", 0, False, False)]:
            if kind == "|":
                for key, value in block.items():
                    if value.split():
                        found[key].append(" ".join(value.split()))
                block.clear()
            elif kind == "t" and not outside:
                block[main, False] += text
                if known[host].get((kind, place, text.strip()), 0) < (8 if main else 1) or not text.strip():
                    block[main, True] += text
        texts[page_id] = "\n".join(found[True, True] or found[True, False] or found[False, True] or found[False, False])
    return texts


def test_html_templates_against_brute_force(spark):
    whole = "<html><body><div>Site</div><article><h1>T{0}</h1><div class=x1>Share this on our channels</div><p>Story {0}</p></article><div>End</div></body></html>"
    bare = "<body><div>Slogan</div><p>Story {0}</p><ul><li>a{0}</ul><div>Made with care</div>"
    rows = [(i, "http://eight.example/", whole.format(i)) for i in range(9)]
    rows += [(20 + i, "http://few.example/", whole.format(i)) for i in range(4)]
    rows += [(30 + i, "http://copies.example/", whole.format(0)) for i in range(12)]
    rows += [(50 + i, "http://bare.example/", bare.format(i)) for i in range(5)] + [(60, "http://bare.example/", bare.format(0))] * 2
    rows += [(70 + i, "http://lone.example/", "<div><p>Whole unique story</p></div>") for i in range(4)]
    rows += [(80, None, None), (81, None, ""), (82, "", "<p>x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    got = {r.page_id: r for r in html_extraction.extract_main_text(table.repartition(5)).collect()}
    texts = brute_main_texts([(i, url, page) for i, url, page in rows])
    assert {i: r.text for i, r in got.items()} == texts and all(r.n_chars == len(r.text) for r in got.values())
    assert texts[0] == "T0\nStory 0" and "Share this" in texts[20] and texts[70] == "Whole unique story" and texts[50] == "Story 0\na0"
    assert html_extraction.extract_main_text(table.limit(0)).count() == 0


def test_licences(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = licenses.train(corpus)
    texts = ["Released under the MIT License.", f"{PROSE} Licensed under the Apache License, Version 2.0. {PROSE}", "a licence to kill, said the spy",
             None, "", PROSE, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, families int")
    got = {r.doc_id: r for r in licenses.scan_licences(table, model).collect()}
    assert [got[i].licence for i in range(6)] == ["MIT", "Apache-2.0", "unknown", "none", "none", "none"]
    assert got[6].families == "CC-BY-NC,GPL" and got[6].n_passages >= 1
    assert licenses.scan_licences(table.where("false"), model).count() == 0


def test_licences_without_cue_words_or_in_wrapped_lines(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = licenses.train(corpus)
    header = ("This program is free software: you can redistribute\nit and/or modify it under the terms of the GNU\n"
              "General Public License as published by the Free\nSoftware Foundation.")
    texts = {"Released under GPLv3.": "GPL", "Distributed under LGPL 2.1": "LGPL", "Released under CC BY-SA 4.0.": "CC-BY-SA",
             "Released under the Apache 2.0 terms.": "Apache-2.0", "SPDX: Apache-2.0": "Apache-2.0", "Veröffentlicht unter der MIT-Lizenz.": "MIT",
             header: "GPL", f"{PROSE}\n\n{header}\n\n{PROSE}": "GPL", PROSE * 3: "none"}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licenses.scan_licences(table, model).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    side_by_side = spark.createDataFrame([(1, f"{PROSE} Released under the MIT License. Licensed under the Apache License, Version 2.0. {PROSE}")], "doc_id long, text string")
    assert licenses.scan_licences(side_by_side, model).first().families == "Apache-2.0,MIT"


def test_packing_keeps_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    end = "<|endoftext|>"
    assert list(encoder(f"a {end} b")) == [64, 220, 50256, 275]
    texts = [end, end * 2, f"a{end}", f"{end} b", f"x  {end}  y", f"a \n{end}\n b c", f" {end} ", "<|endoftext", f"{end}|>", f"<|{end}", "<|ENDOFTEXT|>"]
    for text in texts:
        assert list(encoder(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    for p in pieces:
        ids = [*tokenizer.encode(texts[p.doc_id], add_special_tokens=False).ids, 0]
        assert (p.doc_tokens, p.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
