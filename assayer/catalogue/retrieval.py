"""Documents, vectors and requests over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import findings as fnd
from ..operators.anomaly import zscore_outliers
from ..operators.documents import (
    chunk_documents,
    chunk_id,
    corpus_fingerprint,
    detect_changed_documents,
    document_errors,
    extract_html_text,
)
from ..operators.grounding import ground_findings, json_leaves, semantic_constraint_match
from ..operators.relevance import keyword_relevance
from ..operators.retrieval import HashingEmbedder, embed, latest_vectors, metadata_filter, vector_search, vector_search_batch
from ..plans.run import search_documents
from ..scale import freeze
from ..sources import batches
from ..sources.readers import scan_documents
from ..sources.vectors import ChunkIndex
from .findings import RUN, ZSCORE_RULE
from .registry import query, scratch, table

# Folders that the files of pages are dealt to, at least, and pages that a folder has about, at most.
PAGE_SHARDS, SHARD_PAGES = 256, 500

# Same windows as the operator: the window ends at the last blank past its middle.
CHUNK_SQL = """WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0),
w AS (
  SELECT doc_id, 0 AS st, CASE WHEN n <= 1200 THEN n ELSE
      CASE WHEN position(' ' IN reverse(translate(substr(text, 1, 1200), chr(10), ' '))) > 0
            AND 1200 - position(' ' IN reverse(translate(substr(text, 1, 1200), chr(10), ' '))) > 600
           THEN 1200 - position(' ' IN reverse(translate(substr(text, 1, 1200), chr(10), ' '))) ELSE 1200 END END AS e
  FROM d
  UNION ALL
  SELECT q.doc_id, q.s, CASE WHEN q.n <= q.s + 1200 THEN q.n ELSE
      CASE WHEN q.p > 0 AND q.s + 1200 - q.p > q.s + 600 THEN q.s + 1200 - q.p ELSE q.s + 1200 END END
  FROM (SELECT d.doc_id, d.n, greatest(w.e - 200, w.st + 1) AS s,
               position(' ' IN reverse(translate(substr(d.text, greatest(w.e - 200, w.st + 1) + 1, 1200), chr(10), ' '))) AS p
        FROM w JOIN d ON w.doc_id = d.doc_id WHERE w.e < d.n) q),
f AS (SELECT w.doc_id, w.st, w.e, trim(substr(d.text, w.st + 1, w.e - w.st), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160))) AS fragment
      FROM w JOIN d ON w.doc_id = d.doc_id),
c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS INTEGER) AS chunk_index,
             CAST(st AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char, fragment AS text FROM f WHERE length(fragment) > 0)
"""


@query("chunk_documents", CHUNK_SQL + "SELECT doc_id, chunk_index, start_char, end_char, text FROM c")
def q_chunks(spark, sf_dir):
    return chunk_documents(table(spark, sf_dir, "documents"), "doc_id")


@query("chunk_id", CHUNK_SQL + """, h AS (SELECT doc_id, chunk_index, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') ||
  encode(concat(doc_id, ':', chunk_index, ':', start_char, ':', end_char, ':', text))) AS h FROM c)
SELECT doc_id, chunk_index, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
  substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INTEGER % 4), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS chunk_id FROM h""")
def q_chunk_ids(spark, sf_dir):
    chunks = chunk_documents(table(spark, sf_dir, "documents"), "doc_id")
    return chunks.select("doc_id", "chunk_index", chunk_id(F.col("doc_id")).alias("chunk_id"))


# Hidden elements and comments end a run of text, so does any run of tags; blank runs between tags shrink.
HTML_SQL = r"""WITH m AS (SELECT page_id, regexp_replace(html,
  '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->', '<x>', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
  '(?s)>[ \t\r\f]+<', '> <', 'g'), '(?s)>[ \t\r\n\f]*\n[ \t\r\n\f]*<', concat('>', chr(10), '<'), 'g'),
  '(?s)(?:<(?:"[^"]*"|''[^'']*''|[^''">])*>)+', chr(10), 'g'), '&quot;', '"', 'g') AS t FROM m)
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'),
  '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\n{3,}', concat(chr(10), chr(10)), 'g'),
  concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160))) AS text FROM t"""


@query("extract_html_text", HTML_SQL)
def q_html(spark, sf_dir):
    return extract_html_text(table(spark, sf_dir, "pages")).select("page_id", "text")


@query("document_errors", "SELECT page_id, 'TypeError' AS kind FROM pages WHERE page_id % 10 = 0")
def q_errors(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 10 != 0, F.col("html")))
    failed = document_errors(extract_html_text(pages), "page_id")
    return failed.select("page_id", F.split_part("error", F.lit(":"), F.lit(1)).alias("kind"))


def write_pages(pages, path):
    """A file for each page, every tenth cut within a letter.

    The files lie in folders by shard, each written by one task: the listing is dealt by shards, and a shard is
    moved into place as a whole.  A writer reports every folder it made to the driver, so the shards are written
    some ``FILES_AT_ONCE`` pages at a time, from a table that has them apart.
    """
    spark, count = pages.sparkSession, pages.count()
    shards = max(PAGE_SHARDS, -(-count // SHARD_PAGES))
    at_once = -(-shards // max(1, -(-count // batches.FILES_AT_ONCE)))
    shard = F.pmod(F.xxhash64("page_id"), F.lit(shards)).cast("int")
    dealt = pages.select("*", shard.alias("shard"))
    rounds = [dealt]
    if at_once < shards:
        apart = scratch(spark)
        by_round = dealt.withColumn("round", F.floor(F.col("shard") / at_once).cast("int"))
        by_round.repartition(F.col("shard")).write.partitionBy("round").parquet(apart)
        made = sorted(r["round"] for r in spark.read.parquet(apart).select("round").distinct().collect())
        rounds = [spark.read.schema(dealt.schema).parquet(f"{apart}/round={r}") for r in made]
    cut = F.concat("html", F.expr("string(unhex('E282'))"))
    for some in rounds:
        value = F.when(F.col("page_id") % 10 == 0, cut).otherwise(F.col("html")).alias("value")
        by_shard = some.repartitionById(at_once, F.col("shard") % at_once).select("page_id", value, "shard")
        by_shard.write.mode("append").option("lineSep", "\u0020").partitionBy("shard", "page_id").text(path)


@query("scan_documents", HTML_SQL.replace("SELECT page_id, trim(", "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'UnicodeDecodeError' END AS kind, CASE WHEN page_id % 10 <> 0 THEN trim(")
       .replace("chr(160))) AS text FROM t", "chr(160))) END AS text FROM t"))
def q_scan_documents(spark, sf_dir):
    """The pages written as one file each; every tenth ends within a letter."""
    path = scratch(spark)
    write_pages(table(spark, sf_dir, "pages").select("page_id", "html"), path)
    found = scan_documents(spark, path, document_format="html")
    page = F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("long").alias("page_id")
    return found.select(page, F.split_part("error", F.lit(":"), F.lit(1)).alias("kind"), "text")


@query("json_leaves", """SELECT event_id, concat('b ', event_type, '|', user_id, '|x:"y"\\|true|', event_type, '|', json_extract_string(props, '$.k')) AS leaves FROM events""")
def q_leaves(spark, sf_dir):
    """Values of nested objects and lists, whatever their depth."""
    inner = F.struct(F.concat(F.lit("b "), "event_type").alias("b"), F.array(F.struct(F.col("user_id").alias("u"), F.lit(None).cast("string").alias("n"))).alias("l"))
    nested = F.struct(F.array(F.array(inner)).alias("a:"), F.array(F.lit('x:"y"\\')).alias("q"), F.struct(F.struct(F.lit(True).alias("t")).alias("s")).alias("s"),
                      F.create_map(F.lit("k"), F.col("event_type")).alias("m"), F.from_json("props", "k int").alias("p"))
    text = F.to_json(nested, {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "events").select("event_id", F.array_join(json_leaves(text), "|").alias("leaves"))


@query("detect_changed_documents", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def q_changed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    indexed = docs.where("doc_id % 11 <> 0").withColumn(
        "n_chars", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    )
    return detect_changed_documents(docs, indexed, ("doc_id", "n_chars"))


@query("corpus_fingerprint", """WITH h AS (SELECT sha256(concat('{"doc_id":', doc_id, ',"n_chars":', n_chars, '}')) AS h FROM documents),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b,
  sum(('0x' || substr(h, 31, 15))::BIGINT) AS c, sum(('0x' || substr(h, 46, 15))::BIGINT) AS d FROM h)
SELECT n AS documents, sha256(concat_ws('|', 'hashing', 'audit', n, a, b, c, d)) AS fingerprint FROM s""")
def q_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return corpus_fingerprint(docs, model="hashing", collection="audit", state=("doc_id", "n_chars"))


@query("semantic_constraint_match", """WITH n AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, (contains(t, 'licensed') OR contains(t, 'rights reserved') OR contains(t, 'license'))
  AND (contains(t, 'mit') OR contains(t, 'apache')) AND (contains(t, 'license') OR contains(t, 'copyright')) AS matches FROM n""")
def q_constraint(spark, sf_dir):
    match = semantic_constraint_match(
        F.col("text"),
        F.array(F.lit(" MIT "), F.lit("Apache"), F.lit("x")),
        F.array(F.lit("License"), F.lit("copyright")),
        ("licensed", "rights reserved", "license"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", match.alias("matches"))


_WORDS_SQL = """w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_-]{3,}'))) AS c FROM documents),
s AS (SELECT doc_id, """ + " + ".join(
    f"max(CASE WHEN contains(c, '{t}') OR contains('{t}', c) OR (length(c) >= 5 AND length('{t}') >= 5 AND c[1:5] = '{t}'[1:5]) THEN 1 ELSE 0 END)"
    for t in ("license", "retention", "policy")
) + " AS score FROM w GROUP BY doc_id)"


@query("keyword_relevance", f"WITH {_WORDS_SQL} SELECT doc_id, CAST(score AS INTEGER) AS score FROM s WHERE score >= 1")
def q_relevance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword_relevance(docs, "Check the license retention policy".replace("the ", "")).select("doc_id", "score")


@query("keyword_relevance_best", f"WITH {_WORDS_SQL} SELECT doc_id, CAST(score AS INTEGER) AS score FROM s WHERE score = (SELECT max(score) FROM s)")
def q_relevance_best(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword_relevance(docs, "only license retention policy").select("doc_id", "score")


def _first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@query("vector_search", """
SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 5
""")
def q_search(spark, sf_dir):
    others = table(spark, sf_dir, "embeddings").where("vec_id <> 0")
    found = vector_search(others, _first_vector(spark, sf_dir), 5, order=["vec_id"])
    return found.select("vec_id", "label", F.round("score", 5).alias("score"))


@query("vector_search_filtered", """
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score
FROM embeddings e, (SELECT embedding, label FROM embeddings WHERE vec_id = 0) q WHERE e.label = q.label
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 5
""")
def q_search_filtered(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings").withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    first = index.where("vec_id = 0").first()
    same = metadata_filter(index, {"label": str(first["label"])})
    return vector_search(same, first["embedding"], 5, order=["vec_id"]).select("vec_id", F.round("score", 5).alias("score"))


_BATCH_SQL = """
SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q) WHERE rank <= 3
"""


def _batch(spark, sf_dir, blocked):
    index = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = index.withColumnRenamed("vec_id", "query_id")
    found = vector_search_batch(index, queries, 3, index_key="vec_id", query_key="query_id", blocked=blocked)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@query("vector_search_batch", _BATCH_SQL)
def q_batch(spark, sf_dir):
    return _batch(spark, sf_dir, None)


@query("vector_search_blocked", _BATCH_SQL)
def q_blocked(spark, sf_dir):
    """The form for query sets too large to ship."""
    return _batch(spark, sf_dir, True)


@query("index_chunks", """
SELECT vec_id, label, (vec_id % 3)::INTEGER AS version FROM embeddings
""")
def q_upsert(spark, sf_dir):
    """Vectors written up to three times; the newest row of each key stays."""
    base = table(spark, sf_dir, "embeddings")
    written = base.withColumn("version", F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 3).cast("int"))))
    return latest_vectors(written, "vec_id", "version").select("vec_id", "label", "version")


@query("reindex_chunks", CHUNK_SQL + """SELECT doc_id, chunk_index, start_char, end_char, text, 64 AS dimension,
CASE WHEN doc_id % 10 = 0 OR doc_id % 17 = 3 THEN 2 ELSE 1 END::BIGINT AS generation FROM c""")
def q_reindex(spark, sf_dir):
    """An index of an earlier state, brought up to the documents: a tenth changed, some new, some gone."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = documents.where("doc_id % 17 <> 3").withColumn(
        "text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Earlier words. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    gone = documents.where("doc_id % 13 = 5").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    index = ChunkIndex(spark, scratch(spark), buckets=16)
    index.reindex(earlier.unionAll(gone), HashingEmbedder)
    index.reindex(documents, HashingEmbedder)
    return index.read().select("doc_id", "chunk_index", "start_char", "end_char", "text", F.size("embedding").alias("dimension"), "generation")


def embedded_chunks(spark, sf_dir):
    chunks = chunk_documents(table(spark, sf_dir, "documents"), "doc_id")
    chunks = chunks.withColumn("chunk_id", chunk_id(F.col("doc_id"))).withColumn("source_id", F.col("doc_id").cast("string"))
    return embed(chunks, "text", HashingEmbedder)


def chunk_index(spark, sf_dir):
    """The embedded chunks as a written table, which is what searches read."""
    return freeze(embedded_chunks(spark, sf_dir))


# Sums of signed words per place of the vectors, as the hashing embedder makes them.
VECTOR_SQL = CHUNK_SQL + """, k AS (SELECT doc_id, chunk_index, ('0x' || substr(md5(word), 1, 8))::BIGINT AS code
  FROM (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM c)),
v AS (SELECT doc_id, chunk_index, code % 64 AS place, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS x FROM k GROUP BY ALL),
p AS (SELECT doc_id, chunk_index, count(*) FILTER (x > 0) AS n_positive, count(*) FILTER (x < 0) AS n_negative, sqrt(sum(x * x)) AS norm,
  CASE WHEN max(x) > 0 THEN arg_max(place, x * 100 - place) END AS heaviest FROM v GROUP BY ALL)
"""


@query("embed", VECTOR_SQL + """SELECT c.doc_id, c.chunk_index, 64 AS dimension, CASE WHEN coalesce(norm, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
  coalesce(n_positive, 0)::INTEGER AS n_positive, coalesce(n_negative, 0)::INTEGER AS n_negative, heaviest::BIGINT AS heaviest
FROM c LEFT JOIN p USING (doc_id, chunk_index)""")
def q_embed(spark, sf_dir):
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = F.array_max("embedding")
    return embedded_chunks(spark, sf_dir).select(
        "doc_id", "chunk_index", F.size("embedding").alias("dimension"), F.round(F.sqrt(square), 4).alias("norm"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"),
        F.size(F.filter("embedding", lambda x: x < 0)).alias("n_negative"),
        F.when(most > 0, F.array_position("embedding", most) - 1).alias("heaviest"),
    )


@query("search_documents", VECTOR_SQL + """, q AS (SELECT code % 64 AS place, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS y FROM (
  SELECT ('0x' || substr(md5(word), 1, 8))::BIGINT AS code FROM (VALUES ('license'), ('and'), ('copyright')) AS words(word)) GROUP BY ALL),
s AS (SELECT p.doc_id, p.chunk_index, coalesce(sum(x * y), 0) / (any_value(norm) * (SELECT sqrt(sum(y * y)) FROM q)) AS score
  FROM p JOIN v USING (doc_id, chunk_index) LEFT JOIN q USING (place) WHERE norm > 0 GROUP BY ALL),
h AS (SELECT doc_id, chunk_index, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') ||
  encode(concat(doc_id, ':', chunk_index, ':', start_char, ':', end_char, ':', text))) AS h FROM c),
i AS (SELECT doc_id, chunk_index, concat(substr(h, 1, 8), substr(h, 9, 4), '5', substr(h, 14, 3),
  substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INTEGER % 4), 1)) AS id FROM h)
SELECT doc_id, chunk_index, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 5) AS score
FROM s JOIN i USING (doc_id, chunk_index) QUALIFY rank <= 5""")
def q_search_documents(spark, sf_dir):
    return search_documents(chunk_index(spark, sf_dir), "license and copyright", HashingEmbedder).select(
        "doc_id", "chunk_index", "rank", F.round("score", 5).alias("score")
    )


@query("ground_findings", """
SELECT concat('FND-', upper(substr(sha256(concat('EVENT_VALUE|statistical_anomaly|', event_id)), 1, 16))) AS finding_id,
       3::BIGINT AS references, true AS tagged
FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY event_type))
WHERE sd > 0 AND abs((value - m) / sd) > 4.0
""")
def q_ground(spark, sf_dir):
    exceptions = zscore_outliers(table(spark, sf_dir, "events"), ZSCORE_RULE.anomaly)
    findings = fnd.dedupe_findings(fnd.rule_candidates(exceptions, ZSCORE_RULE, RUN, "event_id"))
    tagged, references = ground_findings(freeze(findings), chunk_index(spark, sf_dir), HashingEmbedder, request="license policy")
    counts = references.groupBy("finding_id").agg(F.count("*").alias("references"))
    return tagged.join(counts, "finding_id").select(
        "finding_id", "references", F.array_contains("tags", "rag_grounded").alias("tagged")
    )


@query("uuid5", """WITH h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat(event_type, ':', event_id))) AS h FROM events)
SELECT event_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
  substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INTEGER % 4), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS uuid FROM h""")
def q_uuid(spark, sf_dir):
    key = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", ids.uuid5(key).alias("uuid"))
