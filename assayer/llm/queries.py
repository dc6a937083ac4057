"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..scale import scratch_path
from . import oracles
from .conversations import Repair, damaged, repaired_digests
from .exact_dedup import DigestIndex
from .hard_negatives import mine_hard_negatives
from .html_extraction import extract_main_text
from .licenses import scan_licences
from .mixing import Mix
from .packing import pack
from .quality import judge_quality
from .registry import ORACLES, QUERIES, query, table
from .sharding import assign_shards
from .simhash import near_duplicates
from .substring_dedup import cut_shared_passages
from .suffix_dedup import cut_repeats
from .url_filter import RULE_SCHEMA, judge_urls

__all__ = ["ORACLES", "QUERIES"]


@query("op1_exact_dedup", oracles.EXACT_DEDUP)
def op1(spark, sf_dir):
    return DigestIndex(spark, scratch_path(spark)).add(table(spark, sf_dir, "documents"), "documents")


@query("op2_license_scan")
def op2(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def op3(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op4_url_filter", oracles.URL_FILTER)
def op4(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULE_SCHEMA))


@query("op5_quality_rules", oracles.QUALITY)
def op5(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents"))


@query("op8_simhash_near_dedup")
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_mixing")
def op9(spark, sf_dir):
    return Mix(table(spark, sf_dir, "documents")).taken()


@query("op6_html_extraction")
def op6(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op7_packing")
def op7(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op10_suffix_array_dedup")
def op10(spark, sf_dir):
    return cut_repeats(table(spark, sf_dir, "documents"), digests=True)


@query("op11_substring_dedup")
def op11(spark, sf_dir):
    return cut_shared_passages(table(spark, sf_dir, "documents"), digests=True)


@query("op12_hard_negatives", oracles.HARD_NEGATIVES)
def op12(spark, sf_dir):
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op13_conversation_repair")
def op13(spark, sf_dir):
    return repaired_digests(Repair(damaged(table(spark, sf_dir, "conversations"))))
