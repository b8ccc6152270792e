"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, embedding_dedup, lloyd, minhash, packing, pii, quality, slack_packing, storage, substrings, urls, variants, vptree, warc_zip
from .sql import ORACLE_SQL as ORACLE_SQL
from .urls import ALLOW, BLOCK, Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


#: Scores from here on are good.
GOOD = 0.3


def fit_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Field:
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs, labels)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, fit_quality(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


URL_RULES = [
    Rule("com", "/en/", BLOCK),
    Rule("example.com", "/en/7", ALLOW),
    Rule("net", "/de/", ALLOW),
    Rule("example.net", "/de/8", BLOCK),
    Rule("org", "/es/", BLOCK),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_decoded=True)
    return encoded.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, length=20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc_zip.write(table(spark, sf_dir, "pages"), storage.new_path(spark, "warc"), least_bytes=0)
    return warc_zip.read(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_vptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), carry=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *map(count, pii.KINDS[:4]), F.sha2(pii.as_text("base"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op11_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_crf": op1_quality_crf,
    "op2_url_filter": op2_url_filter,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc_zip": op6_warc_zip,
    "op7_vptree_search": op7_vptree_search,
    "op8_pii": op8_pii,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_variant_groups": op11_variant_groups,
    "op12_slack_packing": op12_slack_packing,
    "op13_lloyd": op13_lloyd,
}
