"""The corpus pipeline: quality filter, near-duplicate removal, passage removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back as
the docs of the next one.  All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigil.llm import minhash, packing, pii, quality, storage, substrings
from vigil.llm.queries import GOOD, fit_quality, table

#: Quality, similarity of redacted texts and packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row in one column, so that columns that an operator adds hide none of it."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def _with_text(docs: DataFrame) -> DataFrame:
    """docs with n_chars made to fit its text, where there is one."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: dict[str, list[str]] = {}


def _stage(work: Stage) -> Stage:
    """Deletes what the stage before has left in the shared folder.

    So the result of a stage must be written before the next stage is called, as run() does; frames that are not written are lost then.
    """

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.release(spark, _LEFT.pop(spark.sparkContext.applicationId, []))
        with storage.recording(spark) as paths:
            out = work(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = paths
        return out

    return run


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled rows of the input, finds bad.

    Each row is judged by its own text, whatever its doc_id.  A null text, or one without a word, scores 0 and goes.  All columns stay as they are.
    """
    field = fit_quality(spark, docs, sf_dir)
    return quality.score(_apart(docs), field).where(F.col("score") >= GOOD).select("row.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id.

    Of several rows with that doc_id the text decides, and of fully equal ones any one stays.  A row is judged by its own text, whatever other
    rows have its doc_id or none.  Documents without a word, and those that link with nothing, all stay.
    """
    found = minhash.near_groups(docs).where("first is not null").groupBy("doc_id", "text_key").agg(F.any_value("first").alias("first"), F.count("*").alias("n"))
    goes = (F.col("first") != F.struct("doc_id", "text_key")).alias("goes")
    odd = found.select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_text"), "n", goes).where("goes or n > 1")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(minhash.NO_ID)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    joined = keyed.join(odd, (F.col("id") == F.col("its_id")) & (F.col("key") == F.col("its_text")), "left").where(~F.coalesce("goes", F.lit(False)))
    one = joined.where("n > 1").withColumn("place", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.xxhash64("row")))).where("place = 1")
    return joined.where("n is null or n = 1").select("row.*").unionByName(one.select("row.*"))


@_stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 20 words and more that stand earlier; others keep their text as it is.

    A document of which no word is left goes.  A null text or one without words stays as it is, rows without doc_id count as earlier than all others, and repeated
    rows are all treated alike.  Only text and n_chars change.
    """
    left = substrings.remove_repeats(_apart(docs)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(left.select(F.col("row").withField("text", text).alias("row")).select("row.*"))


@_stage
def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that reveal it.

    A null text stays null, an empty one empty; doc_id plays no part, and repeated rows are all treated alike.  Only text and n_chars change.
    """
    return _with_text(pii.sanitise(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences.

    A null or empty text is one token, the end of the document; each row is packed on its own, also repeated ones and those without doc_id.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("PII", redaction),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{storage.shared_dir(spark)}/pipeline/{storage.fresh_name(name)}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            storage.delete(spark, before)
        before = path
    return docs
