"""A corpus from raw documents to token ids, in five stages that each take all that the one before kept.

Rows are documents. A stage drops whole rows and changes none; a document that shares its id with another one is told
apart by its text. A table without rows stays without rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorform.llm import bpe, jaccard, langid, mil, winnow
from priorform.llm._common import store, text_key
from priorform.llm.queries import RANKS, held_out, table

LEAST_QUALITY = 0.5  # documents below go


def _only(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id and text are, or are not, among ``id, k``."""
    same = F.col("d.doc_id").eqNullSafe(F.col("w.id")) & (F.col("d.__k") == F.col("w.k"))
    keyed = docs.withColumn("__k", text_key())
    return keyed.alias("d").join(wanted.alias("w"), same, how).select(*(F.col(f"d.`{c}`") for c in docs.columns))


def _short_batches(spark: SparkSession) -> None:
    """Python takes texts by the thousand: an executor's memory holds few batches of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; null texts, texts without letters and texts of which nothing is known go."""
    _short_batches(spark)
    found = langid.identify(docs, langid.train(docs), into=("__lang", "__score", "__known"))
    return found.where(F.col("__known") & (F.col("__lang") != langid.UNKNOWN_LANGUAGE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores ``LEAST_QUALITY`` or more."""
    _short_batches(spark)
    model = mil.train(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return mil.score(docs, model, into="__score").where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a Jaccard similarity of 0.8 or more over five-word shingles: the smallest id.

    Documents without words are no group and stay; repeated rows are one.
    """
    _short_batches(spark)
    linked = jaccard.link(docs, width=5, percent=80)
    row = F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("k"))
    wordless = linked.where("n_shingles = 0").select(row.alias("r"))
    first = linked.where("n_shingles > 0 and doc_id <=> component_id").groupBy("group_key").agg(F.min(row).alias("r")).select("r")
    kept = _only(docs, first.unionByName(wordless).select("r.id", "r.k").distinct(), "left_semi")
    return kept.withColumn("__k", text_key()).dropDuplicates(["doc_id", "__k"]).drop("__k")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    _short_batches(spark)
    found = winnow.report(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return _only(docs, found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("k")).distinct(), "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text_sha256``: token ids, little-endian 32 bits each, and the digest of their decoding."""
    _short_batches(spark)
    ids = bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]
ORACLE_SQL = None  # two stages apply trained models, which SQL cannot express; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
