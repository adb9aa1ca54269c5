"""From documents to training sequences: five stages, each over all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Nulls: a document without letters is rejected by the first stage, a null text with it. A null doc_id is never grouped with
others and stays. Empty table: empty result. Rows that share a doc_id stay or go together.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import crf_language, cube, jaccard_join, line_chunks, piece_lattice
from siftwell.llm._common import saved, table

#: A document stays if its best language has this share of its words at least. Code-switched documents stay: only one
#: in which no language stands out goes.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; lang is the predicted one where it was null."""
    model = crf_language.fitted(docs, "doc_id", "text", "lang", crf_language.fold("doc_id") != 1)
    known = crf_language.predicted(docs, model, "text", ("__lang", "__share"))
    kept = known.where((F.col("__lang") != "und") & (F.col("__share") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that came before elsewhere; n_chars follows the text."""
    return line_chunks.deduped(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id."""
    gone = jaccard_join.joined(docs.select("doc_id", "text")).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    taken = cube.mixed(docs.select("doc_id", "source", "text")).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    both = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__id"]))
    return both.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, nbest, intact): the training sequences."""
    return piece_lattice.encoded(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", keep_one_of_similar),
    ("source_mix", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
