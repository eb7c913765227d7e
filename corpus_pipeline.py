"""Documents to packed windows: language ID, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. Its result
is written as Parquet and read again as the next one's documents; what a stage had written on
its way is deleted then, and a stage's result once the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawscope.llm import decontam, jaccard, langid, linededup, packing, queries
from drawscope.scratch import new_path, release, scope, table

#: Bits a byte of the uniform code, at which a text is in none of the languages learnt.
UNIFORM_BITS = 8.0

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt, with ``lang`` as predicted. Those go that hold no
    letter, and those that the best context tree codes in no fewer bits than bytes drawn at random.
    Where no row can train (no ``lang``, or none outside the held-out ids), every document with a letter
    stays, with the ``lang`` it has. Rows without an id train like others."""
    model = queries.language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.with_language(docs, model)
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("lang_bits") < UNIFORM_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines cut; a document that was nothing else goes. n_chars follows the text."""
    cut = linededup.dedup_lines(docs, queries.MIN_SITES)
    kept = cut.where((F.col("__n_cut") == 0) | (F.col("__n_cut") < F.col("__n_lines")))
    return kept.withColumn("n_chars", F.when(F.col("__n_cut") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the first in the order of ids."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("__hits.items") == 0).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in the windows."""
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("packing", windows)]

#: Tokenising and packing can't be written in SQL; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            out = new_path(spark, name.replace(" ", "-"))
            made.write.option("compression", "zstd").parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
        docs.scratch_path = out
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
