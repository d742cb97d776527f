"""Corpus pipeline over `documents`: language ID, line dedup, near-dedup, decontamination, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents that it keeps, with the columns of `documents`; the last one returns their token
digests. run() applies them one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, decontaminate, language, lines, simhash
from strandlake.llm.queries import VOCABULARY
from strandlake.plans.joins import broadcast_if_small
from strandlake.plans.lineage import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that can be told go."""
    return language.identify(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go from the texts; all documents stay."""
    found = lines.dedup_lines(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, J >= 4/5) the document of least id stays."""
    found = simhash.similar_texts(docs)
    gone = cut(found.filter("doc_id > component_id").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(broadcast_if_small(gone, 1_000_000), "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(*COLUMNS), items).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return bpe.digests(docs, VOCABULARY)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: Fingerprints, edit verification and tokens can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
