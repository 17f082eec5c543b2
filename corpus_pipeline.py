"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of the
documents table; the last returns token ids. Stages are written as tables and read again in between, so
a lost executor costs the running stage at most.

Every stage takes an empty table and keeps it empty, keeps only the columns of the documents table whatever
else there is, and takes null ids, texts, languages and sources: a null or empty text has no words and goes in
the first stage. Of repeated rows one stays in the second; a null id is nobody's copy there and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, ngram_join, pii, quality
from ledgerloom.llm.common import load, materialize
from ledgerloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that any rule rejects go."""
    return quality.cascade(docs).where("rejected_by is null").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 or more over five-word runs."""
    return ngram_join.dedupe(docs, span=5, percent=80).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows the new text."""
    out = pii.replace(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by weights raked to tempered shares of sources, languages and topics."""
    return mixing.mix(docs).where("kept").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; intact: they decode to it again."""
    out = bpe.encode(docs, tokenizer_path(), intact="intact")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "intact")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: No SQL: the joins, surrogates and tokens of these stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
