"""A corpus pipeline: five stages over the documents table, each written and read again.

Stages work on all rows that the stage before them kept, and only on what they are given. Rows that
repeat a doc_id go through every stage on their own; of rows that repeat a text one stays. Null texts leave with the language
stage; nulls in other columns stay as they are. An empty table goes through empty. Columns
other than those of documents are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._text import shared_dir
from tidewatch.llm.decontaminate import decontaminate
from tidewatch.llm.language import fit_language_model, identify_language
from tidewatch.llm.mixing import plan_mix, write_order
from tidewatch.llm.near_duplicates import without_near_duplicates
from tidewatch.llm.secrets import scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the labelled languages; texts without a letter go. lang stays as given."""
    model = fit_language_model(docs)
    found = identify_language(docs, model, keep=COLUMNS[1:])
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicate texts, that of the smallest id; ids that repeat hide no other text."""
    return without_near_duplicates(docs.select(*COLUMNS))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated rows."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS[1:])
    return found.where("not contaminated").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; the documents stay."""
    found = scan_secrets(docs.select(*COLUMNS), mark="[REDACTED]")
    chars = F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return found.withColumn("n_chars", chars).withColumn("text", F.col("redacted")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy, with its shard, pass and place, in reading order."""
    return write_order(plan_mix(docs, keep=COLUMNS[1:])).select(*COLUMNS, "shard", "pass", "place")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("secrets", without_secrets),
    ("mix", mixed),
]

#: Language, chosen paths and the splitting tree can't be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return STAGES[-1][1](spark, docs, sf_dir)
