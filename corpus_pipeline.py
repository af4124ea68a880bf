"""A corpus pipeline of five stages: from documents to token-ID files.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Stages
are stored as Parquet in the shared folder, and the next one reads that table, which is then deleted.

Null and empty texts pass like others and are scored as empty; copies of each other, of them one
stays. Null and repeated ``doc_id`` are kept apart by their texts. Extra columns pass through. A
stage that drops everything, or an empty table, gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowrill.llm.decontaminate import drop_contaminated
from flowrill.llm.frames import fresh
from flowrill.llm.mixing import replicate
from flowrill.llm.near_dups import drop_near_copies
from flowrill.llm.quality import keep_good
from flowrill.llm.token_files import token_id_output
from flowrill.session import delete_path, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to the square root of their shares, and shuffled."""
    mixed = replicate(docs, copy=fresh(docs, "copy"), order_key=fresh(docs, "order_key"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files; a row for each document read back from them."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_id_output(docs, shared_dir(spark, "tokens"), tokenizer)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

ORACLE_SQL = None  # a learned classifier and a tokenizer are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete_path(spark, before)
        docs, before = spark.read.schema(docs.schema).parquet(path), path
    result = STAGES[-1][1](spark, docs, sf_dir)  # its files and their index are written
    delete_path(spark, before)
    return result
