"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes the documents that its predecessor kept, is written as Parquet to the shared folder
and read again, so a lost executor costs one stage at most:

    language     rejects texts without a letter, or that resemble no learned language
    near_dedup   keeps one document of each class of near copies
    benchmark    rejects documents that hold a benchmark passage
    secrets      replaces secrets in the texts
    packing      cuts and packs the token ids into sequences
"""

from pyspark.sql import DataFrame, SparkSession

from yearweave.llm.decontaminate import clean
from yearweave.llm.language_id import keep_known
from yearweave.llm.order_minhash import deduplicate
from yearweave.llm.packing import sequences
from yearweave.llm.secret_scan import redact
from yearweave.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sequences(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("packing", packing),
]

#: No SQL twin: stages compare vectors, align texts and tokenise. The tests hold the rows against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
