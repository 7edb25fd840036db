"""The training-data pipeline over ``documents``: each stage calls one operator of ``vitrina.llm``.

A stage takes the rows its predecessor kept and returns rows of the same columns; the last
returns the encoded documents.  Between stages the rows are written to the shared folder, so
a lost executor never costs more than a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import decontamination, pii, piece_bpe, quality, text_join
from vitrina.llm.common import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more)."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return text_join.keep_first(docs, n=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, ``n_chars`` counted anew."""
    out = pii.redact(pii.find(docs)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the piece model: counts and digests of ids and text."""
    return piece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_first_of_group),
    ("benchmark decontamination", drop_benchmark),
    ("PII", redact),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier, the tokenizer and the discovered contexts are not SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
