"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame. All but the last return the columns of documents. What a
stage rejects is gone for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.llm.decontaminate import without_contaminated
from driftledger.llm.packing import pack_documents
from driftledger.llm.pii import redact
from driftledger.llm.quality_cnn import score, train
from driftledger.llm.queries import table, tokenizer_path
from driftledger.llm.similar import one_of_each_similar
from driftledger.llm.storage import free_name, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network takes for good."""
    net = train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "score")
    return score(docs, net, docs.columns, name).where(F.col(name) >= 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that ball hashing, hubs and rare shingles link, each link of similarity 0.8."""
    return one_of_each_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by marks, and their lengths counted anew."""
    out = redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(out.schema["n_chars"].dataType), "n_chars"))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, each with its place in a sequence of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", packing),
]

#: Fitted networks, hashes and tokenizers are beyond SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
