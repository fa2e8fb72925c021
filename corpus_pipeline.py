"""A training-data pipeline over ``documents``: each stage is one operator of ``millrace.llm`` with its decisions applied.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. Documents that a stage has no reason to drop go on, null and empty texts included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.common import stash
from millrace.llm.decontam import drop_contaminated
from millrace.llm.jaccard import drop_near_copies
from millrace.llm.pii import redact
from millrace.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more. Labels of a fifth of the documents are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return drop_near_copies(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which any 13-word window of ``benchmark`` occurs."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data, disguised or not."""
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("ids",))


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("PII", personal_data), ("BPE encoding and decoding", encoding)]

#: SQL can't express the trained toxicity stage; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k}")
    return docs
