"""A corpus pipeline over ``documents`` from five of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs:

1. language ID: documents that the classifier rejects go (a null text, one
   without letters, or one that is likelier of no learned language);
2. MinHash near-dedup: one row of each group stays, the smallest id (null last), under
   five-word shingles and a similarity of 0.8 or more;
3. benchmark decontamination: documents with a benchmark window go;
4. secret scans: secrets are masked, lower-case digests of 16 digits or more among
   them, and n_chars follows the text;
5. BPE encoding: ids (little-endian unsigned 32-bit integers) of every document,
   which ``bpe.decode_ids`` turns back into text.

Stages 1 to 4 return the columns of documents.  Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import bpe, decontaminate, langid, neardup, secrets
from tablelens.llm.common import read_documents
from tablelens.plans.cutting import passing_tables, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the classifier, trained on ``docs``, doesn't reject.
    Without labelled texts there is no classifier, and every row goes."""
    return langid.keep_identified(docs, langid.fit_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; texts without words stay."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of ``benchmark``; null texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked; n_chars, where there is one, is the new length."""
    masked = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed ids of all rows; a null text has none."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("bpe_encoding", bpe_encoding),
]

#: The classifier and the tokenizer have no SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared
    folder and read again, so that later stages don't repeat it.  A stage's table and
    its passing ones are dropped once the next one is written; the last stays."""
    docs, folder = read_documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    before = None
    for name, stage in STAGES[:-1]:
        with passing_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path(before).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(before), True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
