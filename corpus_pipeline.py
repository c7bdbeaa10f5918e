"""A training corpus from documents: language ID, near-duplicates, secrets, mixing, packing.

Nulls: a document of null or blank text has no language and goes with the first stage; a null language is filled in there; a null
source is a source of its own; a document of null id takes part in all stages, and the near-duplicate stage keeps it, since it
cannot be told apart. Ties: of near copies the smallest id stays. Repeated rows of one id are one document from the
near-duplicate stage on. Texts of any length are worked on whole, and an empty table gives no rows.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from terrafuse.llm import langid, mixing, packing, secrets, similar
from terrafuse.plans.cut import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; a missing language is filled in."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity 0.8 or more) the document with the smallest id stays."""
    return similar.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens meet the targets of source, language and topic."""
    return mixing.sample(docs, whole=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models and iterative stages have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet in the shared folder and read again by the next; only the last one's rows stay there."""
    folder = posixpath.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _drop(spark, f"{folder}/{k - 1}")
    return docs
