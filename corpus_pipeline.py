"""The training-corpus pipeline: five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame;
``run`` writes it as Parquet in the shared folder and rereads it as the next
one's input. All but the last return the columns of ``documents``.

1. language ID: rows that the classifier rejects go.
2. SimHash near-duplicates: one document of each group stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. secret scans: secrets in the texts are replaced by ``[kind]``.
5. best-fit packing: the pieces of all that is left and their places.

Defined results: a null or empty text, or one without a letter, goes in the
first stage; texts of any length are read whole; repeated rows and copies are
one group, of which the smallest id stays (one row of equal ids); a null id
counts as the largest; without benchmark rows every document is clean; an
empty table gives no rows; extra columns, whatever their names, pass through
the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyzone.llm import decontaminate, langid, packing, secrets, simhash
from tallyzone.llm.common import read_table, shared_dir, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the stage's own input, where crc32(doc_id) mod 5 is not 0."""
    return langid.keep_known(docs, langid.fit(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, shared_dir(spark, "ledger"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("simhash_neardup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, decontamination and packing can't be stated in SQL; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
