"""The corpus pipeline: reject low quality, drop near-duplicates, take out secrets, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read as the next one's docs.
All but the last return the columns of documents. Every stage takes nulls in any column, empty and very long texts, repeated rows, rows that share an id, further
columns and empty tables: an empty table gives an empty one, and what else becomes of such rows is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import mixing, packing, quality_classifier, secrets, simhash
from parlance.llm.runtime import delete, materialize, passing
from parlance.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; its labellers and scorer are fitted on the stage's own input. Texts without words, null ones included, go; repeated rows are
    judged alike; nulls in other columns stay."""
    scorer, _ = quality_classifier.fit(docs)
    return quality_classifier.keep_good(docs, scorer)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity of at least 0.8), the one with the smallest doc_id (null last).
    Of rows equal in id and text one stays; different texts that share an id, or have none, are told apart; texts without words are one group."""
    return simhash.keep_one(docs, similarity=0.8, n=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark and n_chars set to the new length. Texts without secrets, null ones included, stay as they are."""
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes. No document is used twice here, as near-duplicates are out. Null languages and sources are
    leaves of their own; null texts have no tokens."""
    return mixing.select_rows(docs, mixing.Mixture(percent=80, max_epochs=1))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 1024 tokens. A null or empty text is the end id alone; repeated rows are packed one by one."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's fit and the token ids can't be said in SQL; a test holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is a table in the shared folder, and what a stage has made on the way, and the table
    before it, go once its own is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing() as kept:
            docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.add(path)
        if before:
            delete(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
