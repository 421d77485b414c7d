"""Corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever further columns these have and however they are
called. Empty tables give empty tables; ids may be null or repeat; texts may be null, empty or very long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import bpe, decontamination, language_id, line_dedup, simhash, simhash_sets
from voxloom.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or close to no learned language, go.

    Null and empty texts have no letter and go. Repeated rows go or stay alike. If no row has a language, all go.
    """
    return language_id.keep_known_languages(docs, language_id.learn_languages(language_id.training_rows(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one are cut out; documents left without a line go.

    Null and empty texts stay as they are. Of equal lines the one with the least (doc_id, line) stays; rows that repeat an
    id and a text are one document and keep the same lines.
    """
    return line_dedup.without_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over 5-word shingles, the one with the least id stays.

    SimHash fingerprints propose the pairs; their sets of shingles decide. Null, empty and wordless texts are copies of
    each other. A null id comes last, ties go to the least hash of the text, and rows that repeat an id and a text stay
    once.
    """
    return simhash.keep_first(docs, simhash_sets.set_components(docs, words=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; repeated rows go or stay alike; with an empty benchmark all stay.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of ids and decoded text, a row for each row.

    Null and empty texts have no tokens; repeated rows are encoded alike.
    """
    return bpe.encode_documents(docs, ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("bpe_encode", encode),
]

#: Fingerprints, edit distances of hashed variants and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
