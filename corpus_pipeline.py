"""Training-data pipeline over ``documents``: five stages, each one operator of ``rosterline.llm``.

1. language: documents whose language the word CRF does not know go;
2. near_duplicates: one document of each class of near duplicates stays;
3. decontaminate: documents that hold a benchmark window go;
4. private: personal data is masked in the text;
5. pack: the texts are tokenised and packed into sequences.

Every stage but the last returns the columns of ``documents``.

Defined cases: a null or empty text, and one without a letter, has no language and goes
in the first stage; texts of any length are read whole; null ids and ids that several
texts share are ids like others, texts are told apart by their content; of repeated rows,
as of near copies, one stays; ties go to the smallest id; an empty table gives no pieces. The
operators pick the columns they name, so further columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterline.llm import decontam, jaccard, langid, packing, pii
from rosterline.llm.common import materialize, read_table

#: Least language score; of text that switches between two languages, half is in one of them.
LEAST_LANGUAGE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("private", private), ("pack", pack),
]

#: Learned models, similarity classes and tokens are beyond SQL; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
