"""A training corpus from ``documents``: five stages, each on all that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases: null and empty texts are scored like any other by the first stage and have no language, so the second
rejects them; rows without id are scored and labelled but never learnt from, and near-duplicates never drop them; an id
that repeats with other texts is as many documents; rows that repeat id and text are one from near_dedup on; texts of any
length are read whole; of equal or tied documents the smallest id stays; extra columns stay in all stages but the last,
whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.llm import bpe, language, mixing, neardup, quality, similar
from fieldgrid.llm.common import cut, fresh, table
from fieldgrid.llm.queries import GOOD, LANGUAGE_FOLD, QUALITY_FOLD, RANKS

#: Documents whose main language has a smaller share of their letters than this are rejected.
LEAST_SHARE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score below the quality threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), QUALITY_FOLD, cut_at=GOOD)
    score = fresh(docs, "score")
    return quality.with_score(docs, model, score).where(F.col(score) >= GOOD).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language, or none that prevails."""
    model = language.fit(docs, LANGUAGE_FOLD)
    found = fresh(docs, "language")
    clear = (F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= LEAST_SHARE)
    return language.with_language(docs, model, found).where(clear).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of SimHash near-duplicates that share 0.8 of their five-word shingles."""
    return neardup.keep_one_each(docs, similar.similar)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which blocks of their sources interleave to the target weights."""
    return mixing.in_mixed_order(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, whether they decode to its text, and its slot and place in the mixed order.

    The place doesn't depend on the order of files or rows, so it is the one by which the stage before has sorted.
    """
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    place = fresh(docs, "place")
    coded = bpe.with_coding(mixing.with_place(docs, place), path, pattern, place)
    return coded.select("doc_id", "source", "ids", "n_tokens", "round_trip", f"{place}.slot", f"{place}.within")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Learnt scores, components and merges aren't SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
