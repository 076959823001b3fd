"""Corpus preparation: from documents to token files, by five operators of quarryline.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder
and reads it again for the next one. All but the last return the columns of documents, whatever further columns those have.

Null or empty texts and texts without letters go in the first stage, as do those in no learned language; where there is nothing to learn from, all go. Very long texts pass
every stage whole. Rows without doc_id, and rows that repeat one, are documents like others: copies go in the second stage, ties there are broken by the order
of reading. An empty table passes all stages as an empty one. The benchmark is refused with an error if it exceeds the automaton's bound (see quarryline.llm.decontaminate).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import common, decontaminate, language, mixing, nearcopies, tokenfile
from quarryline.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables of the last stage that ran, by session.
_left: dict[str, list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """The stage, which first deletes the tables that the one before it has used: its result was written since."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        made = common.stage_tables(spark, docs, _left.pop(app, []))
        common.recorded.append(made)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _left[app] = common.recorded.pop()

    return run_stage


@tidy
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identification accepts."""
    return language.accepted(docs, language.fit(docs))


@tidy
def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the document with the smallest doc_id."""
    return nearcopies.first_of_each(docs)


@tidy
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share too little with the benchmark to count as contaminated."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words, rounded: 0 to 3 rows each."""
    return mixing.repeated(docs)


@tidy
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and where each document lies in them: doc_id, start, n_tokens, ids_crc32."""
    return tokenfile.token_digests(docs)


STAGES = [
    ("language identification", known_language),
    ("SimHash near-deduplication", near_distinct),
    ("benchmark decontamination", uncontaminated),
    ("mixing to target weights", mixed),
    ("token-id output", token_files),
]

#: Trained models, XXH64 with a seed and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
