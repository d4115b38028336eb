"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last give rows of
``docs`` with all their columns, whatever these are named, as they are. Rows may
repeat, ids and texts may be null, texts may be empty or very long (a text is
one row of one task); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import exactdup, neardup, packing, quality, toxicity
from ledgerline.llm.common import read_table, stash
from ledgerline.llm.queries import TOKENIZER, held_out_fold


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the weighed rules find good. Null and empty texts, like all of
    fewer than 50 words, go; rows that repeat are judged alike."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores below 0.3; labels of the held-out fold are not learnt. Null
    and empty texts have the score of the intercept; labels without a row of
    ``docs``, null ones and those of one kind only teach nothing."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out_fold())
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of equal texts; a null id comes after all
    others, a null text equals an empty one, rows that repeat a kept id and its
    text all stay."""
    return exactdup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class (five words, 0.8): the smallest
    id. Texts without words and rows without an id are near nothing and stay."""
    return neardup.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token pieces of what is left into sequences of 2048; a null or empty
    text is one piece, its end id. Gives a row for each piece."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Voting, learning and tokenizing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
