"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, tokenising.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seasight.llm.bpe import encode
from seasight.llm.common import cut, table
from seasight.llm.exact_dedup import drop_copies
from seasight.llm.langid import drop_rejected
from seasight.llm.mixing import mixed_rows
from seasight.llm.simhash import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without a letter, and those unlike every language that it learned.

    Rows without an id stay; rows that repeat one stay or go together; an empty table stays empty.
    """
    return drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; a null text is an empty one.

    Rows without an id stay; rows that repeat one stay or go together; an empty table stays empty.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, at 0.8 on five-word shingles, the one with the smallest doc_id stays.

    Rows without an id and texts without words stay; rows that repeat an id stay or go together; an empty table stays empty.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a source's sum within half a document of its target; the rest go.

    Repeated rows each count, ids and sources may be null, rows without words go, and an empty table stays empty.
    """
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text: a row per row; a null text is an empty one."""
    return encode(docs, digests=True)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("bpe", tokens)]

#: Character models and minhash sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
