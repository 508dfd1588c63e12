"""From raw documents to a sharded training corpus: five stages, each written as Parquet and read again by the next.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``, whatever their
names. In every stage a NULL or empty text is a text without words, repeated rows are rows of their own unless the stage says
otherwise, and an empty table gives an empty result. Ties are broken by id and then by text, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathlight.llm.common import staged, table
from pathlight.llm.decontamination import decontaminate
from pathlight.llm.language_id import keep_identified
from pathlight.llm.mixing import emit, mix_plan
from pathlight.llm.sharding import assign_shards
from pathlight.llm.simhash import keep_one


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; a NULL text and one without a letter have none."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints - of four-word shingles - are linked by differing in at most four bits
    the one with the smallest id goes on. A NULL id is the last to be chosen."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no noteworthy part of a benchmark item go on, those without words among them."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document goes on as often as the weight of its source asks for: never, once or several times. NULL is a source, too."""
    return emit(docs, mix_plan(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard by its id, and a slot in it; a NULL id is an id like any other. Its columns are kept, but for those
    that have the name of a result."""
    return assign_shards(docs, carry=[name for name in docs.columns if name != "doc_id"])


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

# The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
