"""The corpus pipeline: documents without toxic ones, shared lines and near copies, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticktrail.llm.common import kept, scratch, table, written
from ticktrail.llm.line_dedup import dedup_lines
from ticktrail.llm.mixing import mix_documents
from ticktrail.llm.ngram_join import keep_one
from ticktrail.llm.packing import pack_documents
from ticktrail.llm.toxicity import reject_toxic


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes shared lines out of the texts; every document stays."""
    return dedup_lines(docs)


#: Each stage works on what its predecessor kept; all but the last return the columns of documents.
STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_join", keep_one),
    ("mixing", mix_documents),
    ("packing", pack_documents),
]
#: The first stage learns its weights, and tokens come from a vocabulary: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes on its way goes when its result stands
            docs = kept(written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
