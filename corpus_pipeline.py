"""The corpus pipeline: filter, deduplicate, mix and pack documents, stage by stage.

Every stage works on all that the one before kept, and is written and read again in between.

Null and empty texts have no words to judge them by, so they are not toxic, have no lines to cut and are
near duplicates of nothing; the mix takes them or not by their hash like any other, and packing
gives them an end id alone. Rows that repeat are documents of their own until near copies go; of
those the least doc_id stays, null first, and of one doc_id the least text hash. Extra columns are left
out, and an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, scratch, table
from marginalia.llm.jaccard_join import one_of_each
from marginalia.llm.line_dedup import dedup_lines
from marginalia.llm.mixing import mix_sources, repeated
from marginalia.llm.packing import pack_documents
from marginalia.llm.queries import word_tokenizer
from marginalia.llm.toxicity import fit_toxicity, score_toxicity, to_learn_from

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CAPACITY = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic."""
    scorer = fit_toxicity(docs, to_learn_from(table(spark, sf_dir, "labels")))
    return score_toxicity(docs.select(*COLUMNS), scorer).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier three-line windows.

    A document that has lost all its words to earlier ones is a repeat as a whole and goes; one
    that had none before stays.
    """
    kept = dedup_lines(docs.select(*COLUMNS))
    return kept.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id; all without words."""
    return one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, up to twice; those beyond their source's threshold stay out."""
    return repeated(mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document of the mix, with its place in a sequence."""
    return pack_documents(docs, word_tokenizer(), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenizing and fitting can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    tables = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
