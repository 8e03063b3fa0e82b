"""A corpus pipeline: language ID, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; all but the last return the columns of documents, whatever these are besides doc_id, text
and lang. An empty table goes through all stages and stays empty."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrospect.llm.common import table, written
from retrospect.llm.exact_dedup import tag_copies
from retrospect.llm.langid import UNKNOWN, held_out, identify, train
from retrospect.llm.near_dedup import near_components
from retrospect.llm.packing import pack_documents


#: The least share of a text's n-grams that its language must have. Of the labelled rows of the test tables
#: none has less than 0.4.
EVIDENCE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of whose n-grams no learned language has a share of
    EVIDENCE: other scripts and languages. Null and empty texts go; rows that repeat are judged alike;
    without any label all documents go."""
    judged = identify(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= EVIDENCE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space runs as one blank, null as empty) the row with the smallest doc_id
    stays; of rows that repeat text and id one; a null id goes before any other."""
    return tag_copies(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays. Linked are
    documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found by
    SimHash fingerprints and confirmed. Texts without a word are equal to one another; rows with
    a null id stay; rows that repeat the smallest id stay, as ids tell documents apart here."""
    groups = near_components(docs, width=5)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, as in op 1; null and empty texts are an end id
    alone, repeated rows and null ids are packed each."""
    placed = pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]
#: Language identification, near-duplicates and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
