"""From raw documents to training tokens: five stages over whole tables.

Each stage takes all that the one before kept and applies its decisions; all
but the last return the columns of ``documents``.  A stage first writes its
decisions, keyed by id and text, into the shared folder, and its result applies
them to the documents it was given.

In every stage null texts count as empty, a null id is an id like any other,
rows that share an id but not a text are documents of their own, other columns
may have any name, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, simhash, toxicity
from tidemark.llm.common import Scratch, batches_of, fresh, read_table
from tidemark.llm.pieces import PieceModel, with_pieces

#: Rows that travel to Python at once: texts vary by a thousand times in length, and a task holds a batch or two.
BATCH_ROWS = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity probability reaches the threshold go; null and empty texts stay."""
    with batches_of(spark, BATCH_ROWS):
        return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; of rows that repeat id and text, one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike to 0.8 or more on five-word shingles the least id stays; word-less texts stay."""
    return simhash.keep_one_of_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the entropy-balanced mix of the sources takes it; word-less ones never."""
    return mixing.mix_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the scores of its best segmentations."""
    (found,) = fresh(docs, "pieces")
    out = with_pieces(docs.select("doc_id", "source", "text"), PieceModel.load(), found)
    with batches_of(spark, BATCH_ROWS), Scratch(spark, "pieces") as scratch:
        return scratch.write(out.select("doc_id", "source", f"{found}.ids", f"{found}.n_pieces", f"{found}.scores", f"{found}.exact"), "pieces", keep=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: SQL cannot express the toxicity model, near copies and the segmentation; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = scratch.write(docs, name)
    return docs
