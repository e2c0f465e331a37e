"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage returns as Parquet in the
shared checkpoint folder and gives the next stage what it reads back, so a stage starts from files and not from a
history.  All stages but the last keep the columns of `documents`.

1. quality: documents that the line classifier rejects go (trained on `labels` of documents that are not held out).
2. line_dedup: lines that are near-duplicates of earlier lines go from the text.
3. near_dedup: of each class of near copies (found by SimHash, Jaccard of 5-word shingles 0.8 or more) the document with the
   smallest doc_id stays.
4. suffix_dedup: byte strings of 100 that occur earlier go from the text.
5. packing: what is left is packed into sequences.

Columns of `documents` other than doc_id, text and n_chars are passed on whatever their names; an empty table goes
through all stages.  Each stage's docstring says what it does with nulls, repeated rows and ties.
"""

from __future__ import annotations

import uuid

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession

from flatewise.llm import lines, packing, quality, simhash, suffix
from flatewise.llm.common import table, with_checkpoint_dir

ORACLE_SQL = None  # model fitting and the byte-pair vocabulary are beyond SQL; a test compares every stage with brute force


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, as they are; null and empty texts are scored like one empty line."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that an earlier line resembles (n_chars follows); rows equal in id and text count once as
    earlier and lose the same lines; a null text stays null."""
    return lines.remove_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the least by doc_id (nulls last), then by the MD5 of its text; null and blank
    texts are one class."""
    return simhash.keep_first(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without byte strings of 100 that start earlier (n_chars follows); texts below 100 bytes stay as they are."""
    return suffix.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; a null text is one closing token."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
