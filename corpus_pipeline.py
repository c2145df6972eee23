"""The corpus pipeline: stages over ``documents``, each written as Parquet and
read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsense.llm.curriculum import curriculum_mix, in_training_order
from fieldsense.llm.linededup import drop_recurring
from fieldsense.llm.pieces import encode_documents
from fieldsense.llm.quality import keep_clean
from fieldsense.llm.simhash import keep_one
from fieldsense.session import checkpoint_dir

#: Columns that the mix adds: where in training a copy comes (0 to 1), and which copy of its document it is.
POSITION, COPY = "mix_position", "mix_copy"


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: failing lines go, and documents that lose too much."""
    return _like(docs, keep_clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has go; no document goes."""
    return _like(docs, drop_recurring(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's copies of the documents in training order: a document is there
    as often as the mix takes it. Files keep no order, so each copy carries its
    position in training and its number."""
    return in_training_order(curriculum_mix(docs), POSITION, COPY)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every copy, with its position in training and its number,
    by which copies of one document are segmented differently."""
    placed = [c for c in (POSITION, COPY) if c in docs.columns]
    return encode_documents(docs, copy_col=COPY if COPY in docs.columns else None, carry=tuple(placed))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: Line rules, templates and pieces are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is written to
    the shared folder that the session names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}")
            out = spark.read.parquet(f"{folder}/{k}")
        docs = out
    return docs
