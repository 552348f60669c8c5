"""From raw documents to packed training sequences, in stages that each read what the one before
kept. The result of a stage is written to Parquet and read again before the next one begins; the
tables a stage made for itself are of no use from then on, so the next stage removes them.

Defined cases: a null or empty text fails the quality rules, as does any with fewer than 50 words; rows
that share an id are judged each by its own text, and of rows with equal id and words one stays; rows
without an id pass line dedup and near-dup as they are; a source may be null; of texts any length, each is
one row of every stage; further columns, whatever their names, are carried to the last stage, and
``n_chars`` follows the text where it is one of them; no documents, or none that pass, give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeline.llm import line_dedup, mixing, near_dup, packing, quality
from nudgeline.llm.common import documents, landed, remove, workspace

# Id that packing puts behind every document.
END_ID = 0

# Folder of the last stage's own tables, by session.
_scratch: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    """A folder for this stage; the one of the stage before goes."""
    key = spark.sparkContext.applicationId
    if key in _scratch:
        remove(spark, _scratch.pop(key))
    _scratch[key] = workspace(spark, name)
    return _scratch[key]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    _folder(spark, "quality")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share go, but for one document."""
    kept = line_dedup.dedup_lines(docs, _folder(spark, "lines"))
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", n_chars)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.deduplicate(docs, folder=_folder(spark, "near"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.copied(docs, folder=_folder(spark, "mix"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: which piece of which document lies where."""
    return packing.pack_documents(docs, END_ID, folder=_folder(spark, "pack"))


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_dup", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# The quality model, the mix and the packing are iterative, so there is no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    folder = workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
