"""The corpus pipeline: quality rules, near-dedup, mixing, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import mixing, neardup, packing, quality
from siteloom.llm.common import MADE, new_path, sweep, until_exit
from siteloom.llm.queries import PACKED_WITH, tokenizer


def _stage(fn):
    """A stage begins when the one before it is written, so what that one stored can go, unless it is still read."""

    @wraps(fn)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, MADE.stored, docs)
        before = len(MADE.paths)
        out = fn(spark, docs, sf_dir)
        MADE.stored.extend(MADE.paths[before:])
        return out

    return staged


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learnt limits reject go.

    Null and empty texts fail the base rules; null languages and sources are groups of their
    own; repeated rows are judged alike; very long texts are measured whole; an empty table
    stays empty; all columns stay, whatever their names.
    """
    return quality.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays.

    Null and empty texts are copies of each other; rows without an id stay, and rows that
    repeat a kept id and text with it; an id's other text is judged for itself; very long texts count whole; an empty table stays empty; all
    columns stay.
    """
    return neardup.keep_one(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Null texts have no words; a null source is a source; ties are broken by id, and repeated
    rows are documents of their own; an empty table stays empty; all columns stay.
    """
    return mixing.mixed_corpus(docs)


def _place(docs: DataFrame) -> Column:
    """Where a row stands in a stored table: file and row, which sort in the order of writing."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at)
    except AnalysisException:  # not read from files: the order of its tasks
        return F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
    return F.concat(F.regexp_extract(at["file_name"], r"^part-(\d+)", 1), F.lit("-"), F.lpad(at["row_index"].cast("string"), 12, "0"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    ``place`` sorts in training order and tells copies of a document apart; of a length,
    documents fill the planned slots in this order. Null texts are their end id alone;
    longer texts than a sequence are cut, whole; an empty table gives an empty one.
    """
    packed = packing.pack_documents(docs, tokenizer(PACKED_WITH), place=_place(docs))
    return packed.select(F.col("id").alias("doc_id"), "place", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("source_mixing", mix_sources), ("best_fit_packing", pack_sequences)]
#: SQL has neither the near-dedup nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        until_exit(spark, path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
