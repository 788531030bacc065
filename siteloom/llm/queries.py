"""One query for each operator over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import chat, fingerprints, lexical, mixing, neardup, negatives, packing, quality, tokencount, tokenfile, urlfilter, warc, wrappers
from siteloom.llm.common import materialize

#: Files of the public tokenizers; all are parameters of the operators.
PACKED_WITH, WRITTEN_WITH, COUNTED_WITH = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.json"
#: Every document whose id is divisible by this asks the block tables for its neighbours.
ASKED = 20


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``: for every asked document, how many others lie within three bits, by the block tables."""
    found = materialize(fingerprints.edited_digests(_table(spark, sf_dir, "documents")), "fingerprints")
    near = fingerprints.near_counts(found.select("id", "fingerprint"), F.col("id") % ASKED == 0)
    asked = F.coalesce(F.col("id") % ASKED == 0, F.lit(False))
    joined = found.where(asked).join(near, "fingerprint").unionByName(found.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return joined.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer(PACKED_WITH), keep_ids=False)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("mark")).alias("fingerprint"), F.col("class_id").alias("component_id"))


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_token_files(_table(spark, sf_dir, "documents"), tokenizer(WRITTEN_WITH))
    return tokenfile.read_token_files(spark, manifest, keep_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.main_text(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


_CONTROL = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.gather(_table(spark, sf_dir, "conversations"))
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(_CONTROL).alias("instruction"), F.lit(_CONTROL).alias("output"))
    records = rows.unionByName(planted, allowMissingColumns=True)
    out = chat.format_turns(chat.canonical_turns(records))
    read = out.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order by ``position``, that of the first occurrence; documents that are not taken come last, by hash."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(mixing.sized(docs))
    ordered = mixed.withColumn("first", F.coalesce(F.get("positions", F.lit(0)), 2 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20))).repartitionByRange("first").sortWithinPartitions("first")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("position"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed keys are those of URLs with a tracking parameter, whatever else the key occurs with."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("url").rlike(r"^[^?#]*\?([^#]*&)?utm_source=")).select(F.concat(urlfilter.url_host(), urlfilter.url_path()).alias("key"))
    return urlfilter.judge_urls(pages, listed, "page_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), negatives.whole_components("embedding").alias("vector"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_whole``: how many of a document's tokens were pre-tokens proven to be one token."""
    found = tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer(COUNTED_WITH))
    return found.withColumnRenamed("id", "doc_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_table(spark, sf_dir, "documents"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_best_fit_packing,
        op3_simhash_near_dedup,
        op4_warc_archives,
        op5_token_files,
        op6_html_main_text,
        op7_chat_formatting,
        op8_source_mixing,
        op9_quality_rules,
        op10_url_filters,
        op11_hard_negatives,
        op12_token_counts,
        op13_lexical_search,
    )
}
