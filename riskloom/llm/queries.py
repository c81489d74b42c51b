"""One query for each operator over its whole table: given tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.lineage import scratch
from riskloom.llm.bpe import decode_reports, encode_reports
from riskloom.llm.exact import exact_copies
from riskloom.llm.language import identify
from riskloom.llm.lattice import near_vectors
from riskloom.llm.licences import scan_licences
from riskloom.llm.manifest import merkle_manifest
from riskloom.llm.mixing import mix_sources
from riskloom.llm.packing import pack_reports
from riskloom.llm.phrases import mine_phrases
from riskloom.llm.shards import shard_reports
from riskloom.llm.simhash import near_copies
from riskloom.llm.statements import STATEMENTS
from riskloom.llm.surrogates import replace_personal
from riskloom.llm.warc import read_archives, write_archives

LANGUAGES = ("de", "en", "es", "fr")
#: The key of a run's surrogates; whoever has it can tell which value gave which, so real runs bring their own.
KEY = "riskloom"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_reports(documents: DataFrame) -> DataFrame:
    """Documents as collected reports: the text, where it comes from, and its label where there is one."""
    return documents.select(
        F.col("doc_id").alias("report_id"), F.col("text").alias("report_text"), "source", "lang",
        F.lit(None).cast("string").alias("source_file_path"),
    )


def reports_of(spark: SparkSession, folder: str) -> DataFrame:
    return as_reports(table(spark, folder, "documents"))


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as reports collected from an address."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("report_id"), F.col("html").alias("report_text"), F.lit(None).cast("string").alias("source"),
        F.col("url").alias("source_file_path"),
    )


def hexed(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(reports_of(spark, folder))


def packed(reports: DataFrame) -> DataFrame:
    """Pieces with a checksum in the place of their tokens."""
    return pack_reports(reports, TOKENIZER).select(
        F.col("report_id").alias("doc_id"), "piece", "start", "length", F.crc32("token_bytes").alias("ids_crc32"),
        "sequence_id", "offset",
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_copies(reports_of(spark, folder))
    return found.select(F.col("report_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licences(reports_of(spark, folder))
    base = F.filter("detections", lambda d: d["base"])
    words = F.transform(base, lambda d: d["word"])

    def names(detections: Column | str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")

    return found.select(
        F.col("report_id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"), F.array_max(words).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names("detections").alias("labels"), "score",
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies(reports_of(spark, folder))
    return found.select(F.col("report_id").alias("doc_id"), hexed("fingerprint").alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_reports(reports_of(spark, folder))
    return placed.select(
        F.col("report_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_vectors(table(spark, folder, "embeddings").withColumnRenamed("vec_id", "report_id"))
    return found.select(
        F.col("report_id").alias("vec_id"), "n_links", "component_id", F.col("report_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by markup, address and text; documents by text and source. One of the two ids is null."""
    documents, pages = reports_of(spark, folder), pages_of(spark, folder)
    outcome = ["lang", "confidence", "text_lang", "declared", "host", "accepted"]
    none = F.lit(None).cast("long")
    of_documents = identify(documents, documents, LANGUAGES).select(F.col("report_id").alias("doc_id"), none.alias("page_id"), *outcome)
    of_pages = identify(pages, documents, LANGUAGES).select(none.alias("doc_id"), F.col("report_id").alias("page_id"), *outcome)
    return of_documents.unionByName(of_pages)


def op8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    replaced = replace_personal(reports_of(spark, folder), KEY)
    return replaced.select(
        F.col("report_id").alias("doc_id"), F.col("report_text").alias("text"), F.size("kinds").cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(reports_of(spark, folder))
    return mixed.select(
        F.col("report_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to archives in the shared folder and read back from there."""
    archives = scratch(spark)
    write_archives(pages_of(spark, folder), archives)
    return read_archives(spark, archives).select(
        F.col("report_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as reports of a type for each language. Some are found with their capitals gone."""
    reports = table(spark, folder, "documents").select(
        F.col("doc_id").alias("report_id"), "source", F.col("lang").alias("report_type"), "n_chars", F.col("text").alias("report_text"))
    small = F.translate("report_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("report_id").cast("string").cast("binary")) % 3 == 0
    found = {"report_text": F.when(touched, small).otherwise(F.col("report_text"))}
    made = merkle_manifest(reports, ("report_id", "source", "report_type", "n_chars", "report_text"), found=found)
    return made.select(
        F.col("report_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", "verified")


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Texts to tokens and back; the tokens travel on beside the texts that come of them."""
    encoded = encode_reports(reports_of(spark, folder), RANKS)
    kept = encoded.select(F.struct("report_id", "n_tokens", F.sha2("token_bytes", 256).alias("ids_sha256")).alias("report_id"), "token_bytes")
    return decode_reports(kept, RANKS).select(
        F.col("report_id.report_id").alias("doc_id"), "report_id.n_tokens", "report_id.ids_sha256", F.sha2("text_bytes", 256).alias("decoded_sha256"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of each language, which is the type of report here."""
    reports = table(spark, folder, "documents").select(
        F.col("doc_id").alias("report_id"), F.col("lang").alias("report_type"), F.col("text").alias("report_text"))
    return mine_phrases(reports).withColumnRenamed("report_type", "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing, op2_exact_dedup, op3_licences, op4_simhash, op5_sharding, op6_embedding_dedup, op7_language, op8_surrogates,
        op9_mixing, op10_warc, op11_manifest, op12_bpe, op13_phrases,
    )
}
__all__ = ["QUERIES", "STATEMENTS"]
