"""From documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.lineage import stored
from riskloom.llm.exact import exact_copies
from riskloom.llm.language import identify
from riskloom.llm.mixing import mix_sources, repeated
from riskloom.llm.queries import LANGUAGES, as_reports, packed
from riskloom.llm.resemblance import resembling, text_digest
from riskloom.llm.simhash import near_copies

#: Keys up to which a list of dropped documents (an id and 32 bytes each) is sent to every executor.
FEW = 200_000


def _key() -> Column:
    """What tells rows apart: id and text. Rows without an id come last in order."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), text_digest(F.col("text")).alias("digest"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents as reports with the key of their row for an id."""
    return docs.select(
        _key().alias("report_id"), F.col("text").alias("report_text"), "source", "lang", F.lit(None).cast("string").alias("source_file_path"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents without those whose id and text are a key in ``dropped``. Other texts of one id stay, and so do other rows without id."""
    dropped = stored(dropped.select(F.col("key.doc_id").alias("dropped_id"), F.col("key.digest").alias("digest")).distinct())
    names, small = docs.columns, dropped.count() <= FEW
    same = (text_digest(F.col("text")) == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("dropped_id"))
    return docs.join(F.broadcast(dropped) if small else dropped, same, "left_anti").select(*names)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages. Repeated rows are judged alike; texts without letters go."""
    found = identify(_keyed(docs), as_reports(docs), LANGUAGES)
    return _without(docs, found.filter("not accepted").select(F.col("report_id").alias("key")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, one with an id where there is one. Of rows repeated with one id and text one stays."""
    found = stored(exact_copies(_keyed(docs)).select(F.col("report_id").alias("key"), F.col("keep_id").alias("keep"), "kept"))
    copies = found.filter("not kept")
    again = stored(copies.filter("key = keep").select("key").distinct())
    left = _without(docs, copies.select("key"))
    if again.isEmpty():
        return left
    # The document that stays has the id and the text of a copy: one of its rows is taken back.
    order = F.struct(F.coalesce(F.length("text"), F.lit(0)), *[c for c in docs.columns if c != "doc_id"])
    repeated_rows = docs.withColumn("key", _key()).join(again, "key")
    back = repeated_rows.groupBy("key").agg(F.max_by(F.struct(*docs.columns), order).alias("row"))
    return left.unionByName(back.select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: fingerprints at most 3 bits apart, as in ``op4_simhash``.

    Of what the fingerprints leave, also one of each group with 0.8 of the five-word shingles of their texts in common.
    """
    for copies in (near_copies, resembling):
        found = copies(_keyed(docs))
        docs = stored(_without(docs, found.filter("report_id <> component_id").select(F.col("report_id").alias("key"))))
    return docs


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to two equal rows each."""
    names = docs.columns
    reports = docs.withColumns({"report_id": F.col("doc_id"), "report_text": F.col("text")})
    return repeated(mix_sources(reports)).select(*names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packed(as_reports(docs))


STAGES = [("language", languages), ("exact", exact), ("near", near), ("mixing", mixture), ("packing", packing)]
#: Fitted models, tokenisation and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
