"""Reading reports and documents, routing by format, and intake checks that split good rows from rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import text as tx
from riskloom.operators.quality import COLUMNS
from riskloom.schemas import LABELLED
from riskloom.sources.quoted_csv import read_quoted

# Accepted formats by MIME type and by file extension, and the largest accepted file.
MIME_FORMATS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
    "text/csv": "csv",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
EXTENSION_FORMATS = {"pdf": "pdf", "docx": "docx", "txt": "txt", "csv": "csv", "xlsx": "xlsx"}
MAX_FILE_BYTES = 10 * 1024 * 1024
UNNAMED = "unnamed_file"


def _csv(spark: SparkSession, path: str, quoted: bool) -> DataFrame:
    """A CSV with a header. Texts with line breaks need ``quoted``, which costs a pass more; both cut large files into many tasks."""
    if quoted:
        return read_quoted(spark, path)
    return spark.read.option("header", True).option("escape", '"').option("quote", '"').csv(path)


def read_labelled(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Labelled reports from CSV by column name; a required column that is missing is an error."""
    raw = _csv(spark, path, quoted)
    missing = sorted(set(COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    types = {f.name: f.dataType for f in LABELLED}
    return raw.select(*[F.col(c).cast(types[c]).alias(c) for c in COLUMNS])


def read_reports(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Bulk reports from CSV, with whatever other columns it has; rows without text are skipped."""
    return usable_reports(_csv(spark, path, quoted))


def first_reports(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows by id and then by ``order``: the row cap of the bulk scan, always the same rows."""
    return rows.orderBy("report_id", *order).limit(limit)


def made_id(text: Column) -> Column:
    """An id for a report that has none, from its text."""
    return F.concat(F.lit("REP-"), F.upper(F.substring(F.md5(text.cast("binary")), 1, 16)))


def usable_reports(rows: DataFrame) -> DataFrame:
    """Rows with text; an id is made from the text where none is given."""
    kept = rows.filter(~tx.is_blank(F.col("report_text")))
    given = tx.non_empty(F.col("report_id")) if "report_id" in rows.columns else F.lit(None)
    return kept.withColumn("report_id", F.coalesce(given, made_id(F.col("report_text"))))


def read_table(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Any CSV as records of text; null becomes empty text."""
    return _csv(spark, path, quoted).na.fill("")


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def route_formats(files: DataFrame, name: str = "name", mime: str = "mime") -> DataFrame:
    """Add ``format`` by MIME type, else by extension, and ``error`` for files of neither."""
    by_mime = tx.lookup(F.col(mime), MIME_FORMATS)
    by_name = tx.lookup(extension(F.col(name)), EXTENSION_FORMATS)
    staged = files.withColumn("format", F.coalesce(by_mime, by_name))
    error = F.concat(F.lit("Unsupported file type: "), F.col(name), F.lit(" ("), F.coalesce(F.col(mime), F.lit("")), F.lit(")"))
    return staged.withColumns(
        {"is_tabular": F.col("format").isin("csv", "xlsx"), "error": F.when(F.col("format").isNull(), error)}
    )


def clean_name(name: Column) -> Column:
    """The last part of a path, with letters, digits, blanks, dots, underscores and dashes only."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), "([^/]*)$", 1)
    kept = tx.strip(F.regexp_replace(base, r"[^\p{L}\p{N} ._-]", ""))
    return F.when(kept == "", UNNAMED).otherwise(kept)


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Plain-text files: (documents, rejects). Files of more than ``max_bytes`` or without text are rejects.

    The size test is pushed to the file listing, so the bytes of a rejected file are never read. ``name`` makes
    the name out of ``path``; by default it is the last part of it.
    """
    files = spark.read.format("binaryFile").load(path)
    named = clean_name(F.col("path") if name is None else name).alias("source_file_name")
    small = files.filter(F.col("length") <= max_bytes)
    texts = small.select(
        named,
        # Bytes that are no UTF-8 become replacement characters.
        tx.strip(F.make_valid_utf8(F.col("content").cast("string"))).alias("report_text"),
    )
    empty = texts.filter(F.col("report_text") == "").select("source_file_name", F.lit("no text").alias("error"))
    large = files.filter(F.col("length") > max_bytes).select(named, F.lit("too large").alias("error"))
    return texts.filter(F.col("report_text") != ""), large.unionByName(empty)


# Limits on what is taken in.
TEXT_LENGTH = (10, 10_000)
ID_LENGTH = 50
LOCATION_LENGTH = 100
REVIEWER_LENGTH = (2, 100)
COMMENT_LENGTH = 2_000
NOTES_LENGTH = (2, 2_000)
DECISIONS = ("confirmed", "rejected", "corrected")


def _violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def _outside(column: str, bounds: tuple[int, int]) -> Column:
    return ~F.coalesce(F.length(column).between(*bounds), F.lit(False))


def check_reports(rows: DataFrame) -> DataFrame:
    """Add ``violations`` to arriving reports; empty for good rows."""
    return rows.withColumn(
        "violations",
        _violations(
            {
                "report_text": _outside("report_text", TEXT_LENGTH),
                "report_id": F.length("report_id") > ID_LENGTH,
                "location": F.length("location") > LOCATION_LENGTH,
                "recurring_risk_signal": ~F.col("recurring_risk_signal").between(0.0, 1.0),
            }
        ),
    )


def check_reviews(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "violations",
        _violations(
            {
                "reviewer_id": _outside("reviewer_id", REVIEWER_LENGTH),
                "decision": ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)),
                "comments": F.length("comments") > COMMENT_LENGTH,
            }
        ),
    )


def check_feedback(rows: DataFrame) -> DataFrame:
    return rows.withColumn("violations", _violations({"notes": _outside("notes", NOTES_LENGTH)}))


def bulk_outcome(checked: DataFrame) -> DataFrame:
    """One row: how many rows went through, how many did not, and the verdict."""
    good = F.size("violations") == 0
    return checked.agg(F.count_if(good).alias("processed_count"), F.count_if(~good).alias("error_count")).withColumn(
        "status",
        F.when((F.col("error_count") > 0) & (F.col("processed_count") > 0), "partial")
        .when(F.col("processed_count") > 0, "success").otherwise("error"),
    )


def resolve_location(given: Column, extracted: Column) -> Column:
    """Given location, else the extracted one, else Unknown."""
    return F.coalesce(tx.non_empty(given), tx.non_empty(extracted), F.lit("Unknown"))
