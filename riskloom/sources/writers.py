"""Writing results: registers, enriched tables, splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def extraction_columns(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """Input columns plus seven text columns; null becomes empty."""
    return extracted.select(
        *keep,
        _text("activity").alias("extracted_activity"), _text("hazard").alias("extracted_hazard"),
        _text("barrier").alias("extracted_barrier"), _text("barrier_status").alias("extracted_barrier_status"),
        _text("extracted_location").alias("location_found"), _text("equipment").alias("extracted_equipment"),
        "extraction_summary",
    ).withColumnRenamed("location_found", "extracted_location")


def decision_columns(decided: DataFrame, keep: list[str]) -> DataFrame:
    """Input columns plus nine; scores as text with four decimals."""
    return decided.select(
        *keep,
        "priority",
        F.format_string("%.4f", "priority_score").alias("priority_score"),
        F.format_string("%.4f", "sif_probability").alias("sif_probability"),
        _text("activity").alias("decision_activity"), _text("hazard").alias("decision_hazard"),
        _text("barrier").alias("decision_barrier"), _text("barrier_status").alias("decision_barrier_status"),
        F.size("matched_rules").cast("string").alias("rules_fired_count"),
        F.col("explanation").alias("decision_explanation"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, one file per task."""
    (
        rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
        # Texts are written as they are, blanks at their ends included.
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_splits(split_rows: DataFrame, path: str) -> None:
    """One folder per part."""
    split_rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_by_day(rows: DataFrame, path: str, at: str = "created_at") -> None:
    """Parquet in day folders; only the days at hand are replaced."""
    (
        rows.withColumn("day", F.to_date(at)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    )


def write_report(row: DataFrame, path: str) -> None:
    """A small result as JSON."""
    row.write.mode("overwrite").json(path)
