"""Data quality of labelled reports: missing values, domains, lengths, duplicates, distributions, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from riskloom.functions import text as tx

# Columns of a labelled report, accepted values, shortest text, prefix of a near copy.
COLUMNS = (
    "report_id", "report_text", "sif_precursor", "activity", "hazard", "barrier", "location", "severity", "source",
)
DOMAINS = {
    "sif_precursor": ("0", "1"),
    "severity": ("low", "medium", "high", "critical"),
    "source": ("public", "synthetic", "anonymized"),
}
MIN_TEXT = 20
PREFIX = 80
MAX_IMBALANCE = 4.0
SHOWN_IDS = 10


def column_difference(present: Sequence[str], required: Sequence[str] = COLUMNS) -> dict[str, list[str]]:
    """Columns that are missing (an error) and columns that are extra (a warning)."""
    return {"missing": sorted(set(required) - set(present)), "extra": sorted(set(present) - set(required))}


def column_report(rows: DataFrame, required: Sequence[str] = COLUMNS) -> DataFrame:
    """(side, name, filled): missing columns, and extra ones with the number of rows in which they have a value. One pass over the extra columns."""
    found = column_difference(rows.columns, required)
    missing = [F.struct(F.lit("missing").alias("side"), F.lit(n).alias("name"), F.lit(0).cast("long").alias("filled")) for n in found["missing"]]
    extra = [F.struct(F.lit("extra").alias("side"), F.lit(n).alias("name"), F.col(f"n{k}").alias("filled")) for k, n in enumerate(found["extra"])]
    counted = rows.agg(F.count("*").alias("rows"), *[F.count(F.col(n)).alias(f"n{k}") for k, n in enumerate(found["extra"])])
    empty = F.array().cast("array<struct<side:string,name:string,filled:bigint>>")
    return counted.select(F.explode(F.array(*missing, *extra) if missing or extra else empty).alias("r")).select("r.*")


def missing_values(rows: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Null count per column; blank text counts as missing too. One pass for all columns."""
    counts = rows.agg(
        *[
            F.count_if(tx.is_blank(F.col(c)) if c == text else F.col(c).isNull()).alias(c)
            for c in columns
        ]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def domain_violations(rows: DataFrame, domains: Mapping[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """Per checked column: how many rows hold a value outside its domain (any case; null is outside)."""
    checks = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in domains
        ]
    )
    allowed = F.lit(False)
    for c, accepted in domains.items():
        allowed = allowed | ((F.col("column_name") == c) & F.lower("value").isin(*accepted))
    return (
        rows.select(F.explode(checks).alias("c")).select("c.*")
        .filter(~F.coalesce(allowed, F.lit(False)))
        .groupBy("column_name", "value").agg(F.count("*").alias("rows"))
    )


def short_texts(rows: DataFrame, text: str, key: str, minimum: int = MIN_TEXT) -> DataFrame:
    """Rows whose text is shorter than the minimum."""
    return rows.filter(F.length(F.coalesce(text, F.lit(""))) < minimum).select(key, F.length(F.coalesce(text, F.lit(""))).alias("n_chars"))


def first_ids(found: DataFrame, key: str, shown: int = SHOWN_IDS) -> DataFrame:
    """How many rows were found, and the first few ids. Only ``shown`` ids are ever gathered."""
    total = found.agg(F.count("*").alias("rows"))
    ids = found.orderBy(key).limit(shown).agg(F.sort_array(F.collect_list(key)).alias("ids"))
    return total.select(F.lit(1).alias("one"), "rows").join(ids.select(F.lit(1).alias("one"), "ids"), "one").drop("one")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def _text_keys(rows: DataFrame, text: str, key: str, prefix: int = PREFIX) -> DataFrame:
    norm = tx.normal_form(F.coalesce(text, F.lit("")))
    # 128-bit digests travel instead of the texts.
    return rows.select(
        key, F.md5(norm.cast("binary")).alias("__whole"), F.md5(F.substring(norm, 1, prefix).cast("binary")).alias("__head")
    )


def _repeated(keys: DataFrame, digest: str) -> DataFrame:
    """Digests that occur more than once; counted before the shuffle, so hot ones cost a row per task."""
    return keys.groupBy(digest).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).select(digest)


def exact_duplicates(rows: DataFrame, text: str, key: str) -> DataFrame:
    """All rows that share their normalised text with another row."""
    keys = _text_keys(rows, text, key)
    return keys.join(_repeated(keys, "__whole"), "__whole", "left_semi").select(key)


def near_duplicates(rows: DataFrame, text: str, key: str, prefix: int = PREFIX) -> DataFrame:
    """Rows that share their first ``prefix`` normalised characters with another row but are no exact duplicate.

    Texts that differ anywhere but mean the same are grouped by ``patterns.text_clusters`` with a high threshold.
    """
    keys = _text_keys(rows, text, key, prefix)
    return (
        keys.join(_repeated(keys, "__head"), "__head", "left_semi")
        .join(_repeated(keys, "__whole"), "__whole", "left_anti")
        .select(key)
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Rows and share per value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Win.partitionBy())
    return counts.withColumn("percentage", F.round(F.col("rows") * 100.0 / total, 1))


def class_warnings(rows: DataFrame, label: str) -> DataFrame:
    """Per dataset: number of classes, ratio of the larger to the smaller, and the warning they deserve."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    ratio = F.round(F.max("rows") / F.min("rows"), 1)
    return counts.agg(
        F.count("*").alias("classes"), ratio.alias("imbalance"),
        F.when(F.count("*") == 1, "one class")
        .when((F.count("*") == 2) & (F.max("rows") / F.min("rows") > MAX_IMBALANCE), "imbalanced")
        .otherwise("").alias("warning"),
    )


def verdicts(files: Mapping[str, DataFrame | None], text: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Errors and warnings per file, and whether each passes. A file that does not exist is passed as None.

    All files go through one plan: their rows are tagged and checked together.
    """
    present = [df.select(F.lit(name).alias("file"), *columns) for name, df in files.items() if df is not None]
    rows = present[0]
    for df in present[1:]:
        rows = rows.unionByName(df)
    norm = tx.normal_form(F.coalesce(text, F.lit("")))
    keyed = rows.withColumns(
        {"__whole": F.md5(norm.cast("binary")), "__head": F.md5(F.substring(norm, 1, PREFIX).cast("binary"))}
    )

    def repeats(digest: str, name: str) -> DataFrame:
        return (
            keyed.groupBy("file", digest).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
            .groupBy("file").agg(F.sum("n").alias(name))
        )

    missing = F.lit(0)
    for c in columns:
        missing = missing + (tx.is_blank(F.col(c)) if c == text else F.col(c).isNull()).cast("int")
    totals = keyed.groupBy("file").agg(
        F.count("*").alias("rows"),
        F.sum(missing).alias("missing"),
        F.count_if(F.length(F.coalesce(text, F.lit(""))) < MIN_TEXT).alias("short"),
    )
    out = (
        totals.join(repeats(key, "duplicate_ids"), "file", "left")
        .join(repeats("__whole", "exact_duplicates"), "file", "left")
        .fillna(0)
        .withColumn(
            "passed",
            (F.col("missing") == 0) & (F.col("short") == 0) & (F.col("duplicate_ids") == 0)
            & (F.col("exact_duplicates") == 0),
        )
    )
    absent = [name for name, df in files.items() if df is None]
    for name in absent:
        out = out.unionByName(
            totals.limit(1).select(F.lit(name).alias("file"), F.lit(False).alias("passed")), allowMissingColumns=True
        )
    return out


def overall(verdict_rows: DataFrame) -> DataFrame:
    """Passes only if every file does."""
    return verdict_rows.agg(F.count("*").alias("files"), F.bool_and("passed").alias("passed"))
