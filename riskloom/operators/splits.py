"""Deduplication and stratified splitting of labelled texts, with manifest and leak check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from riskloom.functions import text as tx

# Fewer rows than this in a class: the split ignores classes.
MIN_CLASS = 3


def keep_first(rows: DataFrame, text: str, position: str) -> DataFrame:
    """The first row of every normalised text.

    An aggregate by digest, so copies are reduced in the task that reads them.
    """
    rest = rows.columns
    digest = F.md5(tx.normal_form(F.coalesce(text, F.lit(""))).cast("binary"))
    return (
        rows.groupBy(digest.alias("__digest"))
        .agg(F.min_by(F.struct(*rest), position).alias("row"))
        .select("row.*")
    )


def _ranks(rows: DataFrame, label: str, key: str, seed: int, buckets: int) -> DataFrame:
    """Rank of each row in its class by a seeded digest.

    Digests are spread evenly over ``buckets`` ranges. A row's rank is its rank inside its range plus
    the rows in the ranges before, so even a class with most of the rows is never ranked in one task.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    staged = rows.withColumns({"__digest": digest})
    # The first five hex digits, a number below 2^20, place a digest in its range.
    staged = staged.withColumn(
        "__range", F.floor(F.conv(F.substring("__digest", 1, 5), 16, 10).cast("bigint") * buckets / 1048576)
    )
    sizes = staged.groupBy(label, "__range").agg(F.count("*").alias("__in_range"))
    # At most `buckets` rows per class.
    before = Win.partitionBy(label).orderBy("__range").rowsBetween(Win.unboundedPreceding, -1)
    offsets = sizes.select(
        label, "__range",
        F.coalesce(F.sum("__in_range").over(before), F.lit(0)).alias("__before"),
    )
    inside = Win.partitionBy(label, "__range").orderBy("__digest", key)
    return (
        staged.withColumn("__inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), [label, "__range"])
        .withColumn("__rank", F.col("__inside") + F.col("__before"))
        .drop("__range", "__inside", "__before", "__digest")
    )


def _apportion(rows: DataFrame, size: str, drawn: str, part: float) -> DataFrame:
    """Add how many of a class's rows a draw takes: the draw is the share of all rows, rounded up, and is
    spread over the classes by size, what rounding leaves going to the largest remainders.
    """
    every = Win.partitionBy()
    staged = rows.withColumn("__draw", F.ceil(F.lit(part) * F.sum(size).over(every)))
    staged = staged.withColumn("__exact", F.col(size) * F.col("__draw") / F.sum(size).over(every))
    staged = staged.withColumn("__floor", F.floor("__exact"))
    by_remainder = Win.partitionBy().orderBy(F.desc(F.col("__exact") - F.col("__floor")), "__class")
    left = F.col("__draw") - F.sum("__floor").over(every)
    return staged.withColumn(
        drawn, F.col("__floor") + (F.row_number().over(by_remainder) <= left).cast("int")
    ).drop("__draw", "__exact", "__floor")


def stratified_split(
    rows: DataFrame, label: str, key: str, train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42,
    buckets: int = 64, min_class: int = MIN_CLASS,
) -> DataFrame:
    """Add ``split``: per class, the first rows by seeded digest are test, the next validation, the rest train.

    The same rows get the same parts on every run and cluster. A class with fewer than ``min_class``
    rows makes the split ignore classes (0: never); the classes of the manifest show it.
    """
    if abs(train + val + test - 1.0) > 1e-6 or min(train, val, test) <= 0:
        raise ValueError("the three shares must be positive and sum to 1")
    counts = rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("n"))
    # From here to the cuts there is one row per class.
    mixed = F.min("n").over(Win.partitionBy()) < min_class
    named = counts.withColumn("__class", F.when(mixed, "all").otherwise(F.col("__label").cast("string")))
    cuts = named.groupBy("__class").agg(F.sum("n").alias("__rows"))
    cuts = _apportion(cuts, "__rows", "__n_test", test).withColumn("__rest", F.col("__rows") - F.col("__n_test"))
    # The validation share is taken of what the test cut leaves.
    cuts = _apportion(cuts, "__rest", "__n_val", val / (train + val))
    classes = named.join(cuts, "__class").select("__label", "__class", "__n_test", "__n_val")
    # A row per class travels to every task; labels are few by nature.
    placed = rows.join(F.broadcast(classes), F.col(label).eqNullSafe(F.col("__label")))
    ranked = _ranks(placed, "__class", key, seed, buckets)
    part = (
        F.when(F.col("__rank") <= F.col("__n_test"), "test")
        .when(F.col("__rank") <= F.col("__n_test") + F.col("__n_val"), "val")
        .otherwise("train")
    )
    return ranked.withColumn("split", part).drop("__rank", "__class", "__label", "__n_test", "__n_val")


def overlap(split_rows: DataFrame, text: str) -> DataFrame:
    """Texts that train shares with test and with val; all zeros for a sound split."""
    digest = F.md5(tx.normal_form(F.coalesce(text, F.lit(""))).cast("binary"))
    seen = split_rows.groupBy(digest.alias("d")).agg(
        *[F.bool_or(F.col("split") == p).alias(p) for p in ("train", "val", "test")]
    )
    return seen.agg(
        F.count_if(F.col("train") & F.col("test")).alias("train_test_text_overlap"),
        F.count_if(F.col("train") & F.col("val")).alias("train_val_text_overlap"),
        F.count_if(F.col("val") & F.col("test")).alias("val_test_text_overlap"),
    )


def manifest(split_rows: DataFrame, label: str, source: str) -> DataFrame:
    """Size, share, class and source counts per part, as rows (split, facet, value, rows, pct)."""
    facets = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")),
        F.struct(F.lit("class").alias("facet"), F.col(label).cast("string").alias("value")),
        F.struct(F.lit("source").alias("facet"), F.col(source).cast("string").alias("value")),
    )
    counts = (
        split_rows.select("split", F.explode(facets).alias("f")).select("split", "f.*")
        .groupBy("split", "facet", "value").agg(F.count("*").alias("rows"))
    )
    # A few rows per part by now.
    return counts.withColumn(
        "pct", F.round(F.col("rows") * 100.0 / F.sum("rows").over(Win.partitionBy("facet")), 2)
    )
