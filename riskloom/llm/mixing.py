"""Mixing of report sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.lineage import stored

#: Rows of the rate table (a source name and a few numbers) up to which it is sent to every executor.
FEW = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words that white space separates; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rates(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """target and rate of each source, from one row (source, source_size) a source.

    The sources, by code point and null last, weigh ``weights`` in turn. ``share`` times all sizes is dealt by
    weight; what exceeds ``most`` times a source's own size is dealt again among the rest, until none is above.
    That ends with the sources of the smallest size per weight at their limit and one level for the others, so
    the level is found in one ordered pass over the rows, which are as many as there are sources.
    """
    every = Window.partitionBy()
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    rows = sources.select("source", "source_size", weight.alias("weight")).withColumn("limit", limit)
    rising = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.row_number().over(rising).alias("nth"),
        # The level that holds if exactly the sources before this one are at their limit.
        ((F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0)))
         / F.sum("weight").over(onward)).alias("level"),
    )
    free = F.col("level") * F.col("weight") <= F.col("limit")
    level = F.min(F.when(free, F.struct("nth", "level"))).over(every)["level"]
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return rows.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def mix_sources(
    reports: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """How often each report enters a mix in which every ``source`` has its target number of words.

    Reads report_id, report_text and source. Sizes are counted in words and summed by source (reduced before
    the shuffle); a report is taken floor(rate) times, and once more with the fraction as probability, decided
    by a hash of ``seed`` and its id, so reruns agree. Nothing leaves the JVM.

    Returns all input columns and size, source_size, target, rate, copies (long, 0 if the report is left out).
    Input columns of those names are replaced. A null text has size 0; null is a source like others, weighed
    last. Rows repeated with one id get the same number of copies each; rows without an id share one draw.
    A source without words has rate 0. An empty table gives an empty result.
    """
    computed = ("size", "source_size", "target", "rate", "copies")
    sized = reports.drop(*[c for c in computed if c != "source"]).withColumn("size", n_words(F.col("report_text")))
    table = stored(rates(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    table = table.select(F.col("source").alias("mix_source"), "source_size", "target", "rate")
    # A row per source: sent to all executors only where the count shows that it is small.
    small = table.count() <= FEW
    joined = sized.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("mix_source")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("report_id").cast("string"), F.lit("")))), 1, 8), 16, 10)
    extra = draw.cast("double") / F.lit(float(1 << 32)) < F.col("rate") - F.floor("rate")
    return joined.drop("mix_source").withColumn("copies", F.floor("rate") + extra.cast("long"))


def repeated(mixed: DataFrame) -> DataFrame:
    """A row per copy taken."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy")
