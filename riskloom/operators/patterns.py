"""Recurring patterns: connected groups of similar texts, their figures, trend and advice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from riskloom.functions import graph
from riskloom.functions import vectors as VX
from riskloom.functions.lineage import checkpointed, stored
from riskloom.functions.wording import fill
from riskloom.operators import similar as SIM
from riskloom.packs import wording as W

# Vector sums (3 KB each) that a task holds, or that are sent to every task.
SUMS = 2_000
# Microseconds of a day.
DAY = 86_400_000_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge to another."""
    rooted = stored(graph.components(edges, "src", "dst"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(least, "root").select(F.col("node").alias("id"), "component")


def text_clusters(reports: DataFrame, threshold: float = 0.60, min_size: int = 2, text: str = "report_text",
                  order: str = "pos", embedding: Column | None = None,
                  block_rows: int = SIM.BLOCK_ROWS) -> DataFrame:
    """Distinct texts with their vector and the group they belong to; groups of fewer reports drop out."""
    embedded = SIM.embedded(SIM.distinct_texts(reports, text, order=order), embedding)
    texts = checkpointed(embedded.withColumn("vec", VX.unit("vec")))
    # A zero vector is similar to nothing, not even to its copies.
    real = texts.filter(F.exists("vec", lambda x: x != 0))
    groups = components(SIM.edges(real.select("vid", "vec", "first"), threshold, block_rows))
    named = real.join(groups, real["vid"] == groups["id"], "left").withColumn(
        "cluster", F.coalesce("component", "vid")
    ).drop("id", "component")
    sizes = named.groupBy("cluster").agg(F.sum("copies").alias("size"), F.min("first").alias("cluster_first"))
    return named.join(sizes.filter(F.col("size") >= min_size), "cluster")


def members(reports: DataFrame, clustered: DataFrame, text: str = "report_text", salts: int = 16) -> DataFrame:
    """Reports with their cluster. Salted, because one text may stand behind a large part of the reports."""
    keyed = reports.withColumns(
        {"vid": F.md5(F.coalesce(text, F.lit("")).cast("binary")), "salt": F.pmod(F.xxhash64("report_id"), F.lit(salts)).cast("int")}
    )
    spread = clustered.select("vid", "cluster", "size", "cluster_first").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return keyed.join(spread, ["vid", "salt"]).drop("vid", "salt")


def _vector_sums(clustered: DataFrame) -> DataFrame:
    """(cluster, total): the sum of a cluster's vectors, counted with their copies. Each task sums up its own rows first."""
    kind = clustered.schema["cluster"].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for cluster, vec, copies in zip(pdf["cluster"], pdf["vec"], pdf["copies"]):
                part = np.asarray(vec, dtype=np.float64) * copies
                sums[cluster] = sums[cluster] + part if cluster in sums else part
            if len(sums) > SUMS:
                yield pd.DataFrame({"cluster": list(sums), "part": list(sums.values())})
                sums = {}
        if sums:
            yield pd.DataFrame({"cluster": list(sums), "part": list(sums.values())})

    parts = clustered.select("cluster", "vec", "copies").mapInPandas(add, f"cluster {kind}, part array<double>")
    dims = parts.select("cluster", F.posexplode("part").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("s"))
    # One entry per dimension.
    return dims.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda d: d["s"]).alias("total"))


def cohesion(clustered: DataFrame) -> DataFrame:
    """Per cluster: mean cosine over all pairs of its reports, and the text closest to all of them.

    With unit vectors the sum of all pairwise cosines is the squared length of the vector sum, and a
    text's sum of cosines is its product with that sum: no pair is ever formed.
    """
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    sums = stored(_vector_sums(clustered))
    # One vector a cluster; a cluster with very many texts is split by the join itself where sums are too many to send around.
    small = sums.count() <= SUMS
    close = clustered.join(F.broadcast(sums) if small else sums, "cluster").select(
        "cluster", "vid", "first", "size", "text", F.round(dot(F.col("vec"), F.col("total")), 9).alias("closeness"), dot(F.col("total"), F.col("total")).alias("square"))
    best = F.max_by(F.struct("text", "size", "square"), F.struct(F.col("closeness"), -F.col("first"))).alias("m")
    n = F.col("m.size")
    mean = (F.col("m.square") - n) / (n * (n - 1))
    return close.groupBy("cluster").agg(best).select(
        "cluster", F.col("m.text").alias("representative_text"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, mean).otherwise(1.0))), 4).alias("average_similarity"),
    )


def common(rows: DataFrame, column: str, name: str, default: str, order: str = "pos") -> DataFrame:
    """The most frequent value per cluster, the one seen first among equals, or the default."""
    return most_common(rows.groupBy("cluster", F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("seen")), name, default)


def most_common(counts: DataFrame, name: str, default: str) -> DataFrame:
    """The same from counts (cluster, value, n, seen)."""
    # Null values count for nothing but keep their cluster in the result.
    rank = F.when(F.col("value").isNotNull(), F.struct(F.col("n"), -F.col("seen")))
    return counts.groupBy("cluster").agg(
        F.coalesce(F.max_by("value", rank), F.lit(default)).alias(name)
    )


def trend(rows: DataFrame, group: str = "cluster", at: str = "created_at") -> DataFrame:
    """First and last day, span, counts per day and direction per group.

    The direction compares the two halves of the span, the midpoint counting to the first. Groups of at
    most two rows, or of less than a day, are isolated.
    """
    # Counts per moment, written once: every figure below comes from them and not from the reports.
    return trend_of(checkpointed(
        rows.groupBy(group, F.unix_micros(F.col(at).cast("timestamp")).alias("us")).agg(F.count("*").alias("n"))
    ), group)


def trend_of(times: DataFrame, group: str = "cluster") -> DataFrame:
    """The same from a table of counts per moment (group, us, n), which is read several times."""
    dated = times.filter(F.col("us").isNotNull())
    ends = times.groupBy(group).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.coalesce(F.sum(F.when(F.col("us").isNotNull(), F.col("n"))), F.lit(0)).alias("dated")
    ).withColumn("span_days", F.coalesce(F.floor((F.col("hi") - F.col("lo")) / DAY), F.lit(0)))
    mid = (F.col("lo") + F.col("hi")) / 2
    of_day = F.floor(F.col("us") / DAY)
    split = ends.select(group, mid.alias("mid"), F.floor(mid / DAY).alias("mid_day"))
    # Whole days are added up before they meet their group; single moments are looked at on the day of the midpoint only.
    whole = dated.groupBy(group, of_day.alias("day")).agg(F.sum("n").alias("n")).join(split, group).filter(F.col("day") != F.col("mid_day"))
    beside = dated.withColumn("mid_day", of_day).join(split, [group, "mid_day"])
    halves = whole.select(group, "n", (F.col("day") < F.col("mid_day")).alias("early")).unionByName(
        beside.select(group, "n", (F.col("us") <= F.col("mid")).alias("early"))).groupBy(group).agg(
        F.coalesce(F.sum(F.when(F.col("early"), F.col("n"))), F.lit(0)).alias("first_half"),
        F.coalesce(F.sum(F.when(~F.col("early"), F.col("n"))), F.lit(0)).alias("second_half"),
    )
    days = dated.groupBy(group, F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day")).agg(F.sum("n").alias("n"))
    # One entry per calendar day: bounded by the days of the span.
    per_day = days.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("day", "n")))).alias("date_counts"))
    ends = ends.withColumns({"first_seen": F.timestamp_micros("lo"), "last_seen": F.timestamp_micros("hi")})
    direction = (
        F.when(F.col("dated") == 0, "stable")
        .when((F.col("dated") <= 2) | (F.col("span_days") == 0), "isolated")
        .when(F.col("second_half") > F.col("first_half"), "increasing")
        .when(F.col("second_half") < F.col("first_half"), "decreasing")
        .otherwise("stable")
    )
    return (
        ends.join(halves, group, "left").join(per_day, group, "left")
        .select(group, direction.alias("trend_direction"), "first_seen", "last_seen", "span_days", "date_counts")
    )


def recommendation(hazard: Column, barrier: Column, activity: Column) -> Column:
    """Advice by the first matching keyword of hazard or barrier failure."""
    h, b = F.lower(hazard), F.lower(barrier)
    chosen = F.when(F.lit(False), "")
    for in_hazard, in_barrier, advice in W.RECOMMENDATIONS:
        hit = F.lit(False)
        for word in in_hazard:
            hit = hit | h.contains(word)
        for word in in_barrier:
            hit = hit | b.contains(word)
        chosen = chosen.when(hit, advice)
    return chosen.otherwise(fill(W.RECOMMENDATION_OTHER, activity=activity, barrier=barrier))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a running number in the given order without sorting everything in one task.

    Rows are range-partitioned by the sort, written once, and numbered inside their partition on top of
    the sizes of the partitions before.
    """
    placed = checkpointed(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Win.partitionBy().orderBy("__part").rowsBetween(Win.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Win.partitionBy("__part").orderBy(*order))
    return (
        placed.withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")
    )


def semantic_patterns(reports: DataFrame, threshold: float = 0.60, min_size: int = 2,
                      embedding: Column | None = None, block_rows: int = SIM.BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Patterns and their members, from analysed reports (text, pos, created_at, activity, hazard, barrier, status).

    Members come as rows (pattern_id, report_id), because one pattern may hold a large part of all reports.
    """
    clustered = checkpointed(
        text_clusters(reports, threshold, min_size, embedding=embedding, block_rows=block_rows)
    )
    # Written once: the figures below read it several times.
    rows = checkpointed(
        members(reports, clustered)
        .select("cluster", "report_id", "pos", "created_at", "activity", "hazard", barrier_failure().alias("barrier_failure"))
    )
    base = clustered.groupBy("cluster").agg(F.max("size").alias("number_of_reports"), F.min("first").alias("first"))
    shared = [common(rows, column, name, W.COMMON_DEFAULTS[kind]) for column, name, kind in COMMON]
    ranked = ranked_patterns(advised(base, cohesion(clustered), trend(rows), *shared))
    listed = rows.select("cluster", "report_id").join(ranked.select("cluster", "pattern_id"), "cluster").select("pattern_id", "report_id")
    return ranked.drop("cluster", "first"), listed


#: What is counted of the reports of a pattern, what the most frequent value is called, and the default for it.
COMMON = (("activity", "common_activity", "activity"), ("hazard", "common_hazard", "hazard"), ("barrier_failure", "common_barrier_failure", "barrier"))


def barrier_failure() -> Column:
    """Barrier and status of an analysed report as one text; null without a barrier."""
    status = F.coalesce("barrier_status", F.lit(W.COMMON_DEFAULTS["status"]))
    return F.when(F.col("barrier").isNotNull(), F.concat("barrier", F.lit(" ("), status, F.lit(")")))


def advised(base: DataFrame, *figures: DataFrame) -> DataFrame:
    """A row per cluster with all figures, and the advice that follows from them."""
    for figure in figures:
        base = base.join(figure, "cluster")
    advice = recommendation(F.col("common_hazard"), F.col("common_barrier_failure"), F.col("common_activity"))
    return base.withColumn("recommended_action", advice)


def ranked_patterns(stats: DataFrame) -> DataFrame:
    """Patterns with an id by their rank: the largest first, of equal ones the one seen first."""
    ranked = numbered(stats, [F.desc("number_of_reports"), F.asc("first")], "pattern_number")
    number = F.col("pattern_number").cast("string")
    return ranked.withColumn("pattern_id", F.concat(F.lit("PAT-SEM-"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))).drop("pattern_number")
