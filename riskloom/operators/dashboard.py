"""Dashboard figures and recurring-gap patterns over the list view.

Everything is a partial aggregate: rows shrink to a handful of groups before any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from riskloom.functions.lineage import checkpointed, stored
from riskloom.functions.wording import fill
from riskloom.operators.views import newest
from riskloom.packs import wording as W
from riskloom.packs.scoring import COMPROMISED

LEVELS = ("HIGH", "MEDIUM", "LOW")
DECISIONS = ("confirmed", "corrected", "rejected")


def _percent_of(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100, 1)


def kpis(rows: DataFrame) -> DataFrame:
    """Totals by final priority, precursor rate, review progress and agreement; zeros on empty input."""
    reviewed = F.col("hse_reviewed")
    precursor = (F.col("sif_probability") >= 0.5) | (F.col("final_priority") == "HIGH")
    agreed = reviewed & ((F.col("review_decision") == "confirmed") | (F.col("final_priority") == F.col("ai_priority")))
    return rows.agg(
        F.count("*").alias("total_reports"),
        *[F.count_if(F.col("final_priority") == p).alias(f"{p.lower()}_priority_count") for p in LEVELS],
        F.count_if(precursor).alias("__precursors"),
        F.count_if(~reviewed).alias("pending_reviews_count"),
        F.count_if(reviewed).alias("completed_reviews_count"),
        F.count_if(agreed).alias("__agreed"),
    ).select(
        "total_reports",
        *[f"{p.lower()}_priority_count" for p in LEVELS],
        F.when(F.col("total_reports") > 0, _percent_of(F.col("__precursors"), F.col("total_reports")))
        .otherwise(0.0).alias("sif_precursor_rate"),
        "pending_reviews_count",
        "completed_reviews_count",
        F.when(F.col("completed_reviews_count") > 0,
               _percent_of(F.col("__agreed"), F.col("completed_reviews_count")))
        .otherwise(100.0).alias("agreement_rate"),
    )


def precursor_rates(rows: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """(basis, sif_precursor_rate): share of reports with probability of at least one half or HIGH priority.

    ``on`` names the priority column of each basis; all are counted in one pass.
    """
    rates = F.array(*[
        F.struct(F.lit(basis).alias("basis"), F.when(F.count("*") > 0, _percent_of(
            F.count_if((F.col("sif_probability") >= 0.5) | (F.col(column) == "HIGH")), F.count("*"))).otherwise(0.0).alias("sif_precursor_rate"))
        for basis, column in on.items()
    ])
    return rows.agg(rates.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _comparison() -> list[Column]:
    reviewed = F.col("hse_reviewed")
    return [
        *[F.count_if(F.col("ai_priority") == p).alias(f"ai_{p.lower()}") for p in LEVELS],
        *[F.count_if(reviewed & (F.col("final_priority") == p)).alias(f"final_{p.lower()}") for p in LEVELS],
    ]


def _states() -> list[Column]:
    reviewed = F.col("hse_reviewed")
    return [
        F.count_if(~reviewed).alias("pending"),
        *[F.count_if(reviewed & (F.col("review_decision") == d)).alias(d) for d in DECISIONS],
    ]


def ai_vs_final(rows: DataFrame) -> DataFrame:
    """AI distribution, and the final distribution over reviewed reports with the unreviewed beside it."""
    return rows.agg(*_comparison(), F.count_if(~F.col("hse_reviewed")).alias("final_unreviewed"))


def review_status(rows: DataFrame) -> DataFrame:
    """Review states and how often reviewers agreed with the AI; 100 when nothing was reviewed."""
    reviewed = F.col("hse_reviewed")
    agreed = reviewed & ((F.col("review_decision") == "confirmed") | (F.col("final_priority") == F.col("ai_priority")))
    return rows.agg(
        *_states(),
        F.count_if(reviewed).alias("total_reviewed"),
        F.when(F.count_if(reviewed) > 0, _percent_of(F.count_if(agreed), F.count_if(reviewed)))
        .otherwise(100.0).alias("agreement_rate"),
    )


def first_seen() -> Column:
    """Smallest for the row that comes first in the list view; breaks ties between equal counts."""
    return F.min(F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("priority_score"), F.col("report_id")))


def top_values(rows: DataFrame, column: str, name: str, limit: int = 5) -> DataFrame:
    """Most frequent values with their share of *all* rows; ties go to the value seen first.

    Counts per value, null included, are small; their sum is the total, so the table is read once.
    """
    counts = rows.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("count"), first_seen().alias("__seen"))
    # One row per distinct value: a window over it holds the vocabulary, never the reports.
    total = F.sum("count").over(Win.partitionBy())
    return (
        counts.withColumn("__total", total)
        .filter(F.col(name).isNotNull())
        .orderBy(F.desc("count"), "__seen")
        .limit(limit)
        .select(name, "count", _percent_of(F.col("count"), F.col("__total")).alias("percentage"))
    )


def barrier_gaps(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent (barrier, compromised state) pairs, with their rank."""
    gaps = (
        rows.filter(F.col("ai_barrier").isNotNull() & F.col("barrier_status").isin(*COMPROMISED))
        .groupBy(F.col("ai_barrier").alias("barrier"), "barrier_status")
        .agg(F.count("*").alias("count"), first_seen().alias("__seen"))
        .orderBy(F.desc("count"), "__seen")
        .limit(limit)
    )
    rank = F.row_number().over(Win.orderBy(F.desc("count"), "__seen"))
    return gaps.withColumn("gap_rank", rank).drop("__seen")


def recurring_clusters(rows: DataFrame, clusters: int = 4, samples: int = 6) -> DataFrame:
    """The top gaps as risk clusters: band, advice and the first few report ids in list order.

    The top gaps are at most ``clusters`` rows, so they are sent to the reports. The rank filter keeps
    ``samples`` rows per gap in every task before the shuffle, so no gap is gathered whole.
    """
    # The few columns needed are written once; ranking and sampling both read them.
    rows = checkpointed(
        rows.select("ai_barrier", "barrier_status", "report_id", "created_at", "priority_score")
        .filter(F.col("ai_barrier").isNotNull() & F.col("barrier_status").isin(*COMPROMISED))
    )
    top = checkpointed(barrier_gaps(rows, clusters))
    order = Win.partitionBy("barrier", "barrier_status").orderBy(
        F.desc("created_at"), F.desc("priority_score"), F.asc("report_id")
    )
    members = (
        rows.select(F.col("ai_barrier").alias("barrier"), "barrier_status", "report_id", "created_at", "priority_score")
        .join(F.broadcast(top.select("barrier", "barrier_status")), ["barrier", "barrier_status"])
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= samples)
        .groupBy("barrier", "barrier_status")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "report_id"))), lambda m: m["report_id"]).alias("sample_report_ids"))
    )
    barrier, status = F.col("barrier"), F.col("barrier_status")
    return top.join(F.broadcast(members), ["barrier", "barrier_status"]).select(
        "gap_rank",
        fill(W.CLUSTER_NAME, barrier=barrier, status=status).alias("cluster_name"),
        barrier,
        status,
        F.col("count").alias("occurrences"),
        F.when(status.isin("Not Verified", "Failed"), "HIGH").otherwise("MEDIUM").alias("risk_band"),
        fill(W.CLUSTER_ADVICE, barrier=barrier).alias("recommendation"),
        "sample_report_ids",
    )


def pattern_summary(rows: DataFrame) -> DataFrame:
    """One sentence on the leading hazard and barrier gap, with stand-ins when there are none."""
    # The few columns needed are written once; each side below is then one row.
    rows = checkpointed(
        rows.select("ai_hazard", "ai_barrier", "barrier_status", "report_id", "created_at", "priority_score")
    )
    totals = rows.agg(F.count("*").alias("total"))
    hazard = top_values(rows, "ai_hazard", "hazard", 1).agg(F.max("hazard").alias("hazard"))
    barrier = barrier_gaps(rows, 1).agg(F.max("barrier").alias("barrier"))
    sentence = fill(
        W.PATTERN_SUMMARY,
        total=F.col("total").cast("string"),
        hazard=F.coalesce("hazard", F.lit(W.SUMMARY_HAZARD_DEFAULT)),
        barrier=F.coalesce("barrier", F.lit(W.SUMMARY_BARRIER_DEFAULT)),
    )
    key = F.lit(1).alias("one")
    joined = (
        totals.select(key, "total")
        .join(hazard.select(key, "hazard"), "one")
        .join(barrier.select(key, "barrier"), "one")
    )
    return joined.select(
        F.col("total").alias("total_analyzed"),
        F.when(F.col("total") > 0, sentence).otherwise(W.PATTERN_SUMMARY_EMPTY).alias("summary"),
    )


def alert_totals(alert_rows: DataFrame) -> DataFrame:
    open_ = ~F.col("acknowledged")
    return alert_rows.agg(
        F.count("*").alias("total_alerts"), F.count_if(open_).alias("unacknowledged"),
        F.count_if(~open_).alias("acknowledged_alerts"),
    )


def alert_overview(alert_rows: DataFrame, shown: int = 5) -> DataFrame:
    """The totals with the newest open alerts beside them (array ``latest``)."""
    few = newest(alert_rows.filter(~F.col("acknowledged")), "alert_id", shown)
    latest = few.agg(F.sort_array(F.collect_list(F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "alert_id", "report_id"))).alias("l"))
    both = alert_totals(alert_rows).withColumn("one", F.lit(1)).join(latest.withColumn("one", F.lit(1)), "one")
    return both.select(*[c for c in both.columns if c not in ("one", "l")], F.transform("l", lambda a: a["alert_id"]).alias("latest"))


def top_series(rows: DataFrame, limit: int = 6) -> DataFrame:
    """Chart-ready rows (chart, label, count) of the leading hazards, activities and barrier gaps."""
    rows = stored(rows.select("ai_hazard", "ai_activity", "ai_barrier", "barrier_status", "report_id", "created_at", "priority_score"))
    hazards = top_values(rows, "ai_hazard", "label", limit).select(F.lit("hazards").alias("chart"), "label", "count")
    activities = top_values(rows, "ai_activity", "label", limit).select(F.lit("activities").alias("chart"), "label", "count")
    gaps = barrier_gaps(rows, limit).select(
        F.lit("barrier_gaps").alias("chart"), fill(W.CLUSTER_NAME, barrier=F.col("barrier"), status=F.col("barrier_status")).alias("label"), "count")
    return hazards.unionByName(activities).unionByName(gaps)


def daily_trend(rows: DataFrame, at: str = "created_at", on: str = "final_priority") -> DataFrame:
    """Reports per day and priority, from the data itself."""
    return (
        rows.groupBy(F.to_date(at).alias("day"))
        .agg(*[F.count_if(F.col(on) == p).alias(p.lower()) for p in LEVELS], F.count("*").alias("total"))
    )


def chart_series(rows: DataFrame) -> DataFrame:
    """Chart-ready rows: AI against final per priority, and the review states that occur."""
    figures = rows.agg(*_comparison(), *_states())
    comparison = [
        F.struct(F.lit("ai_vs_final").alias("chart"), F.lit(p).alias("label"),
                 F.col(f"ai_{p.lower()}").alias("ai"), F.col(f"final_{p.lower()}").alias("final"))
        for p in LEVELS
    ]
    states = [
        F.struct(F.lit("review_status").alias("chart"), F.lit(s.capitalize()).alias("label"),
                 F.lit(None).cast("bigint").alias("ai"), F.col(s).alias("final"))
        for s in (*DECISIONS, "pending")
    ]
    series = figures.select(F.explode(F.array(*comparison, *states)).alias("s")).select("s.*")
    return series.filter((F.col("chart") == "ai_vs_final") | (F.col("final") > 0))


def cohort_summary(decided: DataFrame) -> DataFrame:
    """Load summary of a cohort: reports per AI priority and rules fired."""
    return decided.agg(
        F.count("*").alias("total_loaded"),
        *[F.count_if(F.col("priority") == p).alias(f"{p.lower()}_priority_count") for p in LEVELS],
        F.coalesce(F.sum(F.size("matched_rules")), F.lit(0)).alias("rules_fired_count"),
    )


def cohort_status(reports: DataFrame, prefix: str, category: str = "report_type") -> DataFrame:
    """Whether any report of a cohort is loaded, how many, and their categories in order (a column of few values)."""
    mine = reports.filter(F.col("report_id").startswith(prefix))
    return mine.agg((F.count("*") > 0).alias("is_loaded"), F.count("*").alias("reports_count"),
                    F.max("created_at").alias("last_loaded"), F.sort_array(F.collect_set(category)).alias("categories"))
