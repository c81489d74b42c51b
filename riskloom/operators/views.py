"""Read models over reports, analyses and reviews: summaries, lists, filters, pages, single-report views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import text as tx
from riskloom.operators import workflow as WF
from riskloom.packs import wording as W

SNIPPET = 120


def summary(routed: DataFrame, reviews: DataFrame) -> DataFrame:
    """The list view: AI values, final values (corrected where given, else AI) and workflow, one row per report.

    To-many sides are reduced to one row before they are joined.
    """
    s = WF.resolve(routed, reviews)
    final_activity = F.coalesce(tx.non_empty(F.col("corrected_activity")), "activity")
    final_hazard = F.coalesce(tx.non_empty(F.col("corrected_hazard")), "hazard")
    final_barrier = F.coalesce(tx.non_empty(F.col("corrected_barrier")), "barrier")
    columns = {
        "report_id": F.col("report_id"),
        "report_text": F.col("report_text"),
        "report_type": F.col("report_type"),
        "created_at": F.col("created_at"),
        "priority": F.col("final_priority"),
        "priority_score": F.coalesce("priority_score", F.lit(0.0)),
        "sif_probability": F.coalesce("sif_probability", F.lit(0.0)),
        "activity": final_activity,
        "hazard": final_hazard,
        "barrier": final_barrier,
        "barrier_status": F.col("barrier_status"),
        "location": F.col("location"),
        "triggered_rules_count": F.size("matched_rules"),
        "hse_reviewed": F.col("decision").isNotNull(),
        "review_decision": F.col("decision"),
        "reviewer_id": F.col("reviewer_id"),
        "reviewed_at": F.col("reviewed_at"),
        "ai_priority": F.col("priority"),
        "ai_activity": F.col("activity"),
        "ai_hazard": F.col("hazard"),
        "ai_barrier": F.col("barrier"),
        "final_priority": F.col("final_priority"),
        "final_activity": final_activity,
        "final_hazard": final_hazard,
        "final_barrier": final_barrier,
        "workflow_status": F.col("workflow_status"),
        "in_review_queue": F.col("in_review_queue"),
        "queue_entered_at": F.col("queue_entered_at"),
        "alert_triggered": F.col("workflow_status") == W.REVIEW_REQUIRED,
    }
    if "source_file_name" in routed.columns:
        columns["source_file_name"] = F.col("source_file_name")
    if "explanation" in routed.columns:
        columns["explanation_snippet"] = F.coalesce(tx.clip(F.col("explanation"), SNIPPET), F.lit(""))
    return s.select(*[c.alias(n) for n, c in columns.items()])


def dual_view(routed: DataFrame, reviews: DataFrame, per_field_fallback: bool = True) -> DataFrame:
    """AI output beside the reviewed values.

    With ``per_field_fallback`` a field that the reviewer left empty keeps the AI value (list view).
    Without it, a corrected review shows exactly what the reviewer entered (single-report view).
    """
    s = WF.resolve(routed, reviews)

    def final(name: str) -> Column:
        corrected = tx.non_empty(F.col(f"corrected_{name}"))
        if per_field_fallback:
            return F.coalesce(corrected, F.col(name))
        return F.when(F.col("decision") == "corrected", F.col(f"corrected_{name}")).otherwise(F.col(name))

    return s.select(
        "report_id", F.col("priority").alias("ai_priority"), "final_priority",
        *[c for n in ("activity", "hazard", "barrier")
          for c in (F.col(n).alias(f"ai_{n}"), final(n).alias(f"final_{n}"))],
        F.col("decision").alias("review_decision"),
    )


def consolidated(decided: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per report with its rules, spans and reviews nested.

    Rules and spans already sit on the row. Only the reviews are gathered, a report's few at a time.
    """
    fields = [c for c in reviews.columns if c != "report_id"]
    per_report = reviews.groupBy("report_id").agg(
        F.sort_array(F.collect_list(F.struct("reviewed_at", *[c for c in fields if c != "reviewed_at"]))).alias("reviews")
    )
    return decided.join(per_report, "report_id", "left").withColumn(
        "reviews", F.coalesce("reviews", F.array().cast(per_report.schema["reviews"].dataType))
    )


# ------------------------------------------------------------------ filters


def list_filter(
    rows: DataFrame, priority: str | None = None, hazard: str | None = None, activity: str | None = None,
    on: str = "final",
) -> DataFrame:
    """Priority equality and case-insensitive parts of hazard and activity; null never matches.

    ``on`` chooses the final or the AI hazard and activity; priority is always the final one.
    """
    out = rows
    if priority:
        out = out.filter(F.col("final_priority") == priority)
    if hazard:
        out = out.filter(F.lower(f"{on}_hazard").contains(hazard.lower()))
    if activity:
        out = out.filter(F.lower(f"{on}_activity").contains(activity.lower()))
    return out


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows in which any of id, activity, hazard, text, location contains the query; blank passes all."""
    if not query.strip():
        return rows
    hit = F.lit(False)
    for column in ("report_id", "activity", "hazard", "report_text", "location"):
        hit = hit | F.coalesce(F.lower(column).contains(query.lower()), F.lit(False))
    return rows.filter(hit)


def _decided_as(decision: str) -> Column:
    return F.col("hse_reviewed") & (F.col("review_decision") == decision)


QUEUE_MODES = {
    "pending": lambda: ~F.col("hse_reviewed"),
    "confirmed": lambda: _decided_as("confirmed"),
    "corrected": lambda: _decided_as("corrected"),
    "rejected": lambda: _decided_as("rejected"),
    "critical": lambda: F.col("final_priority") == "CRITICAL",
    "high": lambda: F.col("final_priority") == "HIGH",
    "medium": lambda: F.col("final_priority") == "MEDIUM",
    "all": lambda: F.lit(True),
}


def review_queue(rows: DataFrame, mode: str = "pending") -> DataFrame:
    return rows.filter(QUEUE_MODES.get(mode, QUEUE_MODES["all"])())


def queue_counts(rows: DataFrame) -> DataFrame:
    """How many rows each queue mode would show, in one pass."""
    return rows.agg(*[F.count_if(test()).alias(mode) for mode, test in QUEUE_MODES.items()])


# ------------------------------------------------------------------ order and pages


def newest_first(rows: DataFrame) -> list[Column]:
    return [F.desc("created_at"), F.desc("priority_score"), F.asc("report_id")]


def page(rows: DataFrame, limit: int = 50, offset: int = 0, by_score: bool = False) -> DataFrame:
    """One page: newest first, or highest score first. Equal rows are ordered by id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1-200 and offset not negative")
    order = (
        [F.desc("priority_score"), F.desc("created_at"), F.asc("report_id")] if by_score else newest_first(rows)
    )
    return rows.orderBy(*order).offset(offset).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    """Row count before paging."""
    return rows.agg(F.count("*").alias("total"))


def high_risk(rows: DataFrame, limit: int = 50, by_score: bool = False) -> DataFrame:
    """The final-HIGH reports, newest first (or highest score first)."""
    order = [F.desc("priority_score"), F.asc("report_id")] if by_score else newest_first(rows)
    return rows.filter(F.col("final_priority") == "HIGH").orderBy(*order).limit(limit)


def needs_attention(rows: DataFrame, window: int = 10, shown: int = 4) -> DataFrame:
    """Of the first ten HIGH reports, the first four nobody has reviewed (the cut comes before the filter)."""
    first = rows.filter(F.col("final_priority") == "HIGH").orderBy(*newest_first(rows)).limit(window)
    return first.filter(~F.col("hse_reviewed")).orderBy(*newest_first(rows)).limit(shown)


def newest(rows: DataFrame, key: str, limit: int = 50, ascending: bool = False) -> DataFrame:
    """Newest (or oldest) rows first; equal times are ordered by key."""
    when = F.asc("created_at") if ascending else F.desc("created_at")
    return rows.orderBy(when, F.asc(key)).limit(limit)


def actions_list(
    rows: DataFrame, status: str | None = None, priority: str | None = None, limit: int | None = None, window: int | None = None,
) -> DataFrame:
    """Actions of a status (any case) and priority; all of them, or the newest ``limit``.

    ``window``, if given, looks at that many newest actions only, before the filters.
    """
    out = rows if window is None else newest(rows, "action_id", window)
    if status:
        out = out.filter(F.lower("status") == status.lower())
    if priority:
        out = out.filter(F.col("priority") == priority)
    return out if limit is None else newest(out, "action_id", limit)


def workflow_status(resolved: DataFrame, alert_rows: DataFrame, audit: DataFrame, recent: int | None = None) -> DataFrame:
    """State, badge, alerts and number of audit entries per report; ``recent`` counts among so many newest alerts only."""
    seen = alert_rows if recent is None else newest(alert_rows, "alert_id", recent)
    shown = seen.groupBy("report_id").agg(F.count("*").alias("alerts"))
    entries = audit.groupBy(F.col("entity_id").alias("report_id")).agg(F.count("*").alias("audit_entries"))
    return (
        resolved.select("report_id", F.col("final_priority").alias("priority"), "workflow_status", "in_review_queue",
                        WF.badge(F.col("workflow_status")).alias("display_badge"))
        .join(shown, "report_id", "left")
        .join(entries, "report_id", "left")
        .fillna(0, ["alerts", "audit_entries"])
    )
