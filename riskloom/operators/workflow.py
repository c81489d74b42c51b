"""Workflow: routing of analysed reports, alerts, reviews, transitions, actions and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import text as tx
from riskloom.functions.wording import fill
from riskloom.packs import wording as W

ALERT_SNIPPET = 120


def route(decided: DataFrame, entered_at: str = "created_at") -> DataFrame:
    """Add the workflow state that follows from the priority; only HIGH enters the review queue."""
    high = F.col("priority") == "HIGH"
    return decided.withColumns(
        {
            "workflow_status": F.when(high, W.REVIEW_REQUIRED)
            .when(F.col("priority") == "MEDIUM", W.MONITORING)
            .otherwise(W.CONTROLLED),
            "in_review_queue": high,
            "queue_entered_at": F.when(high, F.col(entered_at)),
            "alert_triggered": high,
        }
    )


def alerts(routed: DataFrame, text: str = "report_text", raised_at: str = "created_at", keep: tuple[str, ...] = ()) -> DataFrame:
    """One open alert per report that was routed to review; its id follows from the report's. ``keep`` names columns that stay."""
    message = fill(
        W.ALERT_MESSAGE,
        report=F.col("report_id"),
        pct=tx.percent(F.col("sif_probability")),
        hazard=F.coalesce("hazard", F.lit("Unspecified")),
        barrier=F.coalesce("barrier", F.lit("Unspecified")),
        status=F.coalesce("barrier_status", F.lit("Unknown")),
    )
    return routed.filter("alert_triggered").select(
        F.concat(F.lit("ALT-"), "report_id").alias("alert_id"),
        "report_id",
        F.lit(W.ALERT_TITLE).alias("title"),
        F.lit("HIGH").alias("severity"),
        message.alias("message"),
        F.lit(W.REVIEW_REQUIRED).alias("workflow_status"),
        F.lit(False).alias("acknowledged"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
        F.lit(None).cast("string").alias("acknowledged_by"),
        F.col(raised_at).alias("created_at"),
        F.substring(text, 1, ALERT_SNIPPET).alias("report_text_snippet"),
        *keep,
    )


def badge(status: Column) -> Column:
    return F.coalesce(tx.lookup(status, W.BADGES), status)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key.

    An aggregate rather than a window: rows are reduced before the shuffle, so a hot key costs one row
    per task.
    """
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(key).agg(newest).select(key, *[F.col("row")[c].alias(c) for c in rest])


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return latest(reviews, "report_id", ["reviewed_at", "reviewer_id"])


def final_priority(decision: Column, corrected: Column, original: Column) -> Column:
    """The reviewed priority: rejection means LOW, a correction counts if it was given."""
    return F.when(decision == "rejected", "LOW").when(decision == "corrected", F.coalesce(corrected, original)).otherwise(original)


def apply_reviews(decided: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review facts: original values kept beside the final ones. Reviews of unknown reports drop out."""
    original = decided.select(
        "report_id",
        F.col("priority").alias("original_priority"),
        F.col("activity").alias("original_activity"),
        F.col("hazard").alias("original_hazard"),
        F.col("barrier").alias("original_barrier"),
        F.col("sif_probability").alias("original_sif_probability"),
    )
    return reviews.join(original, "report_id").withColumn(
        "final_priority",
        final_priority(F.col("decision"), F.col("corrected_priority"), F.col("original_priority")),
    )


def orphans(children: DataFrame, reports: DataFrame, key: str = "report_id") -> DataFrame:
    """Reviews or feedback whose report does not exist."""
    return children.join(reports.select(key), key, "left_anti")


def resolve(routed: DataFrame, reviews: DataFrame) -> DataFrame:
    """Workflow state after the latest review: status by decision, out of the queue; with the state before."""
    return after_review(routed.join(latest_reviews(reviews), "report_id", "left"))


def after_review(rows: DataFrame) -> DataFrame:
    """The same for rows that have the columns of their latest review beside them."""
    reviewed = F.col("decision").isNotNull()
    return (
        rows.withColumn("previous_status", F.col("workflow_status"))
        .withColumns(
            {
                "workflow_status": _status_after(),
                "in_review_queue": F.col("in_review_queue") & ~reviewed,
                "final_priority": final_priority(F.col("decision"), F.col("corrected_priority"), F.col("priority")),
            }
        )
        .withColumn("final_priority", F.coalesce("final_priority", "priority"))
    )


def _status_after() -> Column:
    return F.when(F.col("decision").isNotNull(), F.concat(F.lit("REVIEWED_"), F.upper("decision"))).otherwise(F.col("workflow_status"))


def resolve_alerts(alert_rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """A review closes the alerts of its report and leaves its own status on them."""
    last = latest_reviews(reviews).select("report_id", "decision")
    return alerts_after_review(alert_rows.join(last, "report_id", "left")).drop("decision")


def alerts_after_review(rows: DataFrame) -> DataFrame:
    """The same for alerts that have the ``decision`` beside them."""
    return rows.withColumns({"workflow_status": _status_after(), "acknowledged": F.col("acknowledged") | F.col("decision").isNotNull()})


def action_due() -> Column:
    return F.col("decision").isin("confirmed", "corrected") & (F.col("final_priority") == "HIGH")


def actions(resolved: DataFrame, opened_at: str = "reviewed_at", keep: tuple[str, ...] = ()) -> DataFrame:
    """An open action for every report whose reviewed priority is HIGH and whose review upheld the risk.

    The *reviewed* priority decides, so a correction up opens an action and a correction down does not.
    """
    title = fill(
        W.ACTION_TITLE,
        barrier=F.coalesce("corrected_barrier", "barrier", F.lit("critical controls")),
        hazard=F.coalesce("corrected_hazard", "hazard", F.lit("identified hazard")),
    )
    return resolved.filter(action_due()).select(
        F.concat(F.lit("ACT-"), "report_id").alias("action_id"),
        "report_id",
        title.alias("title"),
        F.col("final_priority").alias("priority"),
        F.lit("Open").alias("status"),
        F.coalesce("location", F.lit("Unknown")).alias("site_location"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.col(opened_at).alias("created_at"),
        *keep,
    )


def current_state(rows: DataFrame, events: DataFrame, key: str, order: str, status: str, assignee: str) -> DataFrame:
    """Rows with their state after all events: the last status wins, a null assignee keeps the one before."""
    last = events.groupBy(key).agg(
        F.max_by(status, order).alias("__status"),
        F.max_by(F.when(F.col(assignee).isNotNull(), F.col(assignee)),
                 F.when(F.col(assignee).isNotNull(), F.col(order))).alias("__assignee"),
    )
    return (
        rows.join(last, key, "left")
        .withColumns(
            {status: F.coalesce("__status", status), assignee: F.coalesce("__assignee", assignee)}
        )
        .drop("__status", "__assignee")
    )


def acknowledge(alert_rows: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Alerts with their latest acknowledgement (columns alert_id, acknowledged_by, acknowledged_at)."""
    last = latest(acknowledgements, "alert_id", ["acknowledged_at", "acknowledged_by"])
    return (
        alert_rows.drop("acknowledged_at", "acknowledged_by")
        .join(last, "alert_id", "left")
        .withColumn("acknowledged", F.col("acknowledged") | F.col("acknowledged_at").isNotNull())
    )
