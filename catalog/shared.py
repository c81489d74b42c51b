"""Plans that many queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.lineage import stored
from riskloom.operators import views as V
from riskloom.operators import workflow as WF
from riskloom.plans import corpus as C
from riskloom.plans.triage import triage
from riskloom.sources.readers import resolve_location


def decided(spark: SparkSession, folder: str, explained: bool = False, report_id: str | None = None, **options) -> DataFrame:
    """Triage of all reports, or of the one of an id, which is looked up before the triage."""
    return triage(C.reports(spark, folder, report_id), explained=explained, **options)


def routed(spark: SparkSession, folder: str, explained: bool = False, report_id: str | None = None) -> DataFrame:
    out = WF.route(decided(spark, folder, explained, report_id))
    return out.withColumn("location", resolve_location(F.lit(None).cast("string"), F.col("extracted_location")))


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    return WF.resolve(routed(spark, folder), C.reviews(spark, folder))


def summary(spark: SparkSession, folder: str, explained: bool = False, report_id: str | None = None) -> DataFrame:
    return V.summary(routed(spark, folder, explained, report_id), C.reviews(spark, folder, report_id))


#: What the workflow needs of a triaged report: written once where several steps read it.
_WORKFLOW = (
    "report_id", "report_text", "created_at", "priority", "sif_probability", "matched_rules", "activity", "hazard", "barrier",
    "barrier_status", "workflow_status", "in_review_queue", "queue_entered_at", "alert_triggered",
)


def routed_once(spark: SparkSession, folder: str, report_id: str | None = None) -> DataFrame:
    return stored(routed(spark, folder, report_id=report_id).select(*_WORKFLOW))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return WF.resolve_alerts(WF.alerts(routed(spark, folder)), C.reviews(spark, folder))


def actions(spark: SparkSession, folder: str) -> DataFrame:
    return WF.actions(resolved(spark, folder))


def joined(column: str | Column, by: str = "; ") -> Column:
    """An array as text, so that results compare value by value."""
    return F.array_join(column, by)


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
