"""The workflow of every report as one table that a stream of events keeps up to date: analyses, reviews, acknowledgements, changes of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskloom.functions import text as tx
from riskloom.operators import workflow as WF
from riskloom.sources.readers import check_reviews
from riskloom.streaming.keyed_table import KeyedTable

#: What is known of a report: the last of each kind of event, by the fields that come first in it. An event is a case with one of them.
PARTS = {
    "report": "struct<analysed_at timestamp, report_text string, created_at timestamp, priority string, sif_probability double, activity string, hazard string, barrier string, barrier_status string, location string>",
    "review": "struct<reviewed_at timestamp, reviewer_id string, decision string, corrected_priority string, corrected_activity string, corrected_hazard string, corrected_barrier string, comments string>",
    "acknowledgement": "struct<acknowledged_at timestamp, acknowledged_by string>",
    "state": "struct<seq bigint, status string>",
    "assignment": "struct<seq bigint, assigned_to string>",
}
CASE = "report_id string, " + ", ".join(f"{name} {shape}" for name, shape in PARTS.items())
EVENT = f"kind string, {CASE}"
KINDS = ("analysis", "review", "acknowledgement", "action")
_REJECT = "reject_id string, kind string, report_id string, event string, violations array<string>"


def _event(rows: DataFrame, kind: str, report_id: Column, **parts: Column) -> DataFrame:
    filled = [parts[n].cast(t).alias(n) if n in parts else F.lit(None).cast(t).alias(n) for n, t in PARTS.items()]
    return rows.select(F.lit(kind).alias("kind"), report_id.alias("report_id"), *filled)


def _packed(part: str, **renamed: str) -> Column:
    fields = StructType.fromDDL(f"p {PARTS[part]}")["p"].dataType.names
    return F.struct(*[F.col(renamed.get(f, f)).alias(f) for f in fields])


def analysis_events(decided: DataFrame, at: str = "created_at") -> DataFrame:
    """An event per analysed report; of several analyses of a report the last by ``at`` counts."""
    return _event(decided, "analysis", F.col("report_id"), report=_packed("report", analysed_at=at))


def review_events(reviews: DataFrame) -> DataFrame:
    return _event(reviews, "review", F.col("report_id"), review=_packed("review"))


def _named_by(column: str, prefix: str) -> Column:
    """The report that the id of an alert or action is made from; null for other ids."""
    return F.when(F.col(column).startswith(prefix), F.substring(column, len(prefix) + 1, 2**31 - 1))


def acknowledgement_events(rows: DataFrame) -> DataFrame:
    """From alert_id, acknowledged_at, acknowledged_by."""
    return _event(rows, "acknowledgement", _named_by("alert_id", "ALT-"), acknowledgement=_packed("acknowledgement"))


def action_events(rows: DataFrame) -> DataFrame:
    """From action_id, seq, status, assigned_to; a null in one of the last two leaves it as it was."""
    state = F.when(F.col("status").isNotNull(), _packed("state"))
    return _event(rows, "action", _named_by("action_id", "ACT-"), state=state, assignment=F.when(F.col("assigned_to").isNotNull(), _packed("assignment")))


def checked(events: DataFrame) -> DataFrame:
    """Events with the names of the rules they break: no report, an unknown kind, nothing in it, or a review beyond its limits."""
    fields = events.select("*", "review.reviewer_id", "review.decision", "review.comments")
    of_review = check_reviews(fields).drop("reviewer_id", "decision", "comments")
    empty = ~F.greatest(*[F.col(p).isNotNull() for p in PARTS])
    own = F.array_compact(F.array(
        F.when(tx.non_empty(F.col("report_id")).isNull(), "report_id"),
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
        F.when(empty, "event"),
    ))
    return of_review.withColumn("violations", F.concat(own, F.when(F.col("review").isNotNull(), F.col("violations")).otherwise(F.array().cast("array<string>"))))


def fold(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cases of both. The last event of each kind is a maximum, so neither order nor repeats of events matter, and the state of a report is one row."""
    both = stored.unionByName(incoming)
    return both.groupBy("report_id").agg(*[F.max(p).alias(p) for p in PARTS])


class WorkflowTables:
    """Cases by report, and events that broke a rule, under a path.

    Events may come in any order, in any batches and more than once: what is read depends on the set of events only. An event whose
    report, alert or action does not exist yet is kept and counts as soon as it does; until then it is among :meth:`unapplied`. A case holds the
    last event of each kind and no history (the audit has that), so its size is fixed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        path = path.rstrip("/")
        self.cases = KeyedTable(spark, f"{path}/cases", StructType.fromDDL(CASE), ["report_id"], buckets)
        self.rejected = KeyedTable(spark, f"{path}/rejected", StructType.fromDDL(_REJECT), ["reject_id"], buckets)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rows = checked(batch.select(*StructType.fromDDL(EVENT).names))
        text = F.to_json(F.struct(*StructType.fromDDL(EVENT).names))
        bad = rows.filter(F.size("violations") > 0).select(F.sha2(text, 256).alias("reject_id"), "kind", "report_id", text.alias("event"), "violations")
        self.rejected.apply(batch_id, bad.dropDuplicates(["reject_id"]), lambda old, new: old.unionByName(new).dropDuplicates(["reject_id"]))
        self.cases.apply(batch_id, rows.filter(F.size("violations") == 0).select(*self.cases.schema.names), fold)

    # ------------------------------------------------------------------ reading: each is one scan without a shuffle

    def reports(self) -> DataFrame:
        """Analysed reports with their state after the last review, as :func:`riskloom.operators.workflow.resolve` gives it."""
        known = self.cases.read().filter("report is not null")
        routed = WF.route(known.select("report_id", "report.*", "review.*", "acknowledgement", "state", "assignment"))
        return WF.after_review(routed)

    def alerts(self) -> DataFrame:
        """Alerts, closed by a review or an acknowledgement."""
        known = self.cases.read().filter("report is not null").select("report_id", "report.*", "review.decision", "acknowledgement")
        raised = WF.alerts_after_review(WF.alerts(WF.route(known), keep=("decision", "acknowledgement"))).drop("acknowledged_at", "acknowledged_by", "decision")
        return raised.select("*", "acknowledgement.*").withColumn("acknowledged", F.col("acknowledged") | F.col("acknowledged_at").isNotNull()).drop("acknowledgement")

    def actions(self) -> DataFrame:
        """Actions with their last status and assignee."""
        opened = WF.actions(self.reports(), keep=("state", "assignment"))
        last = {"status": F.coalesce("state.status", "status"), "assigned_to": F.coalesce("assignment.assigned_to", "assigned_to")}
        return opened.withColumns(last).drop("state", "assignment")

    def unapplied(self) -> DataFrame:
        """(report_id, kind): reviews without a report, acknowledgements without an alert, changes without an action; the last of a kind."""
        rows = self.cases.read()
        routed = WF.after_review(WF.route(rows.select("report_id", "report.*", "review.*", *[F.col(p).alias(f"_{p}") for p in PARTS])))
        left = {
            "review": F.col("_review").isNotNull() & F.col("_report").isNull(),
            "acknowledgement": F.col("_acknowledgement").isNotNull() & ~F.coalesce(F.col("alert_triggered"), F.lit(False)),
            "action": (F.col("_state").isNotNull() | F.col("_assignment").isNotNull()) & ~F.coalesce(WF.action_due() & F.col("_report").isNotNull(), F.lit(False)),
        }
        kinds = F.array_compact(F.array(*[F.when(c, k) for k, c in left.items()]))
        return routed.select("report_id", F.explode(kinds).alias("kind"))

    def rejects(self) -> DataFrame:
        """Events that broke a rule, as JSON, with the rules."""
        return self.rejected.read()


def start_workflow(stream: DataFrame, tables: WorkflowTables, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep :class:`WorkflowTables` up to date from a stream of events with the columns of :data:`EVENT`."""
    writer = stream.writeStream.foreachBatch(tables.write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
