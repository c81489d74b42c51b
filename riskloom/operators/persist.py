"""Changes to stored tables as table-to-table operators: upsert, replacement, audit rows, cascaded removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators import workflow as WF
from riskloom.operators.views import list_filter
from riskloom.packs import wording as W


def upsert_reports(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Stored reports after arrivals: a known id takes the new text and location only, a new id is added.

    Several arrivals of one id count as the latest one, with the rest of its row from the first.
    """
    columns = stored.columns
    rest = [c for c in columns if c not in ("report_id", "report_text", "location")]
    folded = incoming.groupBy("report_id").agg(
        F.max_by(F.struct("report_text", "location"), order).alias("last"),
        F.min_by(F.struct(*rest), order).alias("first"),
    )
    both = stored.withColumn("__stored", F.lit(True)).join(folded, "report_id", "full_outer")
    known = F.col("__stored").isNotNull()
    changed = F.col("last").isNotNull()
    return both.select(
        "report_id",
        *[
            F.when(changed, F.col("last")[c]).otherwise(F.col(c)).alias(c)
            if c in ("report_text", "location")
            else F.when(known, F.col(c)).otherwise(F.col("first")[c]).alias(c)
            for c in columns
            if c != "report_id"
        ],
    ).select(*columns)


def as_arrivals(rows: DataFrame, order: Column) -> DataFrame:
    """Reports with the places in the order of arrivals that their text and the rest of their row come from."""
    return rows.withColumns({"first_order": order.cast("long"), "last_order": order.cast("long")})


def merge_arrivals(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The same for two tables of :func:`as_arrivals`: text and location of the last arrival of an id, the rest of its row from the first.

    It does not matter which arrivals are stored already and which come in, so batches may come in any order.
    """
    rest = [c for c in stored.columns if c not in ("report_id", "report_text", "location", "first_order", "last_order")]
    folded = stored.unionByName(incoming).groupBy("report_id").agg(
        F.max_by(F.struct("report_text", "location"), "last_order").alias("last"), F.min_by(F.struct(*rest), "first_order").alias("first"),
        F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"))
    return folded.select("report_id", "last.*", *[F.col("first")[c].alias(c) for c in rest], "first_order", "last_order").select(*stored.columns)


def replace_analysis(stored: DataFrame, fresh: DataFrame, key: str = "report_id", keys: DataFrame | None = None) -> DataFrame:
    """Rows of re-analysed reports give way to the fresh rows; the rest stay.

    ``keys`` names the re-analysed reports where they are known without computing ``fresh``.
    """
    gone = (fresh if keys is None else keys).select(key).distinct()
    return stored.join(gone, key, "left_anti").unionByName(fresh)


def reanalysed(
    reports: DataFrame, keys: DataFrame, stored: Callable[[DataFrame], DataFrame], fresh: Callable[[DataFrame], DataFrame], key: str = "report_id",
) -> DataFrame:
    """Analyses of all reports, those in ``keys`` done anew. The keys decide before either analysis, so each report has one.

    The rows are dealt out after the joins: joined rows are narrow, so adaptive plans gather them into a few tasks of many reports.
    """
    gone, tasks = keys.select(key), int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept, again = (reports.join(gone, key, how).repartition(tasks) for how in ("left_anti", "left_semi"))
    return stored(kept).unionByName(fresh(again))


def remove_cohort(tables: dict[str, DataFrame], prefix: str) -> dict[str, DataFrame]:
    """Every table without the rows of the reports whose id starts with ``prefix``.

    A prefix test on each table's own report column needs no join.
    """
    def key(df: DataFrame) -> str:
        return "entity_id" if "entity_id" in df.columns else "report_id"

    return {name: df.filter(~F.coalesce(F.col(key(df)).startswith(prefix), F.lit(False))) for name, df in tables.items()}


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


AUDIT_COLUMNS = ("action", "entity_type", "entity_id", "actor_id", "details", "created_at")


def _audit(rows: DataFrame, action: str, entity_type: str, actor: Column, details: Column, at: str) -> DataFrame:
    return rows.select(
        F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"),
        F.col("report_id").alias("entity_id"), actor.alias("actor_id"), details.alias("details"),
        F.col(at).alias("created_at"),
    )


def audit_of_analysis(routed: DataFrame, actor: str = "system") -> DataFrame:
    """Audit rows that an analysis leaves: one per report, one more per alert; from one pass over the reports."""
    analysed = F.struct(
        F.lit("ANALYZE_REPORT").alias("action"),
        F.lit(actor).alias("actor_id"),
        _json(F.col("priority"), F.col("sif_probability"), F.size("matched_rules").alias("rules_fired")).alias("details"),
    )
    alerted = F.struct(
        F.lit("ALERT_TRIGGERED").alias("action"),
        F.lit(W.AUTOMATION_ACTOR).alias("actor_id"),
        _json(
            F.col("workflow_status"), F.concat(F.lit("ALT-"), "report_id").alias("alert_id"),
            F.lit(W.ALERT_TITLE).alias("alert_title"), F.col("priority"), F.col("sif_probability"),
            F.col("hazard"), F.col("barrier"), F.col("barrier_status"),
            F.transform("matched_rules", lambda r: r["rule_id"]).alias("triggered_rules"),
        ).alias("details"),
    )
    entries = F.array_compact(F.array(analysed, F.when(F.col("alert_triggered"), alerted)))
    return routed.select("report_id", "created_at", F.explode(entries).alias("a")).select(
        F.col("a.action").alias("action"), F.lit("report").alias("entity_type"),
        F.col("report_id").alias("entity_id"), F.col("a.actor_id").alias("actor_id"),
        F.col("a.details").alias("details"), "created_at",
    )


def audit_of_reviews(applied: DataFrame) -> DataFrame:
    """One row per review with the values before and after."""
    corrected = F.col("decision") == "corrected"

    def either(name: str) -> Column:
        return F.coalesce(f"corrected_{name}", f"original_{name}").alias(name)

    details = _json(
        F.col("decision"), F.col("reviewer_id"),
        F.struct(
            *[F.col(f"original_{n}").alias(n) for n in ("priority", "activity", "hazard", "barrier", "sif_probability")]
        ).alias("original_ai_output"),
        F.struct(F.col("final_priority").alias("priority"), either("activity"), either("hazard"), either("barrier")).alias("final_determination"),
        F.when(
            corrected,
            F.struct(
                F.col("final_priority").alias("priority"),
                *[F.col(f"corrected_{n}").alias(n) for n in ("activity", "hazard", "barrier")],
            ),
        ).alias("corrected_values"),
        F.col("comments"),
    )
    return _audit(applied, "HSE_REVIEW", "hse_review", F.col("reviewer_id"), details, "reviewed_at")


def audit_of_transitions(resolved: DataFrame) -> DataFrame:
    """One row per reviewed report with the true state before and the state after."""
    done = resolved.filter(F.col("decision").isNotNull())
    details = _json(
        F.col("previous_status"), F.col("workflow_status").alias("new_status"), F.upper("decision").alias("decision"),
        F.col("reviewer_id"), F.coalesce("comments", F.lit("")).alias("comments"),
    )
    return _audit(done, "WORKFLOW_TRANSITION", "report", F.col("reviewer_id"), details, "reviewed_at")


def audit_of_feedback(feedback: DataFrame) -> DataFrame:
    details = _json(F.col("feedback_type"), F.col("user_suggested_priority"), F.col("notes"))
    return _audit(feedback, "FEEDBACK_SUBMITTED", "feedback",
                  F.coalesce("user_id", F.lit("anonymous_hse_user")), details, "created_at")


def audit_of_imports(imported: DataFrame) -> DataFrame:
    """One row per imported document whose extracted or corrected values were kept (two struct columns)."""
    details = _json(F.col("file_uploaded"), F.col("original_extracted"), F.col("user_corrected"))
    return _audit(imported, "IMPORT_CORRECTION", "report", F.lit("importer"), details, "created_at")


def audit_log(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*AUDIT_COLUMNS)


def export_register(
    summary: DataFrame, limit: int | None = None, priority: str | None = None, hazard: str | None = None, activity: str | None = None,
) -> DataFrame:
    """The sixteen-column register: final value, else AI value, else empty; filtered as the list view, newest first when limited.

    No cap by default: the caller may ask for the usual 1,000 or 10,000 rows.
    """
    rows = list_filter(summary, priority, hazard, activity)
    if limit is not None:
        rows = rows.orderBy(F.desc("created_at"), F.desc("priority_score"), F.asc("report_id")).limit(limit)

    def text(*columns: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))

    return rows.select(
        "report_id",
        F.coalesce(F.nullif("source_file_name", F.lit("")), F.lit("N/A")).alias("source_file"),
        F.coalesce("report_type", F.lit("near_miss")).alias("report_type"),
        F.coalesce("location", F.lit("Unknown")).alias("location"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"),
        text("final_activity", "ai_activity").alias("activity"),
        text("final_hazard", "ai_hazard").alias("hazard"),
        text("final_barrier", "ai_barrier").alias("barrier"),
        text("barrier_status").alias("barrier_status"),
        F.coalesce("final_priority", "ai_priority").alias("priority"),
        "priority_score",
        "sif_probability",
        F.concat(F.col("triggered_rules_count").cast("string"), F.lit(" rules")).alias("triggered_rules"),
        "hse_reviewed",
        text("review_decision").alias("hse_decision"),
        text("workflow_status").alias("workflow_status"),
    )
