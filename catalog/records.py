"""Workflow, alerts, actions, audit, stored-table changes and intake."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog import query
from catalog import shared as S
from oracles.base import FALLBACK, pick, q, say, scored as scored_sql, sql
from riskloom.functions.lineage import scratch, stored
from riskloom.operators import dashboard as D
from riskloom.operators import persist as P
from riskloom.operators import views as V
from riskloom.operators import workflow as WF
from riskloom.packs import wording as W
from riskloom.plans import corpus as C
from riskloom.plans.triage import triage
from riskloom.sources import readers as RD
from riskloom.streaming import workflow_stream as WS

_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("workflow_routing", sql(f"""
select report_id, priority, status0 as workflow_status, priority = 'HIGH' as in_review_queue,
  case when priority = 'HIGH' then {_TIME.format('created_at')} end as queue_entered_at from routed"""))
def workflow_routing(spark, folder):
    rows = S.routed(spark, folder)
    return rows.select("report_id", "priority", "workflow_status", "in_review_queue", S.stamp("queue_entered_at").alias("queue_entered_at"))


_ALERT_SQL = f"alert_id, report_id, title, severity, message, {_TIME.format('created_at')} as created_at"


@query("alerts_raised", sql(f"select {_ALERT_SQL} from alerts"))
def alerts_raised(spark, folder):
    rows = WF.alerts(S.routed(spark, folder))
    return rows.select("alert_id", "report_id", "title", "severity", "message", S.stamp("created_at").alias("created_at"))


@query("alerts_open", sql("select alert_id, report_id, workflow_status from alerts where not acknowledged"))
def alerts_open(spark, folder):
    return S.alerts(spark, folder).filter(~F.col("acknowledged")).select("alert_id", "report_id", "workflow_status")


@query("alerts_latest", sql(f"select {_ALERT_SQL} from alerts where not acknowledged order by alerts.created_at desc, alert_id limit 50"))
def alerts_latest(spark, folder):
    rows = V.newest(S.alerts(spark, folder).filter(~F.col("acknowledged")), "alert_id", 50)
    return rows.select("alert_id", "report_id", "title", "severity", "message", S.stamp("created_at").alias("created_at"))


@query("alert_summary", sql("""
select count(*) as total_alerts, count(*) filter (not acknowledged) as unacknowledged,
  count(*) filter (acknowledged) as acknowledged_alerts from alerts"""))
def alert_summary(spark, folder):
    return D.alert_totals(S.alerts(spark, folder))


@query("alert_overview", sql("""
select count(*) as total_alerts, count(*) filter (not acknowledged) as unacknowledged, count(*) filter (acknowledged) as acknowledged_alerts,
  (select string_agg(alert_id, '; ' order by created_at desc, alert_id) from (select * from alerts where not acknowledged order by created_at desc, alert_id limit 5)) as latest
from alerts"""))
def alert_overview(spark, folder):
    """Totals and the five newest open alerts; the alerts are written once."""
    return D.alert_overview(stored(S.alerts(spark, folder))).withColumn("latest", S.joined("latest"))


_ACKNOWLEDGED = sql("""
select alert_id, acknowledged or a.at_step is not null as acknowledged, a.by_whom as acknowledged_by from alerts
left join (select 'ALT-REP-' || user_id::varchar as alert_id, max(event_id) as at_step,
    'HSE-' || (max(event_id) % 20)::varchar as by_whom from events where event_type = 'error' group by 1) a using (alert_id)""")


def _acknowledgements(spark, folder):
    return C.table(spark, folder, "events").filter(F.col("event_type") == "error").select(
        F.concat(F.lit("ALT-REP-"), F.col("user_id").cast("string")).alias("alert_id"),
        F.concat(F.lit("HSE-"), (F.col("event_id") % 20).cast("string")).alias("acknowledged_by"),
        F.col("ts").alias("acknowledged_at"),
    )


@query("alert_ack", _ACKNOWLEDGED)
def alert_ack(spark, folder):
    return WF.acknowledge(S.alerts(spark, folder), _acknowledgements(spark, folder)).select("alert_id", "acknowledged", "acknowledged_by")


_RESOLVED = sql("""
select report_id, status0 as previous_status, workflow_status, priority = 'HIGH' and decision is null as in_review_queue, final_priority from resolved""")


@query("workflow_resolved", _RESOLVED)
def workflow_resolved(spark, folder):
    return S.resolved(spark, folder).select("report_id", "previous_status", "workflow_status", "in_review_queue", "final_priority")


@query("workflow_status", sql(f"""
select report_id, final_priority as priority, workflow_status, {pick('workflow_status', W.BADGES)} as display_badge,
  coalesce(a.n, 0) as alerts, 1 + (priority = 'HIGH')::bigint as audit_entries
from resolved left join (select report_id, count(*) as n from alerts group by 1) a
using (report_id)"""))
def workflow_status(spark, folder):
    routed, reviews = S.routed_once(spark, folder), C.reviews(spark, folder)
    alerts = WF.resolve_alerts(WF.alerts(routed), reviews)
    return V.workflow_status(WF.resolve(routed, reviews), alerts, P.audit_of_analysis(routed)).drop("in_review_queue")


@query("actions_created", sql("select action_id, report_id, title, priority, status, site_location from actions"))
def actions_created(spark, folder):
    return S.actions(spark, folder).select("action_id", "report_id", "title", "priority", "status", "site_location")


_ACTION_STATE = sql("""
select action_id, coalesce(e.status, a.status) as status, e.assigned_to as assigned_to from actions a left join (
  select action_id, arg_max(status, seq) as status, arg_max(assigned_to, seq) filter (assigned_to is not null) as assigned_to
  from action_events group by 1) e using (action_id)""")


@query("action_state", _ACTION_STATE)
def action_state(spark, folder):
    rows = WF.current_state(S.actions(spark, folder), C.action_events(spark, folder), "action_id", "seq", "status", "assigned_to")
    return rows.select("action_id", "status", "assigned_to")


@query("actions_list", sql("""
select action_id, status, priority, site_location from actions where lower(status) = 'open' and priority = 'HIGH'"""))
def actions_list(spark, folder):
    rows = V.actions_list(S.actions(spark, folder), "OPEN", "HIGH")
    return rows.select("action_id", "status", "priority", "site_location")


# ------------------------------------------------------------------ the same from a stream of events

_GROUPS = 3
_ANALYSED = ("report_id", "report_text", "created_at", "priority", "sif_probability", "activity", "hazard", "barrier", "barrier_status", "location")


def _workflow(spark, folder):
    """The tables of a stream in which the events of all kinds come in three groups, those of one report in any of them."""
    base, schema = scratch(spark), StructType.fromDDL(WS.EVENT)
    # Written as it is, so that the columns of the events do not repeat the triage.
    analysed = stored(S.routed(spark, folder).select(*_ANALYSED))
    kinds = (
        WS.analysis_events(analysed), WS.review_events(C.reviews(spark, folder)),
        WS.acknowledgement_events(_acknowledgements(spark, folder)), WS.action_events(C.action_events(spark, folder)),
    )
    events = kinds[0]
    for more in kinds[1:]:
        events = events.unionByName(more)
    landed, tables = stored(events.withColumn("landing", F.pmod(F.xxhash64(*schema.names), F.lit(_GROUPS)))), WS.WorkflowTables(spark, f"{base}/tables", 16)
    for group in range(_GROUPS):
        landed.filter(F.col("landing") == group).drop("landing").write.mode("append").parquet(f"{base}/in")
        WS.start_workflow(spark.readStream.schema(schema).parquet(f"{base}/in"), tables, f"{base}/progress", once=True).awaitTermination()
    return tables


@query("stream_workflow", _RESOLVED)
def stream_workflow(spark, folder):
    return _workflow(spark, folder).reports().select("report_id", "previous_status", "workflow_status", "in_review_queue", "final_priority")


@query("stream_alert_ack", _ACKNOWLEDGED)
def stream_alert_ack(spark, folder):
    return _workflow(spark, folder).alerts().select("alert_id", "acknowledged", "acknowledged_by")


@query("stream_action_state", _ACTION_STATE)
def stream_action_state(spark, folder):
    return _workflow(spark, folder).actions().select("action_id", "status", "assigned_to")


@query("stream_unapplied", sql("""
select distinct report_id, 'review' as kind from reviews where report_id not in (select report_id from reports)
union all select distinct 'REP-' || user_id::varchar, 'acknowledgement' from events where event_type = 'error' and 'ALT-REP-' || user_id::varchar not in (select alert_id from alerts)
union all select distinct substring(action_id, 5), 'action' from action_events where action_id not in (select action_id from actions)"""))
def stream_unapplied(spark, folder):
    """Events without the report, alert or action that they are about, once a kind and report."""
    return _workflow(spark, folder).unapplied()


_FINAL = """case when v.decision = 'rejected' then 'LOW' when v.decision = 'corrected' then coalesce(v.corrected_priority, d.priority) else d.priority end"""


@query("apply_review", sql(f"""
select report_id, reviewer_id, v.decision as decision, d.priority as original_priority, d.activity as original_activity,
  d.sif_probability as original_sif_probability, {_FINAL} as final_priority, {_TIME.format('reviewed_at')} as reviewed_at
from reviews v join decided d using (report_id)"""))
def apply_review(spark, folder):
    rows = WF.apply_reviews(S.decided(spark, folder), C.reviews(spark, folder))
    return rows.select("report_id", "reviewer_id", "decision", "original_priority", "original_activity", "original_sif_probability",
                       "final_priority", S.stamp("reviewed_at").alias("reviewed_at"))


@query("orphan_reviews", sql("""
select 'review' as kind, report_id || '-X' as report_id, reviewed_at::date::varchar as day from reviews where reviewer_id = 'HSE-3'
union all select 'feedback', report_id, created_at::date::varchar from feedback where report_id not in (select report_id from reports)"""))
def orphan_reviews(spark, folder):
    reports = C.reports(spark, folder)
    strayed = C.reviews(spark, folder).withColumn("report_id", F.when(
        F.col("reviewer_id") == "HSE-3", F.concat("report_id", F.lit("-X"))).otherwise(F.col("report_id")))
    reviews = WF.orphans(strayed, reports).select(
        F.lit("review").alias("kind"), "report_id", F.date_format("reviewed_at", "yyyy-MM-dd").alias("day"))
    feedback = WF.orphans(C.feedback(spark, folder), reports).select(
        F.lit("feedback").alias("kind"), "report_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    return reviews.unionByName(feedback)


@query("feedback_list", sql(f"""
select feedback_id, report_id, user_id, feedback_type, user_suggested_priority, notes from feedback order by created_at desc, feedback_id limit 50"""))
def feedback_list(spark, folder):
    rows = V.newest(C.feedback(spark, folder), "feedback_id", 50)
    return rows.select("feedback_id", "report_id", "user_id", "feedback_type", "user_suggested_priority", "notes")


# ------------------------------------------------------------------ audit


def _audit(spark, folder, report_id=None):
    """Entries of all kinds, or those of one report; the triage is written once for the three that read it."""
    routed = S.routed_once(spark, folder, report_id)
    reviews = C.reviews(spark, folder, report_id)
    return P.audit_log(
        P.audit_of_analysis(routed),
        P.audit_of_reviews(WF.apply_reviews(routed, reviews)),
        P.audit_of_transitions(WF.resolve(routed, reviews)),
        P.audit_of_feedback(C.feedback(spark, folder, report_id)),
        P.audit_of_imports(_imports(spark, folder)),
    )


def _imports(spark, folder):
    """Each document as an imported file with its detected and its corrected language."""
    return C.table(spark, folder, "documents").select(
        F.concat(F.lit("IMP-"), F.col("doc_id").cast("string")).alias("report_id"),
        F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_uploaded"),
        F.struct("lang").alias("original_extracted"), F.struct("lang", "source").alias("user_corrected"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


_AUDIT = {
    "review_facts": f"select v.*, d.priority as p0, d.activity as a0, d.hazard as h0, d.barrier as b0, d.sif_probability as s0, {_FINAL} as p1 from reviews v join decided d using (report_id)",
    "audit": f"""
select 'ANALYZE_REPORT' as action, 'report' as entity_type, report_id as entity_id, 'system' as actor_id,
  to_json({{'priority': priority, 'sif_probability': sif_probability, 'rules_fired': n_rules}})::varchar as details, created_at from decided
union all
select 'ALERT_TRIGGERED', 'report', report_id, {q(W.AUTOMATION_ACTOR)}, to_json({{'workflow_status': status0, 'alert_id': 'ALT-' || report_id,
  'alert_title': {q(W.ALERT_TITLE)}, 'priority': priority, 'sif_probability': sif_probability, 'hazard': hazard, 'barrier': barrier,
  'barrier_status': barrier_status, 'triggered_rules': case when rule_ids is null then [] else string_split(rule_ids, '; ') end}})::varchar, created_at
from routed where priority = 'HIGH'
union all
select 'HSE_REVIEW', 'hse_review', report_id, reviewer_id, to_json({{'decision': decision, 'reviewer_id': reviewer_id,
  'original_ai_output': {{'priority': p0, 'activity': a0, 'hazard': h0, 'barrier': b0, 'sif_probability': s0}},
  'final_determination': {{'priority': p1, 'activity': coalesce(corrected_activity, a0), 'hazard': coalesce(corrected_hazard, h0),
    'barrier': coalesce(corrected_barrier, b0)}},
  'corrected_values': case when decision = 'corrected' then {{'priority': p1, 'activity': corrected_activity, 'hazard': corrected_hazard,
    'barrier': corrected_barrier}} end, 'comments': comments}})::varchar, reviewed_at from review_facts
union all
select 'WORKFLOW_TRANSITION', 'report', report_id, reviewer_id, to_json({{'previous_status': status0, 'new_status': workflow_status,
  'decision': upper(decision), 'reviewer_id': reviewer_id, 'comments': coalesce(comments, '')}})::varchar, reviewed_at from resolved where decision is not null
union all
select 'FEEDBACK_SUBMITTED', 'feedback', report_id, coalesce(user_id, 'anonymous_hse_user'), to_json({{'feedback_type': feedback_type,
  'user_suggested_priority': user_suggested_priority, 'notes': notes}})::varchar, created_at from feedback
union all
select 'IMPORT_CORRECTION', 'report', 'IMP-' || doc_id::varchar, 'importer', to_json({{'file_uploaded': 'file ' || doc_id::varchar || '.txt',
  'original_extracted': {{'lang': lang}}, 'user_corrected': {{'lang': lang, 'source': source}}}})::varchar, timestamp '2024-01-01 00:00:00' from documents""",
}


@query("audit_log", sql(f"select action, entity_type, entity_id, actor_id, details, {_TIME.format('created_at')} as created_at from audit", _AUDIT))
def audit_log(spark, folder):
    return _audit(spark, folder).withColumn("created_at", S.stamp("created_at"))


@query("audit_trail", sql(f"select action, actor_id, {_TIME.format('created_at')} as created_at from audit where entity_id = 'REP-100'", _AUDIT))
def audit_trail(spark, folder):
    """One report's trail, oldest first; the id is looked up in the scans of orders and events, before any triage."""
    rows = _audit(spark, folder, "REP-100").filter(F.col("entity_id") == "REP-100").orderBy("created_at", "action")
    return rows.select("action", "actor_id", S.stamp("created_at").alias("created_at"))


@query("json_roundtrip", sql("select entity_id, (details->>'priority') as priority, (details->>'rules_fired')::int as rules_fired from audit where action = 'ANALYZE_REPORT'", _AUDIT))
def json_roundtrip(spark, folder):
    rows = P.audit_of_analysis(S.routed(spark, folder)).filter(F.col("action") == "ANALYZE_REPORT")
    parsed = F.from_json("details", "priority string, sif_probability double, rules_fired int")
    return rows.select("entity_id", parsed.alias("d")).select("entity_id", "d.priority", "d.rules_fired")


# ------------------------------------------------------------------ stored tables


UPSERTED = sql("""
select coalesce(r.report_id, a.report_id) as report_id, coalesce(a.report_text, r.report_text) as report_text,
  coalesce(a.location, 'Unknown') as location, 'near_miss' as report_type,
  strftime(coalesce(r.created_at, a.created_at), '%Y-%m-%d') as day
from reports r full join last_arrival a on a.report_id = r.report_id""", {"last_arrival": """
select report_id, arg_max(report_text, seq) as report_text, arg_max(location, seq) as location,
  arg_min(created_at, seq) as created_at from arrivals group by 1"""})


@query("upsert_reports", UPSERTED)
def upsert_reports(spark, folder):
    stored = C.reports(spark, folder).withColumn("location", F.lit("Unknown")).select("report_id", "report_text", "location", "report_type", "created_at")
    rows = P.upsert_reports(stored, C.arrivals(spark, folder), "seq")
    return rows.select("report_id", "report_text", "location", "report_type", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("replace_analysis", sql("""
select report_id, priority, priority_score from decided where report_id not in (select report_id from reviews)
union all select report_id, priority, priority_score from again where report_id in (select report_id from reviews)""",
    {"again": scored_sql("select * from reports join context on t = report_text join rollup using (t)", FALLBACK, "1.0::double")}))
def replace_analysis(spark, folder):
    """Reviewed reports are analysed again with a recurrence signal."""
    again = C.reviews(spark, folder).select("report_id").distinct()
    return P.reanalysed(
        C.reports(spark, folder), again,
        stored=lambda rows: triage(rows, explained=False).select("report_id", "priority", "priority_score"),
        fresh=lambda rows: triage(rows, recurrence=F.lit(1.0), explained=False).select("report_id", "priority", "priority_score"),
    )


@query("purge_cohort", sql(" union all ".join(
    f"select '{t}' as table_name, count(*) as rows from {t} where not starts_with(report_id, 'REP-1')" for t in ("reports", "reviews", "feedback", "decided"))))
def purge_cohort(spark, folder):
    tables = {"reports": C.reports(spark, folder), "reviews": C.reviews(spark, folder), "feedback": C.feedback(spark, folder),
              "decided": S.decided(spark, folder)}
    left = P.remove_cohort(tables, "REP-1")
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# ------------------------------------------------------------------ intake


def _intake(spark, folder):
    """Documents as arriving reports of every length; some with long ids and places, or a signal out of range."""
    return C.table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 11 == 0, F.repeat(F.lit("x"), 51)).otherwise(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"))).alias("report_id"),
        F.col("doc_id"), F.col("text").alias("report_text"),
        F.when(F.col("doc_id") % 13 == 0, F.repeat(F.lit("y"), 101)).otherwise(F.col("lang")).alias("location"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7 / 5.0).alias("recurring_risk_signal"),
    )


_INTAKE = {"checked": """
select doc_id, list_filter([case when length(text) not between 10 and 10000 then 'report_text' end,
  case when doc_id % 11 = 0 then 'report_id' end, case when doc_id % 13 = 0 then 'location' end,
  case when doc_id % 3 != 0 and (doc_id % 7) / 5.0::double not between 0 and 1 then 'recurring_risk_signal' end], lambda x: x is not null) as v
from documents"""}


@query("validate_intake", sql("select doc_id, array_to_string(v, '; ') as violations from checked", _INTAKE))
def validate_intake(spark, folder):
    return RD.check_reports(_intake(spark, folder)).select("doc_id", S.joined("violations").alias("violations"))


@query("bulk_outcome", sql("""
select count(*) filter (len(v) = 0) as processed_count, count(*) filter (len(v) > 0) as error_count,
  case when count(*) filter (len(v) > 0) > 0 and count(*) filter (len(v) = 0) > 0 then 'partial'
    when count(*) filter (len(v) = 0) > 0 then 'success' else 'error' end as status from checked""", _INTAKE))
def bulk_outcome(spark, folder):
    return RD.bulk_outcome(RD.check_reports(_intake(spark, folder)))


_CHECKED_REVIEWS = """
select report_id, strftime(reviewed_at, '%Y-%m-%d') as day, array_to_string(list_filter([
  case when reviewer_id = 'HSE-9' then 'reviewer_id' end, case when reviewer_id = 'HSE-7' then 'decision' end,
  case when reviewer_id = 'HSE-5' then 'comments' end], lambda x: x is not null), '; ') as violations from reviews"""


@query("check_reviews", sql(_CHECKED_REVIEWS))
def check_reviews(spark, folder):
    """Reviews of which one reviewer's have no name, one's an unknown decision, one's endless comments."""
    who = F.col("reviewer_id")
    rows = C.reviews(spark, folder).select(
        "report_id", "reviewed_at", F.when(who == "HSE-7", "perhaps").otherwise(F.col("decision")).alias("decision"),
        F.when(who == "HSE-5", F.repeat(F.lit("x"), 2001)).otherwise(F.col("comments")).alias("comments"),
        F.when(who == "HSE-9", "x").otherwise(who).alias("reviewer_id"))
    return RD.check_reviews(rows).select("report_id", F.date_format("reviewed_at", "yyyy-MM-dd").alias("day"), S.joined("violations").alias("violations"))


@query("check_feedback", sql("""
select feedback_id, case when feedback_type = 'false_positive' or coalesce(length(notes), 0) not between 2 and 2000 then 'notes' else '' end as violations from feedback"""))
def check_feedback(spark, folder):
    """Feedback with its notes; false positives come with a single letter."""
    rows = C.feedback(spark, folder).withColumn("notes", F.when(F.col("feedback_type") == "false_positive", "x").otherwise(F.col("notes")))
    return RD.check_feedback(rows).select("feedback_id", S.joined("violations").alias("violations"))


@query("import_extracted", sql("""
select 'REP-' || pos::varchar || '.txt' as file, activity, hazard, barrier, barrier_status, null::varchar as error from decided where regexp_matches(report_text, '\\S')
union all select 'REP-' || pos::varchar || '.txt', null, null, null, null, 'no text' from reports where not regexp_matches(report_text, '\\S')"""))
def import_extracted(spark, folder):
    """Reports as text files, read as documents: their extracted fields, and the files without text as rejects.

    Each distinct text is one file, for small files cost more than the work on them; its outcome goes to all reports of that text.
    """
    path, key = f"{scratch(spark)}/files", F.concat(F.lit("t"), F.sha2("report_text", 256)).alias("text_key")
    named = stored(C.reports(spark, folder).select("report_id", "report_text", key))
    named.groupBy("text_key").agg(F.first("report_text").alias("value")).write.partitionBy("text_key").option("lineSep", "\n").text(path)
    documents, rejects = RD.read_documents(spark, f"{path}/*/*.txt", name=F.concat(F.regexp_extract("path", "text_key=([^/]*)", 1), F.lit(".txt")))
    fields = ("activity", "hazard", "barrier", "barrier_status")
    good = triage(documents, explained=False).select("source_file_name", *fields, F.lit(None).cast("string").alias("error"))
    bad = rejects.select("source_file_name", *[F.lit(None).cast("string").alias(f) for f in fields], "error")
    of_text = good.unionByName(bad).withColumn("text_key", F.regexp_replace("source_file_name", r"\.txt$", ""))
    files = named.select(F.concat("report_id", F.lit(".txt")).alias("file"), "text_key")
    return files.join(of_text, "text_key").select("file", *fields, "error")


@query("location_resolved", sql("""
select report_id, case when pos % 3 = 0 then 'Unit ' || (pos % 9)::varchar else coalesce(location, 'Unknown') end as location from decided"""))
def location_resolved(spark, folder):
    given = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Unit "), (F.col("pos") % 9).cast("string"))).when(F.col("pos") % 3 == 1, "")
    return S.decided(spark, folder).select("report_id", RD.resolve_location(given, F.col("extracted_location")).alias("location"))


_NAMED = """case p_partkey % 6 when 0 then '.PDF' when 1 then '.docx' when 2 then '.txt' when 3 then '.csv' when 4 then '.zip' else '' end"""


def _files(spark, folder):
    ending = F.get(F.array(*[F.lit(e) for e in (".PDF", ".docx", ".txt", ".csv", ".zip", "")]), (F.col("p_partkey") % 6).cast("int"))
    return C.table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("in/box/"), "p_name", F.lit("#"), F.col("p_partkey").cast("string"), ending).alias("name"),
        F.when(F.col("p_size") % 10 == 0, "text/csv").otherwise("application/octet-stream").alias("mime"),
    )


@query("route_formats", f"""
select p_partkey, format, format in ('csv', 'xlsx') as is_tabular,
  case when format is null then 'Unsupported file type: in/box/' || p_name || '#' || p_partkey::varchar || {_NAMED} || ' (application/octet-stream)' end as error
from (select *, case when p_size % 10 = 0 then 'csv' else case p_partkey % 6 when 0 then 'pdf' when 1 then 'docx' when 2 then 'txt'
  when 3 then 'csv' end end as format from part)""")
def route_formats(spark, folder):
    return RD.route_formats(_files(spark, folder)).select("p_partkey", "format", "is_tabular", "error")


@query("clean_names", f"select p_partkey, trim(regexp_replace(p_name || '#' || p_partkey::varchar || {_NAMED}, '[^\\p{{L}}\\p{{N}} ._-]', '', 'g')) as file_name from part")
def clean_names(spark, folder):
    return _files(spark, folder).select("p_partkey", RD.clean_name(F.col("name")).alias("file_name"))
