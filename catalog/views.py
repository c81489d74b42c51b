"""Lists, filters, pages, single-report views and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import shared as S
from oracles.base import q, say, sql
from riskloom.operators import dashboard as D
from riskloom.operators import persist as P
from riskloom.functions.lineage import scratch
from riskloom.operators import views as V
from riskloom.operators import workflow as WF
from riskloom.packs import wording as W
from riskloom.plans import corpus as C
from riskloom.sources import writers as WR

_LIST = ("report_id", "created_at", "priority_score", "final_priority", "final_hazard", "final_activity")
_LIST_SQL = ("report_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, priority_score, final_priority, "
             "final_hazard, final_activity")


def _listed(rows):
    return rows.select("report_id", S.stamp("created_at").alias("created_at"), *_LIST[2:])


@query("report_summary", sql("""
select report_id, final_priority, priority_score, sif_probability, final_activity, final_hazard, final_barrier, barrier_status,
  location, n_rules::int as triggered_rules_count, hse_reviewed, review_decision, reviewer_id, ai_priority, ai_activity, ai_hazard,
  ai_barrier, workflow_status, in_review_queue, alert_triggered,
  case when length(explanation) > 120 then substring(explanation, 1, 120) || '...' else explanation end as explanation_snippet
from summary"""))
def report_summary(spark, folder):
    return S.summary(spark, folder, explained=True).select(
        "report_id", "final_priority", "priority_score", "sif_probability", "final_activity", "final_hazard", "final_barrier",
        "barrier_status", "location", "triggered_rules_count", "hse_reviewed", "review_decision", "reviewer_id", "ai_priority",
        "ai_activity", "ai_hazard", "ai_barrier", "workflow_status", "in_review_queue", "alert_triggered", "explanation_snippet",
    )


@query("list_filter", sql(f"""
select {_LIST_SQL} from summary where final_priority = 'HIGH' and contains(lower(final_hazard), 'fall')
  and contains(lower(final_activity), 'lift')"""))
def list_filter(spark, folder):
    return _listed(V.list_filter(S.summary(spark, folder), "HIGH", "FALL", "Lift"))


@query("list_filter_ai", sql(f"select {_LIST_SQL} from summary where contains(lower(ai_hazard), 'fall') and contains(lower(ai_activity), 'lift')"))
def list_filter_ai(spark, folder):
    return _listed(V.list_filter(S.summary(spark, folder), None, "fall", "lift", on="ai"))


@query("search_reports", sql("""
select report_id from summary where contains(lower(report_id), 'flare') or contains(lower(final_activity), 'flare')
  or contains(lower(final_hazard), 'flare') or contains(lower(report_text), 'flare') or contains(lower(location), 'flare')"""))
def search_reports(spark, folder):
    return V.search(S.summary(spark, folder), "Flare").select("report_id")


@query("review_queue", sql(" union all ".join(
    f"select '{m}' as mode, report_id, workflow_status from summary where {w}" for m, w in {
        "pending": "not hse_reviewed", "confirmed": "review_decision = 'confirmed'", "corrected": "review_decision = 'corrected'",
        "rejected": "review_decision = 'rejected'", "critical": "final_priority = 'CRITICAL'", "high": "final_priority = 'HIGH'",
        "medium": "final_priority = 'MEDIUM'"}.items())))
def review_queue(spark, folder):
    """All queue modes but 'all', each row under every mode that shows it; the table is read once."""
    rows = S.summary(spark, folder)
    modes = [F.when(test(), F.lit(m)) for m, test in V.QUEUE_MODES.items() if m != "all"]
    return rows.select(F.explode(F.array_compact(F.array(*modes))).alias("mode"), "report_id", "workflow_status")


@query("queue_counts", sql("""
select count(*) filter (not hse_reviewed) as pending, count(*) filter (review_decision = 'confirmed') as confirmed,
  count(*) filter (review_decision = 'corrected') as corrected, count(*) filter (review_decision = 'rejected') as rejected,
  0::bigint as critical, count(*) filter (final_priority = 'HIGH') as high, count(*) filter (final_priority = 'MEDIUM') as medium,
  count(*) as "all" from summary"""))
def queue_counts(spark, folder):
    return V.queue_counts(S.summary(spark, folder))


@query("high_risk", sql(f"select {_LIST_SQL} from summary where final_priority = 'HIGH' order by seq limit 50"))
def high_risk(spark, folder):
    return _listed(V.high_risk(S.summary(spark, folder)))


@query("needs_attention", sql(f"""
select {_LIST_SQL} from (select * from summary where final_priority = 'HIGH' order by seq limit 10) where not hse_reviewed
order by seq limit 4"""))
def needs_attention(spark, folder):
    return _listed(V.needs_attention(S.summary(spark, folder)))


@query("list_page", sql(f"select {_LIST_SQL}, (select count(*) from summary) as total from summary order by seq limit 50 offset 100"))
def list_page(spark, folder):
    """The third page, with the number of rows before paging beside it: a count of reports, which needs no triage."""
    page = _listed(V.page(S.summary(spark, folder), 50, 100)).withColumn("one", F.lit(1))
    total = V.total(C.table(spark, folder, "orders")).withColumn("one", F.lit(1))
    return page.join(F.broadcast(total), "one").drop("one")


@query("list_page_by_score", sql(f"select {_LIST_SQL} from summary order by summary.priority_score desc, summary.created_at desc, report_id limit 50"))
def list_page_by_score(spark, folder):
    return _listed(V.page(S.summary(spark, folder), by_score=True))


@query("report_by_id", sql(f"select {_LIST_SQL}, report_text from summary where report_id = 'REP-1234'"))
def report_by_id(spark, folder):
    """A point lookup: the id reaches the scans of reports and of reviews, below the triage."""
    rows = S.summary(spark, folder, report_id="REP-1234")
    return rows.select("report_id", S.stamp("created_at").alias("created_at"), *_LIST[2:], "report_text")


@query("report_joined", sql("""
select report_id, n_rules as rules, coalesce(v.n, 0) as reviews, (priority = 'HIGH')::bigint as alerts, priority
from decided left join (select report_id, count(*) as n from reviews group by 1) v using (report_id)"""))
def report_joined(spark, folder):
    """Every to-many side reduced to one row per report before the join."""
    routed = S.routed(spark, folder)
    counts = C.reviews(spark, folder).groupBy("report_id").agg(F.count("*").alias("reviews"))
    return routed.join(counts, "report_id", "left").select(
        "report_id", F.size("matched_rules").cast("bigint").alias("rules"), F.coalesce("reviews", F.lit(0)).alias("reviews"),
        F.col("alert_triggered").cast("bigint").alias("alerts"), "priority",
    )


@query("report_consolidated", sql("""
select report_id, priority, coalesce(rule_ids, '') as rules, coalesce(e.n, 0)::int as entities,
  coalesce(v.reviews, '') as reviews from decided
left join (select t, count(*) as n from entities group by t) e on e.t = report_text
left join (select report_id, string_agg(reviewer_id || ':' || decision, '; ' order by reviewed_at) as reviews from reviews group by 1) v using (report_id)"""))
def report_consolidated(spark, folder):
    rows = V.consolidated(S.decided(spark, folder), C.reviews(spark, folder))
    return rows.select(
        "report_id", "priority", S.joined(F.transform("matched_rules", lambda r: r["rule_id"])).alias("rules"),
        F.size("entities").alias("entities"),
        S.joined(F.transform("reviews", lambda r: F.concat(r["reviewer_id"], F.lit(":"), r["decision"]))).alias("reviews"),
    )


@query("dual_view", sql("""
select report_id, priority as ai_priority, final_priority, activity as ai_activity,
  case when decision = 'corrected' then corrected_activity else activity end as final_activity, hazard as ai_hazard,
  case when decision = 'corrected' then corrected_hazard else hazard end as final_hazard, barrier as ai_barrier,
  case when decision = 'corrected' then corrected_barrier else barrier end as final_barrier, decision as review_decision
from resolved"""))
def dual_view(spark, folder):
    """The single-report variant: a corrected review shows exactly what the reviewer entered."""
    return V.dual_view(S.routed(spark, folder), C.reviews(spark, folder), per_field_fallback=False)


@query("latest_prediction", sql("""
select report_id, arg_max(priority, version) as priority, arg_max(priority_score, version) as priority_score, max(version) as version
from (select report_id, 1 as version, priority, priority_score from decided
  union all select d.report_id, 1 + row_number() over (partition by d.report_id order by v.reviewed_at), 'HIGH', 0.9::double
  from decided d join reviews v using (report_id)) group by report_id"""))
def latest_prediction(spark, folder):
    """Predictions, analysed again once per review; the newest counts."""
    from pyspark.sql import Window as Win

    first = S.decided(spark, folder).select("report_id", F.lit(1).alias("version"), "priority", "priority_score")
    order = Win.partitionBy("report_id").orderBy("reviewed_at")
    again = C.reviews(spark, folder).join(C.reports(spark, folder).select("report_id"), "report_id", "left_semi").select(
        "report_id", (F.row_number().over(order) + 1).alias("version"), F.lit("HIGH").alias("priority"), F.lit(0.9).alias("priority_score")
    )
    return WF.latest(first.unionByName(again), "report_id", ["version"]).withColumn("version", F.col("version").cast("bigint"))


@query("latest_review", sql("select report_id, reviewer_id, decision, corrected_priority, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') as reviewed_at from latest_review"))
def latest_review(spark, folder):
    rows = WF.latest_reviews(C.reviews(spark, folder))
    return rows.select("report_id", "reviewer_id", "decision", "corrected_priority", S.stamp("reviewed_at").alias("reviewed_at"))


# ------------------------------------------------------------------ dashboards

_PRECURSOR = "count(*) filter (sif_probability >= 0.5 or {} = 'HIGH')"


@query("dashboard_kpis", sql(f"""
select count(*) as total_reports, count(*) filter (final_priority = 'HIGH') as high_priority_count,
  count(*) filter (final_priority = 'MEDIUM') as medium_priority_count, count(*) filter (final_priority = 'LOW') as low_priority_count,
  round({_PRECURSOR.format('final_priority')} / count(*) * 100, 1) as sif_precursor_rate,
  count(*) filter (not hse_reviewed) as pending_reviews_count, count(*) filter (hse_reviewed) as completed_reviews_count,
  round(count(*) filter (hse_reviewed and (review_decision = 'confirmed' or final_priority = ai_priority))
    / count(*) filter (hse_reviewed) * 100, 1) as agreement_rate from summary"""))
def dashboard_kpis(spark, folder):
    return D.kpis(S.summary(spark, folder))


@query("precursor_rate", sql(f"""
select 'final' as basis, round({_PRECURSOR.format('final_priority')} / count(*) * 100, 1) as sif_precursor_rate from summary
union all select 'ai', round({_PRECURSOR.format('ai_priority')} / count(*) * 100, 1) from summary"""))
def precursor_rate(spark, folder):
    return D.precursor_rates(S.summary(spark, folder), {"final": "final_priority", "ai": "ai_priority"})


@query("ai_vs_final", sql("""
select count(*) filter (ai_priority = 'HIGH') as ai_high, count(*) filter (ai_priority = 'MEDIUM') as ai_medium,
  count(*) filter (ai_priority = 'LOW') as ai_low, count(*) filter (hse_reviewed and final_priority = 'HIGH') as final_high,
  count(*) filter (hse_reviewed and final_priority = 'MEDIUM') as final_medium,
  count(*) filter (hse_reviewed and final_priority = 'LOW') as final_low, count(*) filter (not hse_reviewed) as final_unreviewed from summary"""))
def ai_vs_final(spark, folder):
    return D.ai_vs_final(S.summary(spark, folder))


@query("review_agreement", sql("""
select count(*) filter (not hse_reviewed) as pending, count(*) filter (review_decision = 'confirmed') as confirmed,
  count(*) filter (review_decision = 'corrected') as corrected, count(*) filter (review_decision = 'rejected') as rejected,
  count(*) filter (hse_reviewed) as total_reviewed,
  round(count(*) filter (hse_reviewed and (review_decision = 'confirmed' or final_priority = ai_priority))
    / count(*) filter (hse_reviewed) * 100, 1) as agreement_rate from summary"""))
def review_agreement(spark, folder):
    return D.review_status(S.summary(spark, folder))


def _top_sql(column: str, name: str) -> str:
    return sql(f"""
select {column} as {name}, count(*) as count, round(count(*) / (select count(*) from summary) * 100, 1) as percentage
from summary where {column} is not null group by 1 order by count(*) desc, min(seq) limit 5""")


@query("top_hazards", _top_sql("ai_hazard", "hazard"))
def top_hazards(spark, folder):
    return D.top_values(S.summary(spark, folder), "ai_hazard", "hazard")


@query("top_activities", _top_sql("ai_activity", "activity"))
def top_activities(spark, folder):
    return D.top_values(S.summary(spark, folder), "ai_activity", "activity")


_GAPS = {"gaps": """
select *, row_number() over (order by count desc, first) as gap_rank from (
  select ai_barrier as barrier, barrier_status, count(*) as count, min(seq) as first from summary
  where ai_barrier is not null and barrier_status in ('Not Verified', 'Absent', 'Failed') group by 1, 2)"""}


@query("top_barrier_gaps", sql("select barrier, barrier_status, count, gap_rank::int as gap_rank from gaps where gap_rank <= 5", _GAPS))
def top_barrier_gaps(spark, folder):
    return D.barrier_gaps(S.summary(spark, folder))


@query("recurring_clusters", sql(f"""
select gap_rank::int as gap_rank, {say(W.CLUSTER_NAME, barrier='barrier', status='g.barrier_status')} as cluster_name, barrier,
  g.barrier_status as barrier_status, count as occurrences,
  case when g.barrier_status in ('Not Verified', 'Failed') then 'HIGH' else 'MEDIUM' end as risk_band,
  {say(W.CLUSTER_ADVICE, barrier='barrier')} as recommendation,
  (select array_to_string((list(report_id order by seq))[1:6], '; ') from summary s
    where s.ai_barrier = g.barrier and s.barrier_status = g.barrier_status) as sample_report_ids
from gaps g where gap_rank <= 4""", _GAPS))
def recurring_clusters(spark, folder):
    rows = D.recurring_clusters(S.summary(spark, folder))
    return rows.withColumn("sample_report_ids", S.joined("sample_report_ids"))


@query("pattern_summary", sql(f"""
select count(*) as total_analyzed, {say(W.PATTERN_SUMMARY, total="count(*)::varchar",
  hazard="(select ai_hazard from summary where ai_hazard is not null group by 1 order by count(*) desc, min(seq) limit 1)",
  barrier="(select barrier from gaps where gap_rank = 1)")} as summary from summary""", _GAPS))
def pattern_summary(spark, folder):
    return D.pattern_summary(S.summary(spark, folder))


@query("daily_trend", sql("""
select strftime(created_at, '%Y-%m-%d') as day, count(*) filter (final_priority = 'HIGH') as high,
  count(*) filter (final_priority = 'MEDIUM') as medium, count(*) filter (final_priority = 'LOW') as low, count(*) as total
from summary group by 1"""))
def daily_trend(spark, folder):
    return D.daily_trend(S.summary(spark, folder)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("chart_series", sql("""
select 'ai_vs_final' as chart, p as label, (select count(*) from summary where ai_priority = p) as ai,
  (select count(*) from summary where hse_reviewed and final_priority = p) as final from (values ('HIGH'), ('MEDIUM'), ('LOW')) v(p)
union all select 'review_status', label, null, n from (
  select upper(d[1]) || d[2:] as label, (select count(*) from summary where coalesce(review_decision, 'pending') = d) as n
  from (values ('confirmed'), ('corrected'), ('rejected'), ('pending')) v(d)) where n > 0"""))
def chart_series(spark, folder):
    return D.chart_series(S.summary(spark, folder))


@query("chart_top", sql("""
select * from (select 'hazards' as chart, ai_hazard as label, count(*) as count from summary where ai_hazard is not null group by 2 order by count(*) desc, min(seq) limit 6)
union all select * from (select 'activities', ai_activity, count(*) from summary where ai_activity is not null group by 2 order by count(*) desc, min(seq) limit 6)
union all select 'barrier_gaps', barrier || ' — ' || barrier_status, count from gaps where gap_rank <= 6""", _GAPS))
def chart_top(spark, folder):
    return D.top_series(S.summary(spark, folder))


@query("cohort_summary", sql("""
select count(*) as total_loaded, count(*) filter (priority = 'HIGH') as high_priority_count,
  count(*) filter (priority = 'MEDIUM') as medium_priority_count, count(*) filter (priority = 'LOW') as low_priority_count,
  sum(n_rules)::bigint as rules_fired_count from decided"""))
def cohort_summary(spark, folder):
    return D.cohort_summary(S.decided(spark, folder))


@query("cohort_status", sql("""
select count(*) > 0 as is_loaded, count(*) as reports_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_loaded,
  array_to_string(list_sort(list(distinct source_file_name) filter (source_file_name is not null)), '; ') as categories
from reports where starts_with(report_id, 'REP-1')"""))
def cohort_status(spark, folder):
    return D.cohort_status(C.reports(spark, folder), "REP-1", "source_file_name").withColumns(
        {"last_loaded": S.stamp("last_loaded"), "categories": S.joined("categories")})


_REGISTER_SQL = """
select report_id, coalesce(source_file_name, 'N/A') as source_file, report_type, location, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at,
  coalesce(final_activity, '') as activity, coalesce(final_hazard, '') as hazard, coalesce(final_barrier, '') as barrier,
  coalesce(barrier_status, '') as barrier_status, final_priority as priority, priority_score, sif_probability,
  n_rules::varchar || ' rules' as triggered_rules, hse_reviewed, coalesce(review_decision, '') as hse_decision, workflow_status
from summary join (select report_id, source_file_name from reports) using (report_id)"""


@query("export_register", sql(_REGISTER_SQL))
def export_register(spark, folder):
    return P.export_register(S.summary(spark, folder))


@query("export_register_csv", sql(_REGISTER_SQL + " where final_priority = 'HIGH' and contains(lower(final_hazard), 'fall')"))
def export_register_csv(spark, folder):
    """The register of high-risk falls, written as CSV and read back."""
    path = f"{scratch(spark)}/register"
    rows = P.export_register(S.summary(spark, folder), priority="HIGH", hazard="fall")
    WR.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path).na.fill("")
