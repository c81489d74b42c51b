"""Embeddings, neighbours, recurrence, groups of similar reports, and streaming triage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog import query
from catalog import shared as S
from catalog.records import UPSERTED
from oracles.base import CTE, q, say, sql
from riskloom.functions import vectors as VX
from riskloom.functions.lineage import scratch, stored
from riskloom.functions.plan import settled
from riskloom.operators import models as M
from riskloom.operators import patterns as PT
from riskloom.operators import persist as P
from riskloom.operators import similar as SIM
from riskloom.packs import wording as W
from riskloom.plans import corpus as C
from riskloom.schemas import INTAKE
from riskloom.streaming import pattern_stream as PS
from riskloom.streaming import triage_stream as TS
from riskloom.streaming.keyed_table import LOAD, KeyedTable

# Small blocks, so that small tables are many groups too.
BLOCK = 256

_HASH = {
    "tokens": r"select t, unnest(list_filter(string_split_regex(replace(replace(lt, ',', ' '), '.', ' '), '\s+'), lambda x: x <> '')) as w from texts",
    "hashed": "select t, ('0x' || substring(md5(w), 1, 8))::bigint as h from tokens",
    "buckets": "select t, (h + i * 97) % 384 as d, sum(((h >> (4 * i)) & 255) / 255.0::double - 0.5::double) as x from hashed, range(4) r(i) group by all",
    "units": "select t, d, x / sqrt(sum(x * x) over (partition by t)) as x from buckets",
    "dense": "select t, [coalesce(m[d][1], 0.0::double) for d in range(384)] as v from (select t, map_from_entries(list((d, x))) as m from units group by t)".replace("m[d][1]", "m[d]"),
    # Blank texts have no vector and are similar to nothing.
    "copies": "select report_text as t, min(pos) as first, count(*) as n from reports where report_text in (select t from dense) group by 1",
}


@query("hash_embedding", sql("select report_id, d::int as bucket, round(x, 6) as value from reports join units on t = report_text where abs(x) > 1e-12", _HASH))
def hash_embedding(spark, folder):
    """The non-zero buckets of every report's vector."""
    reports = C.reports(spark, folder).select("report_id", "report_text")
    # Settled, because the filters that come with the explode would work the vector out again, several times a row.
    rows = settled(reports, reports.withColumn("vec", VX.hash_embedding("report_text")))
    return rows.select("report_id", F.posexplode("vec").alias("bucket", "value")).filter(F.abs("value") > 1e-12).select(
        "report_id", "bucket", F.round("value", 6).alias("value"))


@query("cosine_pairs", """
select a.vec_id, b.vec_id as next_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, folder):
    """Each stored vector with the next one."""
    rows = C.table(spark, folder, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", "next_id", VX.cosine(F.col("embedding"), F.col("next")).alias("cosine"))


_SIMS = _HASH | {"sims": "select a.t, b.t as u, round(least(1, greatest(-1, list_dot_product(a.v, b.v))), 4) as sim, list_dot_product(a.v, b.v) as exact from dense a, dense b"}
_TOPK = _SIMS | {
    # The first six reports of every text are enough: five, and one for the report itself.
    "firsts": "select * from (select *, row_number() over (partition by report_text order by pos) as rn from reports) where rn <= 6",
    "near": "select * from (select s.t, f.report_id, f.pos, s.sim, row_number() over (partition by s.t order by s.sim desc, f.pos) as rn from sims s join firsts f on f.report_text = s.u where s.sim >= 0.5) where rn <= 6",
    "neighbours": """
select * from (select r.report_id, n.report_id as similar_id, n.sim as similarity,
  row_number() over (partition by r.report_id order by n.sim desc, n.pos) as rank from reports r join near n on n.t = r.report_text and n.report_id <> r.report_id)
where rank <= 5""",
}


@query("similar_topk", sql("select report_id, similar_id, similarity, rank::int as rank from neighbours", _TOPK))
def similar_topk(spark, folder):
    return SIM.similar_reports(C.reports(spark, folder), block_rows=BLOCK)


@query("similar_embedded", sql("select report_id, similar_id, similarity, rank::int as rank from neighbours", _TOPK))
def similar_embedded(spark, folder):
    """The same with vectors that an external model makes in the workers."""
    embed = M.text_embedder(lambda: M.hashed())
    return SIM.similar_reports(C.reports(spark, folder), embedding=embed(F.col("text")), block_rows=BLOCK)


@query("mean_similarity", sql("select report_id, round(avg(similarity), 4) as mean_similarity, count(*) as neighbours from neighbours group by 1", _TOPK))
def mean_similarity(spark, folder):
    return SIM.mean_similarity(SIM.similar_reports(C.reports(spark, folder), block_rows=BLOCK))


@query("similar_vectors", """
select vec_id, other, similarity, rank::int as rank from (
  select *, row_number() over (partition by vec_id order by similarity desc, other) as rank from (
    select a.vec_id, b.vec_id as other, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as similarity
    from embeddings a join embeddings b on a.vec_id <> b.vec_id) where similarity >= 0.35) where rank <= 5""")
def similar_vectors(spark, folder):
    """Neighbours among vectors that come from elsewhere."""
    rows = C.table(spark, folder, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), F.col("vec_id").alias("first"))
    return SIM.nearest(rows, 5, 0.35, BLOCK).select(F.col("vid").alias("vec_id"), "other", "similarity", "rank")


@query("recurrence_signal", sql("""
select report_id, m as max_similarity, case when m >= 0.7::double then 1.0::double when m >= 0.35::double then round((m - 0.35::double) / 0.35::double, 3) else 0.0::double end as recurrence_signal
from (select r.report_id, case when h.n > 1 or (h.n = 1 and h.one <> r.report_id) then 1.0::double else coalesce(b.sim, 0) end as m
  from reports r left join high h on h.u = r.report_text
  left join (select t, max(sim) as sim from sims where u in (select u from high) and u <> t and sim >= 0.35 group by 1) b on b.t = r.report_text)""",
    _SIMS | {"high": "select report_text as u, count(*) as n, min(report_id) as one from decided where priority = 'HIGH' group by 1"}))
def recurrence_signal(spark, folder):
    """Against all other high-risk reports; similarities below .35, whose signal is 0, are not told apart."""
    high = S.decided(spark, folder).filter(F.col("priority") == "HIGH").select("report_id", "report_text")
    return SIM.recurrence(C.reports(spark, folder), high, block_rows=BLOCK).select("report_id", "max_similarity", "recurrence_signal")


_CLUSTER = _SIMS | {
    "links": "select a.first as a, b.first as b from sims s join copies a on a.t = s.t join copies b on b.t = s.u where s.exact >= 0.6::double",
    "reach": "select first as a, first as root from copies union select l.b, r.root from reach r join links l on l.a = r.a",
    "grouped": "select a as first, min(root) as root from reach group by 1",
    "clustered": "select t, c.first, n, root, sum(n) over (partition by root) as size from copies c join grouped g using (first)",
    "members": "select r.report_id, r.pos, r.created_at, c.root, c.size, x.activity, x.hazard, case when x.barrier is not null then x.barrier || ' (' || coalesce(x.barrier_status, 'Compromised') || ')' end as failure from reports r join clustered c on c.t = r.report_text join context x on x.t = c.t where size >= 2",
}


@query("semantic_clusters", sql("select report_id, root as cluster_first, size::bigint as size from members", _CLUSTER, ("reach",)))
def semantic_clusters(spark, folder):
    rows = C.reports(spark, folder)
    return PT.members(rows, PT.text_clusters(rows, block_rows=BLOCK)).select("report_id", "cluster_first", "size")


def _analysed(spark, folder):
    return S.decided(spark, folder).select("report_id", "pos", "report_text", "created_at", "activity", "hazard", "barrier", "barrier_status")


_CLOSE = _CLUSTER | {
    "closeness": "select a.t, a.root, a.first, sum(s.exact * b.n) as c from clustered a join clustered b on b.root = a.root join sims s on s.t = a.t and s.u = b.t where a.size >= 2 group by all",
    "cohesion": "select c.root, arg_min(c.t, [-round(c.c, 9), c.first]) as representative_text, round(least(1, greatest(0, (sum(c.c * k.n) - max(k.size)) / (max(k.size) * (max(k.size) - 1)))), 4) as average_similarity from closeness c join clustered k on k.t = c.t group by 1",
}


@query("cluster_medoid", sql("select root as cluster_first, representative_text, average_similarity from cohesion", _CLOSE, ("reach",)))
def cluster_medoid(spark, folder):
    clustered = PT.text_clusters(C.reports(spark, folder), block_rows=BLOCK)
    firsts = clustered.groupBy("cluster").agg(F.min("first").alias("cluster_first"))
    return PT.cohesion(clustered).join(firsts, "cluster").select("cluster_first", "representative_text", "average_similarity")


@query("cohort_patterns", sql("""
select (select count(distinct root) from members) + (select count(*) from (select 1 from decided where barrier is not null
  and barrier_status in ('Not Verified', 'Absent', 'Failed') group by barrier, barrier_status limit 4)) as recurring_patterns_count""", _CLUSTER, ("reach",)))
def cohort_patterns(spark, folder):
    """How many recurring patterns a load shows: groups of similar reports, and the leading barrier gaps."""
    from riskloom.operators import dashboard as D

    groups = PT.text_clusters(C.reports(spark, folder), block_rows=BLOCK).agg(F.countDistinct("cluster").alias("groups"))
    gaps = D.barrier_gaps(S.summary(spark, folder), 4).agg(F.count("*").alias("gaps"))
    both = groups.withColumn("one", F.lit(1)).join(gaps.withColumn("one", F.lit(1)), "one")
    return both.select((F.col("groups") + F.col("gaps")).alias("recurring_patterns_count"))


def _mode(column: str, default: str) -> str:
    return (f"coalesce((select {column} from members x where x.root = m.root and {column} is not null group by 1 "
            f"order by count(*) desc, min(pos) limit 1), {q(default)})")


_advice = "case " + " ".join(
    "when " + " or ".join([f"contains(lower(hazard_), '{w}')" for w in h] + [f"contains(lower(failure_), '{w}')" for w in b]) + f" then {q(a)}"
    for h, b, a in W.RECOMMENDATIONS
) + f" else {say(W.RECOMMENDATION_OTHER, activity='activity_', barrier='failure_')} end"


_PATTERNS = sql(f"""
select 'PAT-SEM-' || lpad((row_number() over (order by number_of_reports desc, root))::varchar, 3, '0') as pattern_id, number_of_reports, activity_ as common_activity,
  hazard_ as common_hazard, failure_ as common_barrier_failure, {_advice} as recommended_action, representative_text, average_similarity
from (select root, count(*) as number_of_reports, {_mode('activity', W.COMMON_DEFAULTS['activity'])} as activity_,
    {_mode('hazard', W.COMMON_DEFAULTS['hazard'])} as hazard_, {_mode('failure', W.COMMON_DEFAULTS['barrier'])} as failure_
  from members m group by root) join cohesion using (root)""", _CLOSE, ("reach",))
_PATTERN_COLUMNS = ("pattern_id", "number_of_reports", "common_activity", "common_hazard", "common_barrier_failure", "recommended_action", "representative_text", "average_similarity")


@query("semantic_patterns", _PATTERNS)
def semantic_patterns(spark, folder):
    patterns, _ = PT.semantic_patterns(_analysed(spark, folder), block_rows=BLOCK)
    return patterns.select(*_PATTERN_COLUMNS)


_TREND_SQL = """
select hazard, first_seen, last_seen, span_days, days, case when n <= 2 or span_days = 0 then 'isolated' when later > earlier then 'increasing'
  when later < earlier then 'decreasing' else 'stable' end as trend_direction from (
  select hazard, strftime(min(created_at), '%Y-%m-%d') as first_seen, strftime(max(created_at), '%Y-%m-%d') as last_seen, count(*) as n,
    date_diff('day', min(created_at), max(created_at)) as span_days, count(distinct created_at::date)::int as days,
    count(*) filter (epoch_us(created_at) <= (lo + hi) / 2) as earlier, count(*) filter (epoch_us(created_at) > (lo + hi) / 2) as later
  from (select *, epoch_us(min(created_at) over (partition by hazard)) as lo, epoch_us(max(created_at) over (partition by hazard)) as hi
    from decided where hazard is not null) group by hazard)"""


@query("pattern_trend", sql(_TREND_SQL))
def pattern_trend(spark, folder):
    """The trend of each hazard's reports."""
    rows = _analysed(spark, folder).filter(F.col("hazard").isNotNull())
    return PT.trend(rows, "hazard").select(
        "hazard", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"),
        "span_days", F.size("date_counts").alias("days"), "trend_direction")


@query("recommendations", sql(f"""
select distinct hazard_ as hazard, failure_ as barrier_failure, activity_ as activity, {_advice} as recommended_action from (
  select coalesce(hazard, 'Physical Energy') as hazard_, coalesce(barrier, 'Control') as failure_, coalesce(activity, 'Work') as activity_ from decided)"""))
def recommendations(spark, folder):
    rows = _analysed(spark, folder).select(
        F.coalesce("hazard", F.lit("Physical Energy")).alias("hazard"), F.coalesce("barrier", F.lit("Control")).alias("barrier_failure"),
        F.coalesce("activity", F.lit("Work")).alias("activity")).distinct()
    return rows.withColumn("recommended_action", PT.recommendation(F.col("hazard"), F.col("barrier_failure"), F.col("activity")))


GROUPS = 3


def _streamed(spark, rows):
    """The tables of a stream in which the reports arrive in three groups of all dates, one after the other; every 13th arrives again."""
    base = scratch(spark)
    again = F.when(F.col("pos") % 13 == 0, F.array(F.col("pos") % GROUPS, (F.col("pos") + 1) % GROUPS)).otherwise(F.array(F.col("pos") % GROUPS))
    for group in range(GROUPS):
        # Each group is made from the orders, which is cheap, so that the reports are not kept twice.
        rows.filter(F.array_contains(again, group)).select(*INTAKE.names).write.mode("append").parquet(f"{base}/in", compression="zstd")
        stream = TS.arriving(spark, f"{base}/in", files_per_trigger=1_000_000)
        TS.start(stream, f"{base}/tables", f"{base}/progress", once=True).awaitTermination()
    return TS.TriageTables(spark, f"{base}/tables")


def _arriving_reports(spark, folder):
    """Reports, every seventh too short and every eleventh too long to be taken in."""
    text = (
        F.when(F.col("pos") % 7 == 0, F.substring("report_text", 1, 9))
        .when(F.col("pos") % 11 == 0, F.concat("report_text", F.lit("x" * 10_001))).otherwise(F.col("report_text"))
    )
    return C.reports(spark, folder).select(
        "report_id", text.alias("report_text"), F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("double").alias("recurring_risk_signal"), F.col("created_at").cast("timestamp").alias("created_at"), "pos")


#: The newest report of the groups that arrived before; an hour before it, a report is late. What is in an earlier group arrives there first.
_LANDED = {
    "landed": f"select *, case when pos % 13 = 0 then least(pos % {GROUPS}, (pos + 1) % {GROUPS}) else pos % {GROUPS} end as landing from routed",
    "newest": "select landing, max(max(created_at)) over (order by landing rows between unbounded preceding and 1 preceding) as newest from landed group by landing",
}
_GOOD = "pos % 7 <> 0 and pos % 11 <> 0 and length(report_text) >= 10"


@query("stream_triage", sql(f"""
select report_id, priority, priority_score, status0 as workflow_status, coalesce(created_at < newest - interval 1 hour, false) as late
from landed join newest using (landing) where {_GOOD}""", _LANDED))
def stream_triage(spark, folder):
    """Reports of every length and in no order of dates arriving as files, triaged by a stream batch by batch, and read back."""
    decided = _streamed(spark, _arriving_reports(spark, folder)).decisions()
    return decided.select("report_id", "priority", "priority_score", "workflow_status", "late")


@query("stream_rejects", sql("""
select report_id, case when pos % 7 = 0 then least(9, length(report_text)) when pos % 11 = 0 then 10001 + length(report_text) else length(report_text) end::int as n_chars,
  'report_text' as violations
from reports where pos % 7 = 0 or pos % 11 = 0 or length(report_text) < 10"""))
def stream_rejects(spark, folder):
    """The reports that the same stream does not take in, whole, with the limits they break."""
    rejects = _streamed(spark, _arriving_reports(spark, folder)).rejects()
    return rejects.select("report_id", F.length("report_text").alias("n_chars"), S.joined("violations").alias("violations"))


@query("stream_daily", sql(f"""
select strftime(created_at, '%Y-%m-%d') as day, priority, count(*) as reports from routed where {_GOOD} group by all"""))
def stream_daily(spark, folder):
    """Daily counts that the stream keeps: late reports and repeats change the days they belong to."""
    daily = _streamed(spark, _arriving_reports(spark, folder)).daily.read()
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "priority", "reports")


@query("stream_alerts", sql(f"select alert_id, report_id, severity, message from alerts join reports using (report_id) where {_GOOD.replace('report_text', 'reports.report_text')}"))
def stream_alerts(spark, folder):
    """The alerts that the stream raises, one a report however often it arrives."""
    return _streamed(spark, _arriving_reports(spark, folder)).alerts.read().select("alert_id", "report_id", "severity", "message")


@query("stream_upserts", UPSERTED)
def stream_upserts(spark, folder):
    """Stored reports kept up to date by a stream of arrivals that come in batches out of order."""
    base, columns = scratch(spark), ["report_id", "report_text", "location", "report_type", "created_at"]
    first = P.as_arrivals(C.reports(spark, folder).withColumn("location", F.lit("Unknown")).select(*columns), F.lit(-1))
    table = KeyedTable(spark, f"{base}/reports", first.schema, ["report_id"], 16)
    table.apply(LOAD, first, P.merge_arrivals)
    arrivals = P.as_arrivals(C.arrivals(spark, folder).withColumn("created_at", F.col("created_at").cast(first.schema["created_at"].dataType)), F.col("seq"))
    for group in (2, 0, 1):
        arrivals.filter(F.pmod(F.xxhash64("seq"), F.lit(GROUPS)) == group).select(*first.columns).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{base}/in")
        TS.start_upserts(stream, table, f"{base}/progress", once=True).awaitTermination()
    return table.read().select("report_id", "report_text", "location", "report_type", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("stream_patterns", _PATTERNS)
def stream_patterns(spark, folder):
    """The recurring patterns of all reports, kept up to date by a stream to which the analysed reports come in groups of all dates."""
    base, schema = scratch(spark), StructType.fromDDL(PS.ANALYSED)
    rows = _analysed(spark, folder).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("pos", F.col("pos").cast("long"))
    landed, tables = stored(rows.select(*schema.names)), PS.PatternTables(spark, f"{base}/patterns", buckets=16, block_rows=BLOCK)
    for group in range(GROUPS):
        landed.filter(F.pmod(F.xxhash64("pos"), F.lit(GROUPS)) == group).write.mode("append").parquet(f"{base}/in")
        PS.start_patterns(spark.readStream.schema(schema).parquet(f"{base}/in"), tables, f"{base}/progress", once=True).awaitTermination()
    return tables.ranked().select(*_PATTERN_COLUMNS)
