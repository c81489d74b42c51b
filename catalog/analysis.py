"""Rules, extraction, scoring, decisions and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.shared import decided, joined
from oracles.base import (
    CTE, FALLBACK, explained as explained_sql, pick, q, say, scored as scored_sql, sql, values,
)
from riskloom.functions.lineage import scratch, stored
from riskloom.functions.plan import settled
from riskloom.functions import text as tx
from riskloom.operators import extract as X
from riskloom.operators import explain as E
from riskloom.operators import learn as L
from riskloom.operators import models as M
from riskloom.operators import phrasebook as PB
from riskloom.operators import rules as R
from riskloom.operators import score as SC
from riskloom.packs import wording as W
from riskloom.packs.gazetteer import DEFAULT_GAZETTEERS
from riskloom.packs.rules import DEFAULT_RULES
from riskloom.plans import corpus as C
from riskloom.sources import writers as WR

# ------------------------------------------------------------------ packs

_rules = values(
    [(i, r.id, r.name, r.category, r.severity, len(r.signals), r.explanation) for i, r in enumerate(DEFAULT_RULES)],
    "pos, id, name, category, severity, n_signals, explanation",
)


@query("rule_catalogue", sql("""
select count(*) as fired_rules, string_agg(rule_id, '; ' order by rpos) as rule_ids, string_agg(category, '; ' order by rpos) as categories
from (select distinct rule_id, category, rpos from fired)"""))
def rule_catalogue(spark, folder):
    """The catalogue of those rules that fire anywhere in the corpus, in load order."""
    fired = R.rule_rows(R.match_rules(C.reports(spark, folder))).select(F.col("rule_id").alias("id")).distinct()
    used = R.rule_table(spark).join(fired, "id", "left_semi")
    return R.catalogue(used).select(
        F.col("rule_count").alias("fired_rules"), joined("rule_ids").alias("rule_ids"), joined("categories").alias("categories")
    )


@query("validate_rules", """
select p_partkey::int as pos, id, violation from (
  select p_partkey, p_name as id,
    list_filter([case when p_size % 7 = 0 then 'missing category' end,
      case when p_size not between 1 and 4 then 'severity outside 1-4' end,
      case when p_size % 5 = 0 then 'no signals' end], lambda x: x is not null) as v
  from part), unnest(v) as u(violation)""")
def validate_rules(spark, folder):
    """Every part taken as a rule of a user's pack."""
    pack = C.table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("pos"), F.col("p_name").alias("id"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("category"), F.col("p_size").alias("severity"),
        F.when(F.col("p_size") % 5 != 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("signals"),
        F.col("p_brand").alias("explanation"),
    )
    return R.rule_violations(pack)


@query("rule_pack_file", sql("select report_id, rule_id, severity, signals from reports join fired on t = report_text"))
def rule_pack_file(spark, folder):
    """Matching with a pack written as a JSON file, read back and validated."""
    path = f"{scratch(spark)}/pack"
    pack = R.rule_table(spark).drop("pos")
    pack.coalesce(1).agg(F.to_json(F.struct(F.collect_list(F.struct(*pack.columns)).alias("rules"))).alias("value")).write.text(path)
    rules = R.rules_of(R.read_pack(spark, path))
    rows = R.rule_rows(R.match_rules(C.reports(spark, folder), rules))
    return rows.select("report_id", "rule_id", "severity", joined("signals").alias("signals"))


@query("gazetteer_flat", sql("""
select kind, canonical, category, alias, count(t) as texts from alias_list left join
  (select distinct kind, apos, alias, t from occurrences join alias_list using (kind, apos)) o using (kind, apos, alias)
group by all"""))
def gazetteer_flat(spark, folder):
    """Every alias of the gazetteers, with the number of distinct texts it stands in."""
    texts = C.reports(spark, folder).select("report_text").distinct()
    hits = X.alias_hits(texts, "report_text", "report_text").groupBy("kind", "alias_pos").agg(F.count("*").alias("texts"))
    return X.gazetteer_table(spark).join(hits, ["kind", "alias_pos"], "left").select(
        "kind", "canonical", "category", "alias", F.coalesce("texts", F.lit(0)).alias("texts")
    )


# ------------------------------------------------------------------ rules


@query("rule_matches", sql("""
select report_id, rule_id, severity, signals from reports join fired on t = report_text"""))
def rule_matches(spark, folder):
    rows = R.rule_rows(R.match_rules(C.reports(spark, folder)))
    return rows.select("report_id", "rule_id", "severity", joined("signals").alias("signals"))


@query("rule_matches_table", sql("""
select report_id, rule_id, severity, signals from reports join fired on t = report_text"""))
def rule_matches_table(spark, folder):
    """The same from a table of rules, as packs of any size are given."""
    table = spark.createDataFrame(PB.rule_table(DEFAULT_RULES), "rule_pos int, rule_id string, severity int, signals array<string>")
    rows = PB.match_rule_table(C.reports(spark, folder), table)
    return rows.select("report_id", "rule_id", "severity", joined("signals").alias("signals"))


@query("entity_matches_table", sql("""
select report_id, kind as entity_type, surface as text, canonical as normalized_value, category, s::int as start_char, e::int as end_char
from reports join gaz on t = report_text"""))
def entity_matches_table(spark, folder):
    """Gazetteer entities from a table of aliases."""
    rows = PB.match_alias_table(C.reports(spark, folder), X.gazetteer_table(spark))
    return rows.select("report_id", F.col("kind").alias("entity_type"), "text", F.col("canonical").alias("normalized_value"), "category",
                       F.col("start").alias("start_char"), F.col("end").alias("end_char"))


@query("large_pack_hits", sql("""
select phrase, sum(n)::bigint as reports, sum(n * k)::bigint as occurrences from (
  select phrase, n, (length(lt) - length(replace(lt, phrase, ''))) // length(phrase) as k
  from phrases join (select lower(report_text) as lt, count(*) as n from reports group by 1) on contains(lt, phrase)) group by phrase""", {
    "phrases": """
select distinct unnest(list_filter(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]), lambda p: length(p) > 3)) as phrase
from (select string_split(lower(text), ' ') as w from (select text from documents where regexp_full_match(text, '[\\x00-\\x7F]*') union all select report_text from reports))"""}))
def large_pack_hits(spark, folder):
    """How often words and word pairs of all plain-letter documents and of all reports, some 100,000 phrases, stand in the reports."""
    texts = C.table(spark, folder, "documents").filter(F.col("text").rlike(r"\A[\x00-\x7F]*\z")).select("text").unionByName(
        C.reports(spark, folder).select(F.col("report_text").alias("text")))
    words = F.split(F.lower("text"), " ")
    pairs = F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(F.get(F.col("w"), i), F.lit(" "), x))
    both = settled(texts, texts.withColumn("w", words).withColumn("both", F.concat("w", pairs)).drop("w"))
    phrases = both.select(F.explode("both").alias("phrase")).filter(F.length("phrase") > 3).distinct()
    known = stored(phrases.withColumn("entry", F.monotonically_increasing_id()))
    # A phrase counts once a report, and as often as it stands there.
    totals = stored(PB.phrase_totals(C.reports(spark, folder), known))
    # Phrases with a hit: sent to every task where they have been counted and are few, so that the pack is not shuffled again.
    few = F.broadcast(totals) if totals.count() <= L.SMALL_VOCABULARY else totals
    return known.join(few, "entry").select("phrase", "reports", "occurrences")


@query("rule_rollup", sql("""
select report_id, severity as overall_severity,
  case severity when 0 then 'NONE' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end as overall_severity_label,
  severity >= 3 as flagged, severity / 4.0::double as rule_severity_score, coalesce(rule_ids, '') as rule_ids, evidence_summary
from reports join rollup on t = report_text"""))
def rule_rollup(spark, folder):
    rows = R.roll_up(R.match_rules(C.reports(spark, folder)))
    return rows.select(
        "report_id", "overall_severity", "overall_severity_label", "flagged", "rule_severity_score",
        joined(F.transform("matched_rules", lambda r: r["rule_id"])).alias("rule_ids"), "evidence_summary",
    )


# ------------------------------------------------------------------ extraction


def _extracted(spark, folder, **options):
    return X.extract(C.reports(spark, folder), **options)


@query("entity_matches", sql("""
select report_id, kind as entity_type, surface as text, canonical as normalized_value, category, s::int as start_char,
  e::int as end_char, confidence from reports join gaz on t = report_text"""))
def entity_matches(spark, folder):
    rows = X.entity_rows(_extracted(spark, folder), "gazetteer_entities")
    return rows.select("report_id", "entity_type", "text", "normalized_value", "category",
                       F.col("start").alias("start_char"), F.col("end").alias("end_char"), "confidence")


@query("entities_dedup", sql("""
select kind as entity_type, sum(kept)::bigint as spans, sum(found)::bigint as occurrences
from reports join (select t, kind, count(*) as kept from gaz group by all) k on t = report_text
  join (select t, kind, count(*) as found from occurrences group by all) o using (t, kind) group by kind"""))
def entities_dedup(spark, folder):
    """Spans per type that removal of overlaps keeps, out of all places where an alias stands."""
    rows = _extracted(spark, folder)
    kept = X.entity_rows(rows, "gazetteer_entities").groupBy("entity_type").agg(F.count("*").alias("spans"))
    every = X.alias_hits(C.reports(spark, folder)).groupBy(F.col("kind").alias("entity_type")).agg(F.sum("hits").alias("occurrences"))
    return kept.join(every, "entity_type")


@query("nlp_entities", sql("""
select report_id, kind as entity_type, surface as text, normalized_value, s::int as start_char, e::int as end_char,
  confidence, (row_number() over (partition by report_id order by n) - 1)::int as span_pos
from reports join nlp on t = report_text where kind <> 'barrier'"""))
def nlp_entities(spark, folder):
    rows = X.entity_rows(_extracted(spark, folder), "pattern_entities").filter(F.col("entity_type") != "barrier")
    return rows.select("report_id", "entity_type", "text", "normalized_value", F.col("start").alias("start_char"),
                       F.col("end").alias("end_char"), "confidence", "span_pos")


@query("barrier_status", sql("""
select report_id, surface as text, normalized_value, status, s::int as start_char, e::int as end_char, confidence
from reports join nlp on t = report_text where kind = 'barrier'"""))
def barrier_status(spark, folder):
    rows = X.entity_rows(_extracted(spark, folder), "pattern_entities").filter(F.col("entity_type") == "barrier")
    return rows.select("report_id", "text", "normalized_value", "status", F.col("start").alias("start_char"),
                       F.col("end").alias("end_char"), "confidence")


_ENTITY_SQL = """
select report_id, span_pos::int as span_pos, entity_type, surface as text, normalized_value, category, s::int as start_char,
  e::int as end_char, confidence, source, status from reports join entities on t = report_text"""


@query("entities_merged", sql(_ENTITY_SQL))
def entities_merged(spark, folder):
    rows = X.entity_rows(_extracted(spark, folder))
    return rows.withColumnsRenamed({"start": "start_char", "end": "end_char"})


@query("entity_table", sql(f"select entity_type, normalized_value, source, coalesce(status, '') as status, count(*) as spans, count(distinct report_id) as reports from ({_ENTITY_SQL}) group by all"))
def entity_table(spark, folder):
    """The persisted span table, totalled per value."""
    rows = X.entity_rows(_extracted(spark, folder))
    return rows.groupBy("entity_type", "normalized_value", "source", F.coalesce("status", F.lit("")).alias("status")).agg(
        F.count("*").alias("spans"), F.countDistinct("report_id").alias("reports")
    )


@query("primary_entities", sql("""
select report_id, activity, activity_confidence, hazard, hazard_confidence, barrier, barrier_confidence, location,
  location_confidence, equipment, equipment_confidence from reports join context on t = report_text"""))
def primary_entities(spark, folder):
    return _extracted(spark, folder).select(
        "report_id", "activity", "activity_confidence", "hazard", "hazard_confidence", "barrier", "barrier_confidence",
        F.col("extracted_location").alias("location"), "location_confidence", "equipment", "equipment_confidence",
    )


@query("status_window", sql("""
select report_id, barrier, barrier_status from (
  select t, canonical as barrier, case {} else 'Unknown' end as barrier_status
  from (select *, lower(substring(t, greatest(0, s - 40) + 1, e + 40 - greatest(0, s - 40))) as win
    from (select *, row_number() over (partition by t order by s, e desc) as rn from gaz where kind = 'barrier') where rn = 1))
join reports on report_text = t""".format(__import__("oracles.base", fromlist=["x"])._window_cases)))
def status_window(spark, folder):
    """Gazetteers alone: the state comes from the words around the barrier."""
    rows = _extracted(spark, folder, use_patterns=False).filter(F.col("barrier").isNotNull())
    return rows.select("report_id", "barrier", "barrier_status")


@query("hazard_inferred", sql("""
select report_id, hazard, hazard_category, barrier from reports join context on t = report_text
where hazard_confidence = 0.7::double"""))
def hazard_inferred(spark, folder):
    rows = _extracted(spark, folder).filter(F.col("hazard_confidence") == 0.7)
    return rows.select("report_id", "hazard", "hazard_category", "barrier")


_SUMMARY_SQL = """coalesce(nullif(array_to_string(list_filter(['Activity: ' || activity, 'Equipment: ' || equipment,
  'Hazard: ' || hazard, 'Barrier: ' || barrier || coalesce(' (' || barrier_status || ')', ''), 'Location: ' || location],
  lambda x: x is not null), ' | '), ''), 'No specific safety context entities detected')"""


@query("context_summary", sql(f"select report_id, {_SUMMARY_SQL} as extraction_summary from reports join context on t = report_text"))
def context_summary(spark, folder):
    return _extracted(spark, folder).select("report_id", "extraction_summary")


@query("extract_batch", sql(f"""
select report_id, report_text, coalesce(activity, '') as extracted_activity, coalesce(hazard, '') as extracted_hazard,
  coalesce(barrier, '') as extracted_barrier, coalesce(barrier_status, '') as extracted_barrier_status,
  coalesce(location, '') as extracted_location, coalesce(equipment, '') as extracted_equipment,
  {_SUMMARY_SQL} as extraction_summary from reports join context on t = report_text"""))
def extract_batch(spark, folder):
    return WR.extraction_columns(_extracted(spark, folder), ["report_id", "report_text"])


# ------------------------------------------------------------------ scores and decisions


@query("fallback_prob", sql(f"select report_id, {FALLBACK} as probability from reports join rollup on t = report_text"))
def fallback_prob(spark, folder):
    rows = R.match_rules(C.reports(spark, folder))
    return rows.select("report_id", SC.fallback_probability(F.col("overall_severity"), F.col("report_text")).alias("probability"))


@query("factor_scores", sql("""
select report_id, round(model_probability, 4) as model_probability, rule_severity, barrier_failure, critical_hazard,
  critical_activity from decided"""))
def factor_scores(spark, folder):
    rows = decided(spark, folder)
    return rows.select("report_id", *[f"factor_scores.{c}" for c in (
        "model_probability", "rule_severity", "barrier_failure", "critical_hazard", "critical_activity")])


# A recurrence signal that is null, below zero, inside and above [0, 1].
_RECURRENCE_SQL = "case pos % 4 when 0 then null else (pos % 13 - 1) / 10.0::double end"
_with_recurrence = {
    "by_report": scored_sql("select * from reports join context on t = report_text join rollup using (t)", FALLBACK, _RECURRENCE_SQL)
}


def _recurrence():
    return F.when(F.col("pos") % 4 != 0, (F.col("pos") % 13 - 1) / 10.0)


@query("composite_score", sql("select report_id, round(recurrence, 4) as recurrence, round(composite, 6) as composite_score from by_report", _with_recurrence))
def composite_score(spark, folder):
    rows = decided(spark, folder, recurrence=_recurrence())
    return rows.select("report_id", F.round("recurrence", 4).alias("recurrence"), F.round("composite_score", 6).alias("composite_score"))


@query("priority", sql("select report_id, priority, priority_score, escalated, escalation_reason from by_report", _with_recurrence))
def priority(spark, folder):
    rows = decided(spark, folder, recurrence=_recurrence())
    return rows.select("report_id", "priority", "priority_score", "escalated", "escalation_reason")


# Values the caller already has: probability for every report, all four fields for a part, one field for another.
_GIVEN_SQL = """
select r.*, c.t, n_rules, rule_names, rule_labels, signals, rollup.severity as severity,
  case when pos % 5 = 0 then 'Excavation' when pos % 5 = 1 then 'Hot Work' else c.activity end as activity,
  case when pos % 5 = 0 then 'Struck-By' else c.hazard end as hazard,
  case when pos % 5 = 0 then 'Exclusion Zone' else c.barrier end as barrier,
  case when pos % 5 = 0 then 'Failed' else c.barrier_status end as barrier_status,
  case when pos % 5 = 0 then null else c.location end as location
from reports r join context c on c.t = r.report_text join rollup on rollup.t = c.t"""


@query("decide_precomputed", sql(
    "select report_id, activity, hazard, barrier, barrier_status, location, sif_probability, priority, priority_score from given",
    {"given": scored_sql(_GIVEN_SQL, "(pos % 101) / 100.0::double", "null")}))
def decide_precomputed(spark, folder):
    five = F.col("pos") % 5
    rows = decided(
        spark, folder, probability=F.col("pos") % 101 / 100.0,
        given={
            "activity": F.when(five == 0, "Excavation").when(five == 1, "Hot Work"),
            "hazard": F.when(five == 0, "Struck-By"), "barrier": F.when(five == 0, "Exclusion Zone"),
            "barrier_status": F.when(five == 0, "Failed"),
        },
    )
    return rows.select("report_id", "activity", "hazard", "barrier", "barrier_status",
                       F.col("extracted_location").alias("location"), "sif_probability", "priority", "priority_score")


@query("legacy_band", sql(f"""
select report_id, legacy_score, len(regexp_extract_all(report_text, '\\S+')) as word_count,
  case when legacy_score >= 0.8::double then 'CRITICAL' when legacy_score >= 0.6::double then 'HIGH'
    when legacy_score >= 0.4::double then 'MEDIUM' else 'LOW' end as legacy_band,
  case when n_rules = 0 then {say(W.LEGACY_NOTHING, words="len(regexp_extract_all(report_text, '\\S+'))::varchar")}
    else {say(W.LEGACY_FIRED, count='n_rules::varchar', rules="array_to_string(rule_names, ', ')",
              categories="array_to_string(rule_categories, ', ')", label='label', score="printf('%.2f', legacy_score)")} end as legacy_explanation
from (select *, case when severity >= 3 then greatest(base, 0.4::double) else base end as legacy_score,
    case severity when 0 then 'NONE' when 3 then 'HIGH' else 'CRITICAL' end as label
  from (select r.report_id, r.report_text, x.*,
      round(0.65::double * (severity / 4.0::double) + 0.35::double * 0.30::double, 4) as base,
      (select list(category order by place) from fired f where f.t = x.t) as rule_categories
    from reports r join rollup x on x.t = r.report_text))"""))
def legacy_band(spark, folder):
    rows = SC.legacy_score(R.roll_up(R.match_rules(C.reports(spark, folder))))
    return rows.select("report_id", "legacy_score", F.col("word_count").cast("bigint").alias("word_count"), "legacy_band", "legacy_explanation")


@query("labels_map", sql("""
select doc_id, y_prob, case when y_prob >= 0.8::double then 'HIGH' when y_prob >= 0.5::double then 'MEDIUM'
  when y_prob >= 0.3::double then 'LOW' else 'VERY_LOW' end as confidence_label,
  case doc_id % 5 when 0 then 'NONE' when 1 then 'LOW' when 2 then 'MEDIUM' when 3 then 'HIGH' else 'CRITICAL' end as severity_label
from predicted"""))
def labels_map(spark, folder):
    rows = C.predictions(spark, folder)
    return rows.select("doc_id", "y_prob", SC.probability_label(F.col("y_prob")).alias("confidence_label"),
                       R.severity_label((F.col("doc_id") % 5).cast("int")).alias("severity_label"))


@query("evidence", sql("select report_id, array_to_string(evidence, '; ') as evidence from decided"))
def evidence(spark, folder):
    return decided(spark, folder).select("report_id", joined("evidence").alias("evidence"))


@query("decide", sql("""
select report_id, activity, hazard, barrier, barrier_status, location, equipment, sif_probability, priority, priority_score,
  escalated, coalesce(rule_ids, '') as rule_ids, array_to_string(evidence, '; ') as evidence, explanation from decided"""))
def decide(spark, folder):
    """The whole decision for every report."""
    return decided(spark, folder, explained=True).select(
        "report_id", "activity", "hazard", "barrier", "barrier_status", F.col("extracted_location").alias("location"),
        "equipment", "sif_probability", "priority", "priority_score", "escalated",
        joined(F.transform("matched_rules", lambda r: r["rule_id"])).alias("rule_ids"),
        joined("evidence").alias("evidence"), "explanation",
    )


@query("decide_modelled", sql("select report_id, sif_probability, priority, priority_score from reports join modelled on t = report_text", {
    "worded": r"select t, severity >= 3 as flag, n, unnest(regexp_extract_all(lower(t), '\w\w+')) as word from rollup join (select report_text as t, count(*) as n from reports group by 1) using (t)",
    "odds": "select word, ln((1.0::double + sum(n) filter (flag)) / (1.0::double + sum(n) filter (not flag))) as weight from (select word, flag, n from worded union all select distinct word, true, 0 from worded union all select distinct word, false, 0 from worded) group by word",
    "means": "select t, 1 / (1 + exp(-avg(weight))) as p from worded join odds using (word) group by t",
    "modelled": scored_sql("select context.*, rollup.* exclude (t), p from context join rollup using (t) left join means using (t)",
                           "case when regexp_full_match(t, '\\s*') then 0.0::double else coalesce(p, 0.5::double) end", "null"),
}))
def decide_modelled(spark, folder):
    """Decisions with the probabilities of an external model: here word weights counted on all reports, asked text by text in the workers."""
    flags = R.match_rules(C.reports(spark, folder)).select("report_text", (F.col("overall_severity") >= 3).alias("flag"))
    words = flags.select("flag", F.explode(F.regexp_extract_all(F.lower("report_text"), F.lit(r"\w\w+"), F.lit(0))).alias("word"))
    odds = words.groupBy("word").agg(F.log((1.0 + F.count_if("flag")) / (1.0 + F.count_if(~F.col("flag")))).alias("weight"), F.count("*").alias("n"))
    # A vocabulary of the usual size.
    weights = {r["word"]: r["weight"] for r in odds.orderBy(F.desc("n"), "word").limit(L.MAX_FEATURES).collect()}
    score = M.text_scorer(M.word_odds(weights))
    rows = decided(spark, folder, probability=F.coalesce(score(F.col("report_text")), F.lit(0.0)))
    return rows.select("report_id", "sif_probability", "priority", "priority_score")


@query("decide_batch", sql("""
select report_id, report_text, priority, printf('%.4f', priority_score) as priority_score, printf('%.4f', sif_probability) as sif_probability,
  coalesce(activity, '') as decision_activity, coalesce(hazard, '') as decision_hazard, coalesce(barrier, '') as decision_barrier,
  coalesce(barrier_status, '') as decision_barrier_status, n_rules::varchar as rules_fired_count, explanation as decision_explanation
from decided"""))
def decide_batch(spark, folder):
    return WR.decision_columns(decided(spark, folder, explained=True), ["report_id", "report_text"])


_explained = {
    "by_report": _with_recurrence["by_report"],
    "with_evidence": "select b.*, e.evidence from by_report b join evidenced e on e.t = b.report_text",
    "told": explained_sql("with_evidence"),
}


@query("explanations", sql("""
select report_id, array_to_string(signal_lines, '; ') as signals, array_to_string(why, '; ') as why, barrier_line,
  pct as model_probability_percent, reason_text as reason, explanation from told""", _explained))
def explanations(spark, folder):
    rows = decided(spark, folder, explained=True, recurrence=_recurrence())
    s = "structured_explanation"
    return rows.select(
        "report_id", joined(f"{s}.important_detected_signals").alias("signals"), joined(f"{s}.why").alias("why"),
        F.col(f"{s}.barrier_control_status").alias("barrier_line"), F.col(f"{s}.model_probability_percent").alias("model_probability_percent"),
        F.col(f"{s}.reason_for_final_priority").alias("reason"), "explanation",
    )


_bad = "[" + ", ".join(
    f"case when priority = {q(level)} and contains(said, {q(p)}) then {q(f'{level}: {p}')} end"
    for level, phrases in W.CONTRADICTIONS.items() for p in phrases
) + f", case when n_rules = 0 and contains(said, {q(W.RULE_CLAIM)}) then {q(f'no rule: {W.RULE_CLAIM}')} end]"


_CLAIMS = [p.capitalize() for phrases in W.CONTRADICTIONS.values() for p in phrases] + ["Nothing else was seen"]
_CLAIMS_SQL = "[" + ", ".join(q(c) for c in _CLAIMS) + "]"


@query("explanation_violations", sql(f"""
select report_id, violation from (select report_id, list_filter({_bad}, lambda x: x is not null) as v
  from (select *, lower(array_to_string(list_concat(why, [{_CLAIMS_SQL}[1 + pos % {len(_CLAIMS)}]]), ' ')) as said from told)), unnest(v) as u(violation)""", _explained))
def explanation_violations(spark, folder):
    """Explanations with one more reason, which contradicts some of them."""
    rows = decided(spark, folder, explained=True, recurrence=_recurrence())
    claim = F.get(tx.text_array(_CLAIMS), (F.col("pos") % len(_CLAIMS)).cast("int"))
    changed = rows.withColumn(
        "structured_explanation",
        F.col("structured_explanation").withField("why", F.concat("structured_explanation.why", F.array(claim))),
    )
    return E.violations(changed)
