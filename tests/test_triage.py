from datetime import datetime

from pyspark.sql import functions as F

from riskloom.operators import explain as E
from riskloom.operators import persist as PS
from riskloom.operators import rules as R
from riskloom.operators import score as SC
from riskloom.operators import views as V
from riskloom.operators import workflow as WF
from riskloom.plans.triage import triage

CANONICAL = "Maintenance started on energized equipment without verified isolation."
DDL = "report_id string, report_text string, created_at timestamp"
DAY = datetime(2024, 1, 1)


def reports(spark, *texts):
    return spark.createDataFrame([(f"R{i}", t, DAY) for i, t in enumerate(texts)], DDL)


def test_canonical_sentence(spark):
    row = triage(reports(spark, CANONICAL)).first()
    assert (row.priority, row.activity, row.hazard, row.barrier, row.barrier_status, row.equipment) == (
        "HIGH", "Maintenance", "Electrical Energy", "Isolation", "Not Verified", "energized equipment")
    assert row.sif_probability == 0.95 and row.escalated and row.priority_score > 0.9
    assert row.evidence[0] == "energized equipment"


def test_blank_text_scores_the_defaults(spark):
    for row in triage(reports(spark, "", "  ", None)).collect():
        assert row.priority == "LOW" and row.sif_probability == 0.0 and row.matched_rules == []


def test_priority_never_falls_when_probability_rises(spark):
    base = spark.range(0, 101).select(F.concat(F.lit("R"), "id").alias("report_id"), F.lit("Quiet day at the office block").alias("report_text"), F.lit(DAY).alias("created_at"), "id")
    rows = triage(base, probability=F.col("id") / 100.0, explained=False).orderBy("id").collect()
    level = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
    values = [level[r.priority] for r in rows]
    assert values == sorted(values) and values[60] >= 1 and values[85] == 2 and values[59] < values[85]


def test_recurrence_adds_to_full_weights(spark):
    rows = reports(spark, "Routine inspection")
    without = triage(rows, explained=False).first().composite_score
    with_ = triage(rows, recurrence=F.lit(1.0), explained=False).first().composite_score
    assert abs(with_ - without - 0.10) < 1e-9


def test_unlisted_hazard_scores_the_default_but_never_escalates(spark):
    given = {"activity": F.lit("X"), "hazard": F.lit("Unheard"), "barrier": F.lit("B"), "barrier_status": F.lit("Failed")}
    row = triage(reports(spark, "nothing here"), given=given).first()
    assert row.factor_scores.critical_hazard == 0.4 and not row.escalated and row.entities == []


def test_failed_barrier_with_critical_hazard_escalates(spark):
    given = {"activity": F.lit("X"), "hazard": F.lit("Asphyxiation"), "barrier": F.lit("B"), "barrier_status": F.lit("Failed")}
    row = triage(reports(spark, "nothing here"), given=given).first()
    assert row.priority == "HIGH" and "Asphyxiation" in row.escalation_reason


def test_explanations_do_not_contradict(spark):
    texts = [CANONICAL, "Toolbox meeting was held", "A welder was grinding", "Permit signed off"]
    assert E.violations(triage(reports(spark, *texts))).count() == 0


def test_rules_keep_their_own_signals(spark):
    rows = R.rule_rows(R.match_rules(reports(spark, "Hot work in the confined space"))).collect()
    assert {r.rule_id: r.signals for r in rows} == {"RULE_002": ["confined space"], "RULE_004": ["hot work"]}
    assert [r.severity for r in rows] == [4, 3]


def test_rule_table_violations(spark):
    bad = spark.createDataFrame([(0, "A", "n", "c", 5, [], [], "e", "")], R.RULE_SCHEMA)
    assert {r.violation for r in R.rule_violations(bad).collect()} == {"severity outside 1-4", "no signals"}
    assert R.rule_violations(R.rule_table(spark)).count() == 0


def test_filter_on_a_result_does_not_repeat_the_work(spark):
    plan = triage(reports(spark, CANONICAL)).filter("hazard = 'Electrical Energy'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("aggregate(") <= 80


REVIEW = ("report_id string, reviewer_id string, decision string, corrected_priority string, corrected_activity string, "
          "corrected_hazard string, corrected_barrier string, comments string, reviewed_at timestamp")


def reviewed(spark, *rows):
    return spark.createDataFrame([(*r, None, datetime(2024, 1, 2 + i)) for i, r in enumerate(rows)], REVIEW)


def routed(spark, *texts):
    rows = WF.route(triage(reports(spark, *texts), explained=False))
    return rows.withColumns({"location": F.lit("Yard"), "report_type": F.lit("near_miss")})


def test_reviewed_priority_decides_on_actions(spark):
    rows = routed(spark, "Routine inspection of flare stack", CANONICAL, CANONICAL)
    reviews = reviewed(spark, ("R0", "A", "corrected", "HIGH", None, None, None), ("R1", "A", "corrected", "LOW", None, None, None),
                       ("R2", "A", "rejected", None, None, None, None))
    assert [a.report_id for a in WF.actions(WF.resolve(rows, reviews)).collect()] == ["R0"]


def test_transition_keeps_the_state_before(spark):
    rows = WF.resolve(routed(spark, CANONICAL), reviewed(spark, ("R0", "A", "confirmed", None, None, None, None)))
    details = PS.audit_of_transitions(rows).first().details
    assert '"previous_status":"HSE_REVIEW_REQUIRED"' in details and '"new_status":"REVIEWED_CONFIRMED"' in details


def test_latest_review_counts_and_unknown_reports_are_orphans(spark):
    reviews = reviewed(spark, ("R0", "A", "rejected", None, None, None, None), ("R0", "B", "confirmed", None, None, None, None),
                       ("R9", "B", "confirmed", None, None, None, None))
    rows = routed(spark, CANONICAL)
    out = V.summary(rows, reviews).collect()
    assert len(out) == 1 and out[0].review_decision == "confirmed" and out[0].final_priority == "HIGH"
    assert [r.report_id for r in WF.orphans(reviews, rows).collect()] == ["R9"]


def test_corrected_null_fields_in_both_views(spark):
    rows, reviews = routed(spark, CANONICAL), reviewed(spark, ("R0", "A", "corrected", "LOW", None, "Struck-By", None))
    lists = V.dual_view(rows, reviews).first()
    single = V.dual_view(rows, reviews, per_field_fallback=False).first()
    assert (lists.final_activity, lists.final_hazard) == ("Maintenance", "Struck-By")
    assert (single.final_activity, single.final_hazard) == (None, "Struck-By")
    assert lists.ai_hazard == "Electrical Energy"


def test_upsert_overwrites_text_and_location_only(spark):
    ddl = "report_id string, report_text string, location string, report_type string, created_at timestamp"
    stored = spark.createDataFrame([("R0", "old", "A", "near_miss", DAY)], ddl)
    arriving = spark.createDataFrame([("R0", "new", "B", "other", datetime(2025, 1, 1), 1), ("R1", "x", "C", "other", DAY, 1)], ddl + ", seq int")
    rows = {r.report_id: r for r in PS.upsert_reports(stored, arriving, "seq").collect()}
    assert (rows["R0"].report_text, rows["R0"].location, rows["R0"].report_type, rows["R0"].created_at) == ("new", "B", "near_miss", DAY)
    assert rows["R1"].report_type == "other"


def test_legacy_floor(spark):
    row = SC.legacy_score(R.roll_up(R.match_rules(reports(spark, "grinding")))).first()
    assert row.legacy_band == "MEDIUM" and row.word_count == 1
