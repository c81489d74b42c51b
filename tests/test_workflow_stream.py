from datetime import datetime, timedelta
from itertools import permutations

from pyspark.sql import functions as F

from riskloom.operators import workflow as WF
from riskloom.streaming import workflow_stream as WS

DAY = datetime(2024, 1, 10)
REPORT = "report_id string, created_at timestamp, report_text string, priority string, sif_probability double, activity string, hazard string, barrier string, barrier_status string, location string"
REVIEW = "report_id string, reviewer_id string, decision string, corrected_priority string, corrected_activity string, corrected_hazard string, corrected_barrier string, comments string, reviewed_at timestamp"


def sources(spark):
    reports = spark.createDataFrame([(f"R{i}", DAY, f"text {i}", p, 0.5, None, "Gravity", None, None, None) for i, p in enumerate(["HIGH", "HIGH", "MEDIUM", "LOW", "HIGH"])], REPORT)
    nothing = (None,) * 4
    reviews = spark.createDataFrame([
        ("R0", "HSE-A", "confirmed", *nothing, None, DAY + timedelta(days=2)), ("R0", "HSE-B", "rejected", *nothing, None, DAY + timedelta(days=1)),
        ("R2", "HSE-A", "corrected", "HIGH", None, None, "PPE", "x", DAY), ("R1", "HSE-A", "rejected", *nothing, "", DAY), ("R9", "HSE-A", "confirmed", *nothing, None, DAY),
    ], REVIEW)
    acks = spark.createDataFrame([("ALT-R4", DAY, "C"), ("ALT-R4", DAY + timedelta(hours=1), "D"), ("ALT-R3", DAY, "C")], "alert_id string, acknowledged_at timestamp, acknowledged_by string")
    changes = spark.createDataFrame([("ACT-R0", 1, "Assigned", "X"), ("ACT-R0", 3, "Closed", None), ("ACT-R0", 2, None, "Y"), ("ACT-R1", 1, "Closed", None)], "action_id string, seq long, status string, assigned_to string")
    return reports, reviews, acks, changes


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_any_cut_gives_the_batch_tables(spark, tmp_path):
    """Kinds in several orders, a batch that comes again under a new number, and one that comes again under its own."""
    reports, reviews, acks, changes = sources(spark)
    resolved = WF.resolve(WF.route(reports), reviews)
    state = ("report_id", "previous_status", "workflow_status", "in_review_queue", "final_priority")
    alert, action = ("alert_id", "workflow_status", "acknowledged", "acknowledged_by", "message"), ("action_id", "title", "status", "assigned_to")
    want = (
        rows(resolved, *state), rows(WF.acknowledge(WF.resolve_alerts(WF.alerts(WF.route(reports)), reviews), acks), *alert),
        rows(WF.current_state(WF.actions(resolved), changes, "action_id", "seq", "status", "assigned_to"), *action),
        [("R1", "action"), ("R3", "acknowledgement"), ("R9", "review")],
    )
    kinds = [WS.analysis_events(reports), WS.review_events(reviews), WS.acknowledgement_events(acks), WS.action_events(changes)]
    for n, order in enumerate(list(permutations(range(4)))[::9]):
        tables = WS.WorkflowTables(spark, f"{tmp_path}/t{n}", 4)
        for batch_id, kind in enumerate([*order, order[0]]):
            tables.write(kinds[kind], batch_id)
        tables.write(kinds[0].withColumn("report_id", F.lit("ghost")), 0)
        assert (rows(tables.reports(), *state), rows(tables.alerts(), *alert), rows(tables.actions(), *action), rows(tables.unapplied(), "report_id", "kind")) == want
        assert tables.rejects().isEmpty()
    assert [(a, status, who) for a, _, status, who in want[2]] == [("ACT-R0", "Closed", "Y"), ("ACT-R2", "Open", None)]


def test_events_that_break_a_rule(spark, tmp_path):
    """They are kept whole with the rules they break, once, and touch no case; a reanalysed report takes its last analysis."""
    reports, reviews, acks, changes = sources(spark)
    tables = WS.WorkflowTables(spark, f"{tmp_path}/t", 4)
    bad = [
        WS.review_events(reviews.withColumn("decision", F.lit("maybe"))).limit(1), WS.analysis_events(reports.withColumn("report_id", F.lit(None).cast("string"))).limit(1),
        WS.acknowledgement_events(acks.withColumn("alert_id", F.lit("R4"))).limit(1), WS.analysis_events(reports).limit(1).withColumn("kind", F.lit("other")),
        WS.action_events(changes.withColumns({"status": F.lit(None).cast("string"), "assigned_to": F.lit(None).cast("string")})).limit(1),
    ]
    for batch_id in range(2):
        for k, frame in enumerate(bad):
            tables.write(frame, batch_id * len(bad) + k)
    assert sorted(tuple(r.violations) for r in tables.rejects().collect()) == [("decision",), ("event",), ("kind",), ("report_id",), ("report_id",)]
    assert tables.cases.read().isEmpty()
    tables.write(WS.analysis_events(reports).unionByName(WS.analysis_events(reports.withColumns({"created_at": F.lit(DAY - timedelta(days=1)), "priority": F.lit("LOW")}))), 20)
    assert [r.priority for r in tables.reports().orderBy("report_id").collect()] == ["HIGH", "HIGH", "MEDIUM", "LOW", "HIGH"]
    tables.write(WS.analysis_events(reports.filter("false")), 21)
    assert tables.reports().count() == 5
