"""A few values of each pack, said literally, so that a wrong pack does not pass because the oracles share it."""

from riskloom.operators import extract as X
from riskloom.operators import rules as R
from riskloom.packs.gazetteer import DEFAULT_GAZETTEERS, IMPLIED_HAZARDS
from riskloom.packs.patterns import STATUS_WORDS
from riskloom.packs.rules import DEFAULT_RULES
from riskloom.packs.scoring import ACTIVITY_MULTIPLIERS, HAZARD_MULTIPLIERS, WEIGHTS
from riskloom.plans.triage import triage


def test_sizes():
    assert [len(r.signals) for r in DEFAULT_RULES] == [21, 23, 23, 19, 21]
    assert {g.kind: (len(g.terms), sum(len(t.aliases) for t in g.terms)) for g in DEFAULT_GAZETTEERS} == {
        "activity": (17, 103), "hazard": (11, 79), "barrier": (11, 60), "location": (14, 35), "equipment": (13, 31)}
    assert sum(len(words) for _, words in STATUS_WORDS) == 61 and len(IMPLIED_HAZARDS) == 8
    assert abs(sum(WEIGHTS.values()) - 1.10) < 1e-9
    assert "Scaffolding" not in ACTIVITY_MULTIPLIERS and max(HAZARD_MULTIPLIERS.values()) <= 1.0


def test_canonical_sentence(spark):
    text = "Maintenance technician worked on energized equipment without verified isolation."
    row = triage(spark.createDataFrame([("R1", text)], "report_id string, report_text string")).first()
    assert (row.priority, row.activity, row.hazard, row.barrier, row.barrier_status, row.equipment) == (
        "HIGH", "Maintenance", "Electrical Energy", "Isolation", "Not Verified", "energized equipment")


def test_a_pack_file_is_read_and_checked(spark, tmp_path):
    path = tmp_path / "pack.json"
    path.write_text('{"rules": [{"id": "R1", "name": "N", "category": "C", "severity": 2, "signals": ["oil leak"], "explanation": "E"}, '
                    '{"id": "R2", "name": "N", "severity": 7, "signals": [], "explanation": "E"}]}')
    table = R.read_pack(spark, str(path))
    found = {(r.id, r.violation) for r in R.rule_violations(table).collect()}
    assert found == {("R2", "missing category"), ("R2", "severity outside 1-4"), ("R2", "no signals")}
    (rule,) = R.rules_of(table.filter("id = 'R1'"))
    assert rule.signals == ("oil leak",) and rule.conditions == ()


def test_single_matches_of_barrier_states(spark):
    rows = spark.createDataFrame([("R1", "The work permit was no verified and lockout was signed off.")], "report_id string, report_text string")
    spans = X.entity_rows(X.extract(rows), "pattern_entities").filter("entity_type = 'barrier'").collect()
    got = sorted((s.text, s.status) for s in spans)
    assert got == [("lockout was signed", "Present"), ("lockout was signed off", "Present"), ("work permit was no", "Absent"), ("work permit was no verified", "Not Verified")]
