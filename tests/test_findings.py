"""Work that was left out, repeated or gathered in one place."""

import re

import __spark_entry__ as entry
import corpus_pipeline as CP
import numpy as np
from pyspark.sql import functions as F

from riskloom.functions import text as TX
from riskloom.functions import vectors as VX
from riskloom.functions.plan import settled
from riskloom.operators import extract as X
from riskloom.operators import persist as P
from riskloom.operators import phrasebook as PB
from riskloom.operators import rules as R
from riskloom.operators import similar as SIM
from riskloom.packs.rules import Rule
from riskloom.plans import corpus as C
from tests.llm.test_simhash import brute_print

FOLDER = "/root/testdata/sf0.001"


def test_vector_is_worked_out_once(spark):
    plan = entry.queries()["hash_embedding"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"md5\(", plan)) == 1


def plain_embedding(text):
    import hashlib

    out = [0.0] * VX.DIMENSIONS
    for word in re.sub("[,.]", " ", text.lower()).split():
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        for i in range(VX.BUCKETS):
            out[(h + i * VX.STRIDE) % VX.DIMENSIONS] += ((h >> (4 * i)) & 255) / 255.0 - 0.5
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out]


def test_vectors_equal_plain_python(spark):
    texts = ["a", "Gas test was not done.", "one two, two one one", "pump " * 40, "x y z " + " ".join(map(str, range(300)))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", VX.hash_embedding("t").alias("v")).collect()
    for r in got:
        np.testing.assert_allclose(r.v, plain_embedding(r.t), atol=1e-12)


def test_totals_of_phrases(spark):
    rows = [("a", "gas gas leak"), ("b", "Gas"), ("b", "leak gas"), (None, "gas"), (None, "leak"), ("c", ""), ("d", None), ("e", "leaks")]
    reports = spark.createDataFrame(rows, "report_id string, report_text string")
    phrases = spark.createDataFrame([(5, "gas"), (6, "leak"), (7, "none")], "entry long, phrase string")
    got = {r.entry: (r.reports, r.occurrences) for r in PB.phrase_totals(reports, phrases).collect()}
    # Rows of one id, also those without one, are one report.
    assert got == {5: (3, 5), 6: (4, 4)}
    single = reports.filter("report_id in ('a', 'c', 'e')")
    assert {r.entry: (r.reports, r.occurrences) for r in PB.phrase_totals(single, phrases).collect()} == {5: (1, 2), 6: (2, 2)}


def test_hits_are_not_shuffled(spark):
    """Reports of one row each are counted in the task that reads them: the hits are in no exchange but that of the totals."""
    reports = spark.createDataFrame([("a", "gas"), ("b", "gas")], "report_id string, report_text string")
    phrases = spark.createDataFrame([(5, "gas")], "entry long, phrase string")
    plan = PB.phrase_totals(reports, phrases)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_classifier_answers_for_reports_without_text(spark):
    queries, reports = entry.queries(), C.reports(spark, FOLDER)
    rows, blank = queries["predict_lr"](spark, FOLDER).collect(), reports.filter(~F.col("report_text").rlike(r"\S")).count()
    assert blank > 0 and len(rows) == reports.count()
    assert sum(r.on_its_side is None and r.adds_up is None for r in rows) == blank
    found = queries["train_lr"](spark, FOLDER).first()
    assert found.n_samples == len(rows) and found.without_text == blank and found.positives == sum(r.label for r in rows)
    assert found.good_f1 and found.good_f2


def test_near_stage_links_fingerprints(spark, tmp_path):
    """Two texts of one fingerprint with few shingles in common, and two with most of them in common."""
    base = "the pump ran well today " * 60
    one, other = (base + " ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    assert (brute_print(one) ^ brute_print(other)).bit_count() <= 3
    words = [f"w{k}" for k in range(120)]
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [(1, one), (2, other), (3, " ".join(words)), (4, near), (5, "quite another report of a crane and its load")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in CP.near(spark, docs, str(tmp_path)).collect()) == [1, 3, 5]


def test_reanalysis_is_dealt_out(spark):
    """Both analyses run after an exchange of a given number of tasks, which adaptive plans leave alone, above the join."""
    rows = spark.createDataFrame([(str(k), f"t{k}") for k in range(40)], "report_id string, report_text string")
    keys = spark.createDataFrame([(str(k),) for k in range(0, 40, 3)], "report_id string")
    out = P.reanalysed(rows, keys, lambda r: r.select("report_id", F.lit("old").alias("of")), lambda r: r.select("report_id", F.lit("new").alias("of")))
    assert {r.report_id: r.of for r in out.collect()} == {str(k): "old" if k % 3 else "new" for k in range(40)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition 4, true") == 2 and plan.index("Repartition") < plan.index("Join")


def test_groups_of_vectors_are_bounded(spark, monkeypatch):
    """Vectors that lie in no blocks meet everywhere; a group still holds so many rows and columns only."""
    monkeypatch.setattr(SIM, "BLOCK_ROWS", 40)
    draw = np.random.default_rng(1).normal(size=(600, 32))
    vectors = spark.createDataFrame([(k, v.tolist(), k) for k, v in enumerate(draw)], "vid long, vec array<double>, first long")
    sizes = SIM._paired(vectors, 0.35, 20).groupBy("at", "row_part", "column_part").agg(
        F.count_if("home").alias("rows"), F.count_if(~F.col("home")).alias("columns")).collect()
    assert max(r.columns for r in sizes) <= 80 and max(r.rows for r in sizes) <= 40
    unit = draw / np.linalg.norm(draw, axis=1, keepdims=True)
    want, product = {}, unit @ unit.T
    for k in range(600):
        sims = [(-np.floor(x * 1e4 + 0.5) / 1e4, j) for j, x in enumerate(product[k]) if j != k]
        want[k] = [j for s, j in sorted(sims)[:5] if -s >= 0.35]
    got = {}
    for r in SIM.nearest(vectors, 5, 0.35, 20).orderBy("vid", "rank").collect():
        got.setdefault(r.vid, []).append(r.other)
    assert got == {k: v for k, v in want.items() if v}


def test_settled_columns_stay_out_of_whole_stage_code(spark):
    """As one method the code of a long projection would pass the size that the JVM compiles."""
    rows = spark.range(3)
    done = settled(rows, rows.withColumn("n", F.col("id") + 1))
    lines = [x for x in done._jdf.queryExecution().executedPlan().toString().splitlines() if "SPARK_PARTITION_ID" in x]
    assert lines and not any("*(" in x for x in lines)
    assert [r.n for r in done.orderBy("id").collect()] == [1, 2, 3]


def test_signals_are_not_tested_in_a_loop(spark):
    rules = [Rule("R1", "One", "c", 3, ("Gas", "leak", "gas"), "x"), Rule("R2", "Two", "c", 4, ("leak",), "x")]
    rows = spark.createDataFrame([("a", "GAS Leak"), ("b", ""), ("c", None), ("d", "none")], "report_id string, report_text string")
    matched = R.match_rules(rows, rules)
    assert "lambdafunction(Contains(" not in matched._jdf.queryExecution().optimizedPlan().toString()
    got = {r.report_id: [(m.rule_id, m.signals) for m in r.matched_rules] for r in matched.collect()}
    assert got == {"a": [("R2", ["leak"]), ("R1", ["Gas", "leak", "gas"])], "b": [], "c": [], "d": []}


def test_searches_are_compiled(spark):
    """Signals are tested outside a filter, and searches for phrases and states stay out of whole-stage code."""
    rows = spark.createDataFrame([("a", "Pump maintenance began on live circuit without verified isolation.")], "report_id string, report_text string")
    plan = X.extract(R.match_rules(rows))._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if " AS __cut_0#" in x or " AS __state_0#" in x or "_joined#" in x and "Contains(" in x]
    assert len(lines) >= 2 and not any("*(" in x.split("Project")[0] for x in lines)
    assert "lambdafunction(isnotnull" not in "".join(x for x in plan.splitlines() if "Contains(" in x)


def test_one_match_is_told_as_several_are(spark):
    """A single match, which is told without a loop, has the text, offsets and value that it has among others."""
    one = "  At the\ttank  farm Kİſ\U0001f6a7 a WELDER was servicing the Main Pump near wellhead 7 flare stack, without any permit"
    rows = spark.createDataFrame([(k, one + gap + one) for k, gap in enumerate((". ", " \n"))] + [(2, one), (3, ""), (4, None), (5, "no match")], "n int, report_text string")
    found = {r.n: r for r in X.extract(rows).collect()}
    for column in ("gazetteer_entities", "pattern_entities"):
        single = [(e.entity_type, e.text, e.normalized_value, e.start, e.end, e.confidence, e.source, e.status) for e in found[2][column]]
        assert len({e[0] for e in single}) >= 2 and all(one.strip()[s:t].endswith(text) for _, text, _, s, t, *_ in single)
        for n in (0, 1):
            both = [(e.entity_type, e.text, e.normalized_value, e.start, e.end, e.confidence, e.source, e.status) for e in found[n][column]]
            assert set(single) <= set(both)
        assert not found[3][column] and not found[4][column] and not found[5][column]


def test_only_the_types_in_use_are_searched_for(spark):
    """A plan that needs hazards and barriers holds neither the searches for places and equipment nor the list of all spans."""
    rows = spark.createDataFrame([("a", "Pump maintenance began in the pump room without verified isolation.")], "report_id string, report_text string")
    done = X.extract(rows)
    plan = done.select("report_id", "hazard", "barrier", "barrier_status")._jdf.queryExecution().optimizedPlan().toString()
    assert "__cut_hazard" in plan and "__state_0" in plan
    assert not any(f"__cut_{k}" in plan for k in ("location", "equipment", "activity")) and "tank\\s+farm" not in plan
    r = done.first()
    assert (r.hazard, r.barrier, r.barrier_status, r.extracted_location) == ("Electrical Energy", "Isolation", "Not Verified", "Pump Room / Station")


def test_phrases_are_searched_for_by_a_shared_word(spark):
    known = ("gas leak", "no gas", "leaking valve", "leaking", "", "permit", "permits due")
    stem = TX.stems(known)
    assert set(stem) == set(known) and all(w in p for p, w in stem.items()) and len(set(stem.values())) < len(known)
    rows = spark.createDataFrame([("a", "NO GAS leaking valves, permits due"), ("b", "permit"), ("c", None)], "report_id string, report_text string")
    matched = R.match_rules(rows, [Rule("R1", "One", "c", 3, known[:4] + known[5:], "x"), Rule("R2", "Two", "c", 1, ("Permits due",), "x")])
    assert "__held" in matched._jdf.queryExecution().optimizedPlan().toString()
    got = {r.report_id: [(m.rule_id, m.signals) for m in r.matched_rules] for r in matched.collect()}
    assert got == {
        "a": [("R1", ["gas leak", "no gas", "leaking valve", "leaking", "permit", "permits due"]), ("R2", ["Permits due"])], "b": [("R1", ["permit"])], "c": [],
    }


def test_entities_of_a_type_are_merged_as_before(spark):
    """One span of each source is told without loops; beside a far copy of the same text, which needs them, it is told the same."""
    one = "A welder began: no permit at the wellhead; welding operation on scaffold"
    rows = spark.createDataFrame([(1, one), (2, one + "." * 60 + one), (3, "permit not verified"), (4, "isolation " + "x" * 40 + " lockout missing")],
                                 "n int, report_text string")
    found = {r.n: [(e.entity_type, e.text, e.start, e.end, e.confidence, e.source, e.status) for e in r.entities] for r in X.extract(rows).collect()}
    shift = len(one) + 60
    assert found[2] == found[1] + [(*e[:2], e[2] + shift, e[3] + shift, *e[4:]) for e in found[1]]
    assert [e for e in found[1] if e[0] == "barrier"] == [("barrier", "permit", 19, 25, 0.96, "hybrid", "Absent")]
    assert found[3] == [("barrier", "permit", 0, 6, 0.96, "hybrid", "Not Verified")]
    assert [e[1:4] + e[5:] for e in found[4]] == [("isolation", 0, 9, "deterministic", None), ("lockout", 51, 58, "hybrid", "Absent")]
